"""Budgeted recall and compaction (K1, K2): the engine's two main plans over many sessions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decision_sentences, entities, heuristic_tokens, importance, sanitize, session_hash, topics
from ..operators.gate import gate
from ..operators.select import budget_prefix


def recall_blocks(scored: DataFrame, budget: int = 400, by: str = "session_id") -> DataFrame:
    """K1: scored items (session, id, content, score) through the adaptive gate and the budget to one text block each.

    One shuffle by session carries the gate's averages, the running sum and the
    final list. Sessions from which nothing passes have no row.
    """
    x = scored.withColumn("tokens", heuristic_tokens(F.col("content")))
    x = gate(x, [by], "score", "id")
    x = budget_prefix(x, [by], "score", "tokens", "id", F.lit(budget))
    line = F.concat(F.lit("- "), F.substring(sanitize(F.col("content")), 1, 120))
    g = x.groupBy(by).agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"), F.max("threshold").alias("threshold"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", line.alias("line")))).alias("l"))
    block = F.concat(F.lit("[Memory "), session_hash(F.col(by)), F.lit("]\n"), F.array_join(F.transform("l", lambda r: r["line"]), "\n"))
    return g.select(by, "items", "tokens", "threshold", block.alias("block"))


def message_scores(messages: DataFrame) -> DataFrame:
    """Messages as scored items: importance in hundredths, and a little for the place."""
    return messages.select("session_id", F.col("idx").alias("id"), "content", (F.least(F.lit(1.0), F.floor((importance(F.col("content")) / 100.0 + (F.col("idx") % 7) / 20.0) * 100 + 0.5) / 100)).alias("score"))


def compact(messages: DataFrame, keep: int = 4, by: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """The newest ``keep`` messages of each session, and a summary line of the others."""
    newest = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("idx")))
    x = messages.withColumn("_n", newest)
    old = x.filter(F.col("_n") > keep)
    text = F.col("content")
    g = old.groupBy(by).agg(F.count(F.lit(1)).alias("removed"), F.array_sort(F.collect_list(F.struct("idx", decision_sentences(text).alias("d"), entities(text).alias("e"), topics(text).alias("t")))).alias("l"))
    flat = lambda c: F.flatten(F.transform("l", lambda r: r[c]))
    d, e, t = F.slice(flat("d"), 1, 5), F.slice(F.array_distinct(flat("e")), 1, 8), F.slice(F.array_distinct(flat("t")), 1, 15)
    part = lambda name, arr, text_: F.when(F.size(arr) > 0, F.concat(F.lit(f" | {name}: "), text_)).otherwise("")
    summary = F.concat(
        F.lit("[Compacted History - "), F.col("removed").cast("string"), F.lit(" msgs] | Topics: "), F.when(F.size(t) > 0, F.array_join(t, ",")).otherwise("general discussion"),
        part("decisions", d, F.array_join(F.transform(d, lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ";")), part("entities", e, F.array_join(e, ",")),
    )
    return x.filter(F.col("_n") <= keep).drop("_n"), g.select(by, "removed", summary.alias("summary"))
