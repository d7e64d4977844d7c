"""Compaction of sessions to a token target (K2): what stays, why a session is left alone, the summary of the rest, and the messages afterwards.

All sessions are judged in one plan; only those above their target take part in
the costly steps. The cut of the ``recent`` strategy works on blocks of ``BLOCK``
places: their totals give each block what lies behind it, so the rows of one
long session spread over many tasks. The ``semantic`` strategy decides message by
message and is an ordered fold. Summaries hold bounded lists, found by aggregates
and ranks that are cut before the shuffle; no session's texts are collected. The
decided rows of the sessions above their target are stored once (``lineage.cut``),
since the verdict, each list of the summary and the messages afterwards read them.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fold, quality
from ..operators.lineage import cut as cut_lineage
from ..operators.select import top_k

#: Share of the context window that messages may take.
SHARE = 0.75
#: Places of a block of a session.
BLOCK = 1024
PREFIX = "[Compacted History"
#: The last four keywords belong to the semantic summary alone.
RECENT_TOPICS = tx.TOPICS[:-4]
DUPLICATE_PENALTY = 20


class Compaction(NamedTuple):
    """``sessions``: one row for each session with its verdict; ``messages``: (session, part, idx, role, content) afterwards, part 0 derived, 1 summary, 2 kept."""

    sessions: DataFrame
    messages: DataFrame


def _source(messages: DataFrame, by: str) -> DataFrame:
    derived = F.coalesce(F.col("derived"), F.lit(False)) if "derived" in messages.columns else F.lit(False)
    text = F.coalesce("content", F.lit(""))
    x = messages.select(by, "idx", "role", text.alias("content"), (derived | text.startswith(PREFIX)).alias("derived"))
    return x.withColumn("tokens", tx.heuristic_tokens(F.col("content")).cast("long"))


def _totals(x: DataFrame, windows: DataFrame | int, share: float, by: str) -> DataFrame:
    own = ~F.col("derived")
    n = lambda c: F.count(F.when(c, 1))
    tokens = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0))
    g = x.groupBy(by).agg(n(own).alias("n"), tokens(own).alias("tokens_before"), n(~own).alias("n_derived"), tokens(~own).alias("derived_tokens"))
    if isinstance(windows, int):
        g = g.withColumn("window", F.lit(windows))
    else:
        w = windows.groupBy(F.col(by).alias("_by")).agg(F.max("window").alias("window"))
        g = g.join(w, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return g.withColumn("target", F.floor(F.col("window") * share).cast("long")).drop("window")


def _cut_recent(x: DataFrame, by: str, least_old: int) -> DataFrame:
    """``kept``: a session's rows from the place on at which the tokens of what follows fit, at least ``least_old`` places in."""
    x = x.withColumn("_block", F.floor(F.col("idx") / BLOCK))
    blocks = x.groupBy(by, "_block").agg(F.count(F.lit(1)).alias("_rows"), F.sum("tokens").alias("_sum"))
    back = Window.partitionBy(by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    front = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select(F.col(by).alias("_by"), F.col("_block").alias("_b"), zero(F.sum("_sum").over(back)).alias("_behind"), zero(F.sum("_rows").over(front)).alias("_before"))
    x = x.join(blocks, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_b"))).drop("_by", "_b")
    w = Window.partitionBy(by, "_block")
    order = [F.desc("idx"), F.desc("role"), F.desc("content")]
    x = x.withColumn("_run", F.sum("tokens").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_behind"))
    x = x.withColumn("_place", F.col("_before") + F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy(*order)))
    cut = x.groupBy(F.col(by).alias("_by")).agg(F.least(F.count(F.lit(1)), F.greatest(F.lit(least_old), F.max(F.when(F.col("_run") > F.col("target"), F.col("_place"))) + 1)).alias("_from"))
    x = x.join(cut, F.col(by).eqNullSafe(F.col("_by")))
    return x.withColumn("kept", F.col("_place") >= F.col("_from")).drop("_block", "_behind", "_before", "_run", "_place", "_by", "_from")


class _FillTo:
    """Keeps what has to stay, then each further row that still fits its group's target."""

    def __init__(self) -> None:
        self.used = 0

    def step(self, must, tokens, target):
        out = []
        for m, t, most in zip(must.tolist(), tokens.tolist(), target.tolist()):
            keep = m or self.used + t <= most
            self.used += t * keep
            out.append(keep)
        return (out,)


def _cut_semantic(x: DataFrame, by: str, min_keep: int) -> DataFrame:
    """``kept``: the newest ``min_keep`` rows, then by falling importance what still fits; likeness to one of the ten before costs importance."""
    x = x.withColumn("_scored", F.when(F.char_length("content") >= 5, F.col("content")))
    x = quality.near_duplicates(x, [by], "idx", "_scored").drop("_scored")
    text = F.col("content")
    score = F.when(F.char_length(text) < 5, 0).otherwise(tx.importance(text) - F.when(F.col("duplicate"), DUPLICATE_PENALTY).otherwise(0))
    newest = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("idx"), F.desc("role"), F.desc("content")))
    x = x.withColumn("_new", newest <= min_keep).withColumn("_score", score)
    order = [F.desc("_new"), F.desc("_score"), F.asc("idx"), F.asc("role"), F.asc("content")]
    x = fold.ordered_fold(x, [by], order, ["_new", "tokens", "target"], _FillTo, {"kept": ("boolean", pa.bool_())}, dealt=True)
    return x.drop("duplicate", "_new", "_score")


def _found_topics(x: DataFrame, by: str, names: tuple[str, ...], sep: str) -> DataFrame:
    """``topics``: up to 15 keywords in the order of the messages that first hold them."""
    low = F.lower("content")
    first = [F.min(F.when(F.contains(low, F.lit(n.lower())), F.col("idx"))).alias(f"_t{i}") for i, n in enumerate(names)]
    hits = F.array(*[F.struct(F.col(f"_t{i}").alias("at"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    hits = F.slice(F.array_sort(F.filter(hits, lambda h: h["at"].isNotNull())), 1, 15)
    return x.groupBy(by).agg(*first).select(by, F.when(F.size(hits) > 0, F.array_join(F.transform(hits, lambda h: h["name"]), sep)).otherwise("general discussion").alias("topics"))


def _first(x: DataFrame, by: str, order: list[str], value: str, k: int) -> DataFrame:
    """The first k values of each session as an array; ranks are cut before the shuffle."""
    x = top_k(x, [by], [F.asc(c) for c in order], k, "_rank").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_rank", value))).alias("_l"))
    return x.select(by, F.transform("_l", lambda r: r[value]).alias(value))


def _joined(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    right = right.withColumnRenamed(by, "_by")
    return left.join(right, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def _quoted(values: str, sep: str) -> Column:
    return F.array_join(F.transform(values, lambda s: F.concat(F.lit('"'), s, F.lit('"'))), sep)


def _summary_recent(rows: DataFrame, by: str) -> DataFrame:
    """(session, summary) of the removed rows: keywords and the first five requests."""
    old = rows.filter(~F.col("kept"))
    said = old.filter((F.col("role") == "user") & (F.col("content") != "")).select(by, "idx", F.substring("content", 1, 100).alias("said"))
    x = old.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    x = _joined(_joined(x, _found_topics(old, by, RECENT_TOPICS, ", "), by), _first(said, by, ["idx", "said"], "said", 5), by)
    asked = F.when(F.size("said") > 0, F.concat(F.lit("\nKey requests: "), _quoted("said", "; "))).otherwise("")
    head = F.concat(F.lit(f"{PREFIX} — "), F.col("_n").cast("string"), F.lit(" earlier messages summarized]\nTopics: "), F.col("topics"))
    return x.select(by, F.concat(head, asked, F.lit("\n\nContinue with the current task using the remaining recent context below.")).alias("summary"))


def _summary_semantic(rows: DataFrame, by: str) -> DataFrame:
    """(session, summary): keywords, decisions and entities of all source rows, kept ones too, and the number of the removed."""
    said = rows.select(by, "idx", F.posexplode(tx.decision_sentences(F.col("content"))).alias("_i", "decision"))
    named = rows.select(by, "idx", F.posexplode(tx.entities(F.col("content"))).alias("_i", "entity"))
    named = named.groupBy(by, "entity").agg(F.min(F.struct("idx", "_i")).alias("_at"))
    x = rows.groupBy(by).agg(F.count(F.when(~F.col("kept"), 1)).alias("_n"))
    x = _joined(x, _found_topics(rows, by, tx.TOPICS, ","), by)
    x = _joined(_joined(x, _first(said, by, ["idx", "_i", "decision"], "decision", 5), by), _first(named, by, ["_at", "entity"], "entity", 8), by)
    decided = F.when(F.size("decision") > 0, F.concat(F.lit(" | decisions: "), _quoted("decision", ";"))).otherwise("")
    things = F.when(F.size("entity") > 0, F.concat(F.lit(" | entities: "), F.array_join("entity", ","))).otherwise("")
    return x.select(by, F.concat(F.lit(f"{PREFIX} - "), F.col("_n").cast("string"), F.lit(" msgs] | Topics: "), F.col("topics"), decided, things).alias("summary"))


def compact_to(messages: DataFrame, windows: DataFrame | int, strategy: str = "recent", share: float = SHARE, min_keep: int = 20, too_few: int = 10, by: str = "session_id") -> Compaction:
    """K2: brings each session's messages to ``share`` of its context window.

    ``messages`` (session, idx, role, content[, derived]); ``windows`` one number
    or (session, window). Derived entries are never a source and always stay.
    ``recent`` keeps the newest messages that fit, but never fewer than
    ``min_keep`` places are given up; ``semantic`` keeps the newest ``min_keep``
    and then the most important that fit. A session is left as it is, with the
    reason, if it has no source message, no window, is at or below its target, or would
    lose ``too_few`` messages or fewer. Null contents are empty; ties of ``idx`` go by
    role and content; an empty table gives empty results; other columns are not read.
    ``tokens_after`` counts the messages that are kept.
    """
    if strategy not in ("recent", "semantic"):
        raise ValueError(f"no such strategy: {strategy}")
    x = _source(messages, by)
    totals = _totals(x, windows, share, by)
    above = totals.filter("tokens_before > target").select(F.col(by).alias("_by"), "target")
    rows = x.filter("not derived").join(above, F.col(by).eqNullSafe(F.col("_by"))).drop("_by", "derived")
    rows = cut_lineage(_cut_recent(rows, by, min_keep) if strategy == "recent" else _cut_semantic(rows, by, min_keep))
    cut = rows.groupBy(by).agg(F.count(F.when(~F.col("kept"), 1)).alias("removed"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("_kept_tokens"))
    cut = _joined(cut, (_summary_recent if strategy == "recent" else _summary_semantic)(rows, by), by)
    s = _joined(totals, cut, by)
    done = F.coalesce(F.col("removed") > too_few, F.lit(False))
    number = lambda c: F.col(c).cast("string")
    reason = (
        F.when(F.col("n") == 0, "no messages to compact").when(F.col("target").isNull(), "no context window")
        .when(F.col("removed").isNull(), F.concat(F.lit("already under target ("), number("tokens_before"), F.lit(" <= "), number("target"), F.lit(")")))
        .when(~done, F.concat(F.lit("too few messages to remove ("), number("removed"), F.lit(")")))
    )
    after = F.when(done, F.col("_kept_tokens") + tx.heuristic_tokens(F.col("summary")) + F.col("derived_tokens")).otherwise(F.col("tokens_before"))
    sessions = s.select(
        by, "n", "n_derived", "target", done.alias("compacted"), reason.alias("reason"), F.when(done, F.col("removed")).otherwise(0).cast("long").alias("removed"),
        "tokens_before", after.cast("long").alias("tokens_after"), F.when(done, F.col("summary")).otherwise("").alias("summary"),
    )
    row = lambda part: [by, F.lit(part).alias("part"), "idx", "role", "content"]
    shrunk = sessions.filter("compacted").select(F.col(by).alias("_by"))
    same = F.col(by).eqNullSafe(F.col("_by"))
    out = x.filter("derived").select(*row(0)).unionByName(x.filter("not derived").join(shrunk, same, "left_anti").select(*row(2)))
    out = out.unionByName(rows.filter("kept").join(shrunk, same, "left_semi").select(*row(2)))
    summary = sessions.filter("compacted").select(by, F.lit(1).alias("part"), F.lit(None).cast(messages.schema["idx"].dataType).alias("idx"), F.lit("user").alias("role"), F.col("summary").alias("content"))
    return Compaction(sessions, out.unionByName(summary))
