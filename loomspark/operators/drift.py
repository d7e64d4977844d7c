"""Topic drift over turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js

# --- fixed values -------------------------------------------------------------
STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during before after above "
    "below between under again further then once here there when where why how all both each few more most other some such no nor not only own same so than too very just about and but or if "
    "because until while this that these those it its i me my we our you your he she they them please also use using let get got one two make made need like now new see know think well back "
    "still way even much many really good ok okay yes yeah sure right going want put"
).split()
TECH = (
    "code bug fix deploy test refactor config error performance api database task version release review build docker kubernetes git ci cd pipeline server client frontend backend typescript "
    "javascript python rust java go function class module import export interface type component service endpoint request response token context memory session plugin gateway compaction "
    "budget encoding tiktoken drift node npm package dependency install update"
).split()
WORD = r"\b[a-z][a-z0-9\-_]{1,30}\b"
# ------------------------------------------------------------------------------


def turn_topics(messages: DataFrame, by: list[str], text: str = "content", most: int = 20) -> DataFrame:
    """(by..., keyword, weight): share of the turn's messages with the word, half as much again for technical words, the best ``most``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(js(WORD)), F.lit(0)))
    n = messages.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    x = messages.select(*by, F.explode(words).alias("keyword")).filter(~F.col("keyword").isin(STOP) & ((F.char_length("keyword") >= 3) | F.col("keyword").isin(TECH)))
    x = x.groupBy(*by, "keyword").agg(F.count(F.lit(1)).alias("_c")).join(n, by)
    boost = F.when(F.col("keyword").isin(TECH), 1.5).otherwise(1.0)
    x = x.withColumn("weight", F.least(F.lit(1.0), F.col("_c") / F.col("_n") * boost))
    w = Window.partitionBy(*by).orderBy(F.desc("weight"), "keyword")
    return x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select(*by, "keyword", "weight")


def cosine(a: Column, b: Column) -> Column:
    """G1: of two maps of weights; both empty 1, one empty 0."""
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
    size = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(dot / (size(a) * size(b)))


def drift(messages: DataFrame, session: str = "session_id", turn: str = "turn", warm_up: int = 5) -> DataFrame:
    """(session, turn, score, rolling, sudden) of every turn after the warm-up of so many messages."""
    seen = messages.groupBy(session, turn).agg(F.count(F.lit(1)).alias("_m"))
    topics = turn_topics(messages, [session, turn]).groupBy(session, turn).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", "weight")))).alias("topics"))
    order = Window.partitionBy(session).orderBy(turn)
    x = seen.join(topics, [session, turn], "left").withColumn("topics", F.coalesce("topics", F.create_map().cast("map<string,double>")))
    x = x.withColumn("_seen", F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_seen") >= warm_up)
    before = F.lag("topics").over(order)
    x = x.withColumn("score", F.when(before.isNull(), 0.0).otherwise(F.round(1 - cosine(F.col("topics"), before), 6)))
    x = x.withColumn("rolling", F.round(F.avg("score").over(order.rowsBetween(-2, 0)), 6))
    return x.select(session, turn, "score", "rolling", F.coalesce(F.abs(F.col("score") - F.lag("score").over(order)) > 0.3, F.lit(False)).alias("sudden"))


def alerts(scores: DataFrame, session: str = "session_id", turn: str = "turn", limit: float = 0.6, run: int = 3) -> DataFrame:
    """Turns at which ``run`` scores in a row were above the limit (the count begins again after an alert), with their level."""
    order = Window.partitionBy(session).orderBy(turn)
    x = scores.withColumn("_high", F.col("score") > limit).withColumn("_island", F.sum((~F.col("_high")).cast("int")).over(order))
    pos = F.row_number().over(Window.partitionBy(session, "_island", "_high").orderBy(turn))
    top = F.max("score").over(order.rowsBetween(-(run - 1), 0))
    x = x.withColumn("_pos", pos).withColumn("peak", top).filter(F.col("_high") & (F.pmod("_pos", F.lit(run)) == 0))
    level = F.when(F.col("peak") >= 0.7, "high").when(F.col("peak") >= 0.5, "medium").otherwise("low")
    return x.select(session, turn, "peak", level.alias("level"))


def suggested_action(rolling: Column) -> Column:
    """G7."""
    return F.when(rolling >= 0.7, "compact_and_refresh").when(rolling >= 0.5, "refresh_context").when(rolling >= 0.3, "monitor").otherwise("none")


def stage_changes(df: DataFrame, by: list[str], order: str, stage: str) -> DataFrame:
    """Adds ``boundary``: the stage differs from the last one that was given."""
    w = Window.partitionBy(*by).orderBy(order)
    prev = F.last(F.when(F.col(stage) != "", F.col(stage)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("boundary", F.coalesce((F.col(stage) != "") & (prev != F.col(stage)), F.lit(False)))


def repeats(df: DataFrame, by: list[str], order: str, same: list[str]) -> DataFrame:
    """Adds ``redo``: the row equals the one before it in these columns."""
    w = Window.partitionBy(*by).orderBy(order)
    eq = F.lit(True)
    for c in same:
        eq = eq & F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumn("redo", eq & (F.row_number().over(w) > 1))
