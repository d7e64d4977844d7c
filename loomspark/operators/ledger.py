"""Ledger aggregation: cost, quality, efficiency, usage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fold


def cost_summary(ledger: DataFrame, by: list[str] | None = None, since: int | None = None, until: int | None = None, version: str | None = None) -> DataFrame:
    """one row for each group: count, tokens in and out, saved, mean known share, window, versions."""
    x = ledger
    for keep in ([F.col("at") >= since] if since is not None else []) + ([F.col("at") <= until] if until is not None else []) + ([F.col("version") == version] if version else []):
        x = x.filter(keep)
    return x.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.greatest(F.lit(0), F.coalesce(F.sum("input_tokens") - F.sum("output_tokens"), F.lit(0))).alias("saved"), F.round(F.avg("share"), 4).alias("avg_share"),
        F.coalesce(F.min("at"), F.lit(0)).alias("first_at"), F.coalesce(F.max("at"), F.lit(0)).alias("last_at"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"),
    )


def compare(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Differences b - a of two one-row summaries; null where either is."""
    pick = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in columns])
    return pick(a, "a").join(pick(b, "b"), F.lit(True)).select("*", *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"delta_{c}") for c in columns])


def share_of(df: DataFrame, by: str, out: str = "share_pct") -> DataFrame:
    """count and percent (two places) of each value."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return g.withColumn(out, F.floor(F.col("n") * 10000 / total + 0.5) / 100)


def merge_counts(parts: DataFrame, counts: list[str], by: list[str] | None = None) -> DataFrame:
    """Sums of counts; rates are to be made again from them."""
    return parts.groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in counts])


def efficiency(checkpoints: DataFrame, session: str = "session_id", budget: int = 50000) -> DataFrame:
    """use of the budget by session and over all (null session), in one pass by ROLLUP."""
    use = F.col("input_tokens") / budget
    return checkpoints.rollup(session).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(use), 6).alias("avg_use"), F.round(F.max(use), 6).alias("peak_use"), F.max_by("share", F.struct("at", "event_id")).alias("last_share"), (F.max("at") - F.min("at")).alias("range_ms"))


def usage_turns(ledger: DataFrame, session: str = "session_id") -> DataFrame:
    """Turns numbered from one by time, with the merged use so far."""
    w = Window.partitionBy(session).orderBy("at", "event_id")
    return ledger.withColumn("turn", F.row_number().over(w)).withColumn("so_far", F.sum("input_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: list[str]) -> DataFrame:
    """For each left row the last right row of the key at its time or before: one sort of the union, no range join."""
    l = left.withColumn("_side", F.lit(1))
    r = right.select(by, at, F.struct(*value).alias("_v")).withColumn("_side", F.lit(0))
    x = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return x.select(*left.columns, *[F.col(f"_last.{c}").alias(f"last_{c}") for c in value])


def accepted(df: DataFrame, by: list[str], at: str, wanted: Column, cap: int = 5, wait_ms: int = 300_000) -> DataFrame:
    """The wanted rows that are accepted: the cap is not reached, and the last accepted one is not too near.

    Each decision depends on the last accepted one: an ordered fold, linear in the rows of a group.
    """
    x = df.filter(wanted).withColumn("_at", F.col(at).cast("long"))
    return fold.ordered_fold(x, by, ["_at"], ["_at"], lambda: fold.Cooldown(cap, wait_ms), {"_ok": ("boolean", pa.bool_())}).filter("_ok").drop("_at", "_ok")


def cooldown(df: DataFrame, by: list[str], at: str, wanted: Column, cap: int = 5, wait_ms: int = 300_000) -> DataFrame:
    """The accepted times of each group as one array (``accepted``), ``cap`` at most."""
    return accepted(df, by, at, wanted, cap, wait_ms).groupBy(*by).agg(F.array_sort(F.collect_list(F.col(at))).alias("accepted"))


def armed(turns: DataFrame, by: list[str], turn: str, fired: str, n: int = 3) -> DataFrame:
    """Adds ``armed``: fewer than n turns since the last one that fired."""
    w = Window.partitionBy(*by).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col(fired), F.col(turn))).over(w)
    return turns.withColumn("armed", F.coalesce(F.col(turn) - last < n, F.lit(False)))
