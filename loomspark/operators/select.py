"""Ranking, top-k and budgeted selection."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fold


def budget_prefix(df: DataFrame, by: list[str], score: str, tokens: str, tie: str, budget: Column) -> DataFrame:
    """The longest prefix, by falling score, whose tokens fit the budget; adds ``running``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(tokens).over(w)).filter(F.col("running") <= budget)


def greedy_fill(df: DataFrame, by: list[str], idx: str, score: str, tokens: str, budget: int, min_keep: int = 20) -> DataFrame:
    """Keeps the newest ``min_keep``, then older rows by falling score, skipping those that don't fit. Adds ``kept``.

    The choice depends on those before it: an ordered fold, linear in the rows of a group.
    """
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(idx)))
    x = df.repartition(*by).withColumn("_new", newest <= min_keep)
    out = fold.ordered_fold(x, by, [F.desc("_new"), F.desc(score), F.asc(idx)], ["_new", tokens], lambda: fold.GreedyFill(budget), {"kept": ("boolean", pa.bool_())}, dealt=True)
    return out.drop("_new")


def suffix_keep(df: DataFrame, by: list[str], idx: str, tokens: str, target: int, least: int = 20) -> DataFrame:
    """One row for each group: n, total, keep_from (rows from there on are kept), kept tokens."""
    back = Window.partitionBy(*by).orderBy(F.desc(idx)).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(idx)) - 1
    x = df.withColumn("_run", F.sum(tokens).over(back)).withColumn("_pos", place)
    g = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("total"), F.max(F.when(F.col("_run") > target, F.col("_pos"))).alias("_over"))
    cut = F.least(F.col("n"), F.greatest(F.lit(least), F.col("_over") + 1))
    return g.select(*by, "n", "total", F.when(F.col("_over").isNull(), 0).otherwise(cut).cast("long").alias("keep_from"))


def chunked_fill(df: DataFrame, by: list[str], idx: str, tokens: str, budget: int, chunk: int = 100, share: float = 0.9) -> DataFrame:
    """Rows in order, ``chunk`` at a time; each is kept while its chunk's kept tokens stay within ``share`` of what is left of the budget. Adds ``chunk``, ``kept``.

    Each decision depends on those before it: an ordered fold, linear in the rows of a group.
    """
    x = df.select(*by, idx, F.col(tokens).cast("long").alias(tokens))
    adds = {"chunk": ("long", pa.int64()), "kept": ("boolean", pa.bool_())}
    return fold.ordered_fold(x, by, [F.asc(idx), F.asc(tokens)], [tokens], lambda: fold.ChunkedFill(budget, chunk, share), adds)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: Column | int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group by explicit order (give a tiebreak); k may be a column."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def reorder_balanced(df: DataFrame, by: list[str], idx: str, importance: str, floor: float = 0.1) -> DataFrame:
    """Adds ``place``: the first two of the three most important rows go to the head, the third to the tail; only in groups of more than three."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(importance), idx))
    x = df.withColumn("_n", n).withColumn("_key", (rank <= 3) & (F.col(importance) > floor) & (F.col("_n") > 3))
    order = F.row_number().over(Window.partitionBy(*by, "_key").orderBy(idx))
    x = x.withColumn("_section", F.when(~F.col("_key"), 1).when(order <= 2, 0).otherwise(2))
    return x.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_section", idx)) - 1).drop("_n", "_key", "_section")


def sliding_subsample(df: DataFrame, by: list[str], idx: str, budget: int) -> DataFrame:
    """The first row, the last 60 % of the budget, and every step-th of those between; all rows of groups within the budget."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(idx)) - 1)
    tail = int(budget * 0.6)
    middle = budget - tail - 1
    step = F.greatest(F.lit(1), F.ceil((F.col("_n") - tail - 1) / max(1, middle)))
    keep = (F.col("_n") <= budget) | (F.col("_i") == 0) | (F.col("_i") >= F.col("_n") - tail) | (F.pmod(F.col("_i") - 1, step) == 0)
    return x.filter(keep).drop("_n", "_i")


def uniform_subsample(items: Column, rate: float) -> Column:
    """Every ceil(1 / rate)-th element of an array."""
    step = max(1, -(-1 // rate))
    return F.filter(items, lambda x, i: F.pmod(i, F.lit(int(step))) == 0)


def capacity_cut(df: DataFrame, by: list[str], tokens: str, worst_first: list[str], most: int) -> DataFrame:
    """Drops the smallest by ``worst_first`` until the tokens of the group fit."""
    best = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in worst_first]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_run", F.sum(tokens).over(best)).filter(F.col("_run") <= most).drop("_run")
