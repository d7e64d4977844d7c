"""Confidence gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adaptive_threshold(mean: Column, std: Column, threshold: float = 0.5, pressure: float = 0.3) -> Column:
    """Lower for weak groups, a little higher for scattered ones; two places."""
    x = threshold - F.greatest(F.lit(0.0), threshold - mean) * pressure + F.least(0.1 * std, F.lit(0.05))
    return F.when(mean.isNull(), threshold).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 100 + 0.5) / 100)


def gate(df: DataFrame, by: list[str], score: str, tie: str, mode: str = "adaptive", threshold: float = 0.5, least: int = 0, pressure: float = 0.3) -> DataFrame:
    """Rows that pass, with the threshold of their group; the best failing rows make up ``least``."""
    w = Window.partitionBy(*by)
    limit = {"strict": F.lit(threshold), "disabled": F.lit(0.0), "adaptive": adaptive_threshold(F.avg(score).over(w), F.stddev_pop(score).over(w), threshold, pressure)}[mode]
    x = df.withColumn("threshold", limit)
    x = x.withColumn("_ok", F.lit(True) if mode == "disabled" else F.col(score) >= F.col("threshold"))
    x = x.withColumn("_passed", F.count_if("_ok").over(w)).withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_ok").orderBy(F.desc(score), tie)))
    return x.filter(F.col("_ok") | (F.col("_rank") <= least - F.col("_passed"))).drop("_ok", "_passed", "_rank")


def report(df: DataFrame, by: list[str], score: str, missing: str, threshold: float = 0.5, pressure: float = 0.3) -> DataFrame:
    """Items, passed, mean, threshold, missing scores and dropped items of each group, in one aggregation and a second count."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("_std"), F.count_if(missing).alias("missing"), F.collect_list(score).alias("_scores"))
    g = g.withColumn("threshold", adaptive_threshold(F.col("mean"), F.col("_std"), threshold, pressure))
    passed = F.size(F.filter("_scores", lambda s: s >= F.col("threshold")))
    return g.select(*by, "total", passed.cast("long").alias("passed"), F.round("mean", 6).alias("mean"), "threshold", "missing", (F.col("total") - passed).alias("dropped"))


def legacy_filter(df: DataFrame, score: str = "score", least: float = 0.3) -> DataFrame:
    """B2: rows of a score of at least 0.3, where no gate is set."""
    return df.filter(F.col(score) >= least)
