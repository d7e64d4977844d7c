"""What caches hold, as tables: entries alive at a time, and streams without what was seen lately."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alive(puts: DataFrame, by: list[str], now: int, ttl_ms: int, capacity: int, key: str = "key", at: str = "at") -> DataFrame:
    """L4: the entries of caches (by..., key, at) at ``now``: each key's last put, not older than the time to live, the newest ``capacity``."""
    g = puts.filter(F.col(at) <= now).groupBy(*by, key).agg(F.max(at).alias(at)).filter(F.col(at) > now - ttl_ms)
    w = Window.partitionBy(*by).orderBy(F.desc(at), key)
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= capacity)


def preloaded(puts: DataFrame, invalidations: DataFrame, task: str, now: int, ttl_ms: int = 60_000, at: str = "at") -> DataFrame:
    """Each task's last preload, unless it is too old or was invalidated later (a null task invalidates all)."""
    last = puts.groupBy(task).agg(F.max(at).alias(at)).filter(F.col(at) > now - ttl_ms)
    everything = invalidations.filter(F.col(task).isNull()).agg(F.max(at).alias("_all"))
    own = invalidations.filter(F.col(task).isNotNull()).groupBy(task).agg(F.max(at).alias("_own"))
    x = last.join(own, task, "left").join(F.broadcast(everything), F.lit(True))  # one row
    return x.filter(F.coalesce(F.col(at) > F.greatest("_own", "_all"), F.lit(True))).select(task, at)


def unseen(stream: DataFrame, keys: list[str], at: str = "ts", ttl: str = "30 seconds") -> DataFrame:
    """L4 on streams: rows whose keys have not come within the time to live; state goes with the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def emit(rows: DataFrame, name: str, path: str) -> None:
    """Append rows as named events."""
    rows.select(F.lit(name).alias("event"), F.to_json(F.struct(*rows.columns)).alias("payload")).write.mode("append").parquet(path)
