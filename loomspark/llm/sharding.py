"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Documents fall into logical partitions by a hash of their key, which does not
depend on how Spark happened to split the input, so a lost task gives the same
rows again. For each partition the numbers of its documents that go to each
shard are drawn from the multivariate hypergeometric distribution, given the
shards' sizes: exactly the counts that a uniform shuffle of all rows would give.
Each partition is permuted, its rows are cut by its row of the matrix, sent to
their shard and permuted again there.

Scale: the matrix has at most ``max_partitions`` x shards integers, whatever the
input. A shard is not one task: its second permutation is cut by ranges of the
random key into ``pieces`` whose counts give the slot of their first row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of partition p for shard s: each column sums to a shard's size, sizes at most one apart."""
    rng = np.random.default_rng(seed)
    total = int(sum(counts))
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        # numpy's generator takes populations under 10^9
        out[p] = rng.multivariate_hypergeometric(left, n, method="marginals") if left.sum() < 10**9 else _draw(rng, left, n)
        left -= out[p]
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """The same for any population: shard by shard, each given those before it."""
    out, rest = np.zeros(len(left), dtype=np.int64), int(left.sum())
    for s, good in enumerate(left.tolist()):
        rest -= good
        out[s] = _hypergeometric(rng, good, rest, n)
        n -= int(out[s])
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``good`` + ``bad`` are good, by inversion outwards from the mode.

    Probabilities are relative to the mode's, from exact ratios of neighbours, so no
    large factorials are needed. Beyond 10 standard deviations they are below 1e-21,
    out of a double's reach. The work follows the standard deviation, not the rows.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = int(10 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))) + 30
    up = np.arange(mode, min(high, mode + spread), dtype=np.float64)
    down = np.arange(mode, max(low, mode - spread), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weight = np.concatenate([below[::-1], [1.0], above])
    upto = np.cumsum(weight)
    return mode - len(below) + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def shuffle(df: DataFrame, keys: list[str], shards: int = 40, seed: int = 23, rows_per_partition: int = 256, max_partitions: int = 4096, pieces: int = 16) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard) to every row.

    ``keys`` are the columns that tell rows apart; rows equal in all of them are
    interchangeable and pass through one partition. Shards' row counts are at most
    one apart. Null keys hash like any value. An empty table gives an empty result.
    Columns named shard or slot are replaced; all others stay, whatever their names.
    Larger inputs are cut in more pieces; that changes slots, not shards or the law.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    own = [f"row.`{c}`" for c in keys]
    x = stash(df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.xxhash64(*keys, F.lit(seed)).alias("h")), "shuffle-in")
    rows = x.count()
    parts = int(max(8, min(max_partitions, rows // rows_per_partition)))
    x = x.withColumn("p", F.pmod("h", F.lit(parts)).cast("int"))
    counts = {r["p"]: r["count"] for r in x.groupBy("p").count().collect()}  # at most max_partitions rows
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    ends = spark.createDataFrame([(p, [int(v) for v in np.cumsum(matrix[p])]) for p in range(parts)], "p int, ends array<long>")
    local = Window.partitionBy("p").orderBy(F.xxhash64("h", F.lit(1)), *own)
    x = x.withColumn("r", F.row_number().over(local) - 1).join(ends, "p")
    x = x.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("r"))).cast("int"))
    x = stash(x.select("row", "shard", F.xxhash64("h", "shard", F.lit(2)).alias("k")), "shuffle-out")
    # Pieces are ranges of the random key: the slot of a row is the rows of the pieces before its own plus its rank in it.
    n_pieces = max(1, min(4096, rows // (shards * 128) or 1, pieces if rows < 10**7 else 4096))
    x = x.withColumn("piece", F.pmod(F.shiftrightunsigned("k", 1), F.lit(n_pieces)).cast("int"))
    sizes = x.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("shard", "piece").orderBy("k", *own)
    x = x.withColumn("r", F.row_number().over(inner) - 1).join(sizes, ["shard", "piece"])
    return x.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "shard", (F.col("before") + F.col("r")).cast("long").alias("slot"))
