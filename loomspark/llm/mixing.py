"""Mixing sources to target weights by Sainte-Lague apportionment.

The corpus is seen as equal-token blocks. Blocks go to the sources one by one by
highest quotient ``weight / (2 * seats + 1)``; the seats of a source are then
apportioned to its shards by the same rule, which gives each shard an integer
quota. In a shard the documents stand in a seeded order; the quota takes blocks
from the front of it, and begins again when the shard is used up.

Everything is DataFrame code. Awarding seats one at a time would be a loop, so
``apportion`` finds the same outcome directly: two divisors bracket the number
of seats of each party to within the number of parties, and only the quotients
between the brackets are listed and ranked.

Scale: one pass reduces documents to (id, source, size); all later work is on
that or on aggregates. The only window over documents is inside a shard, and
shards hold ``rows_per_shard`` documents until a source has ``max_shards`` of
them, so a source with a third of all rows is spread over as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stash


def apportion(df: DataFrame, group: list[str], weight: str, seats: Column, order: list[str], out: str) -> DataFrame:
    """Seats by highest quotients ``weight / (2 s + 1)`` among the rows of each group.

    ``seats`` is the number to award in the group; ties go by ``order``. Rows of
    weight 0 get none. Every seat is awarded if any weight is positive.
    """
    w = Window.partitionBy(*group)
    x = df.withColumn("_seats", seats.cast("long")).withColumn("_p", F.sum(weight).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    # With p / (N - n/2) as divisor no more than N seats are given, with p / (N + n/2) no fewer.
    low = F.greatest(F.lit(0), F.floor((F.col("_seats") - F.col("_n") / 2) * F.col(weight) / F.col("_p") + 0.5) - 1)
    high = F.floor((F.col("_seats") + F.col("_n") / 2) * F.col(weight) / F.col("_p") + 0.5) + 1
    x = x.withColumn("_lo", F.when(F.col(weight) > 0, low).otherwise(0).cast("long")).withColumn("_hi", F.when(F.col(weight) > 0, high).otherwise(0).cast("long"))
    x = x.withColumn("_left", F.col("_seats") - F.sum("_lo").over(w))
    more = x.filter("_hi > _lo").withColumn("_s", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
    ranked = more.withColumn("_r", F.row_number().over(w.orderBy(F.desc(F.col(weight) / (2 * F.col("_s") + 1)), *order, "_s")))
    won = ranked.filter("_r <= _left").groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_won"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in dict.fromkeys([*group, *order])]
    joined = x.alias("a").join(won.alias("b"), on, "left")
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._lo") + F.coalesce(F.col("b._won"), F.lit(0))).cast("long").alias(out))


def source_targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Targets of sources: shares of the total by weight, at most ``max_epochs`` times a source's size.

    Input (source, source_size, weight). The shares of sources at their cap are
    reshared until none is above; that is a level ``l`` with target
    ``min(cap, l * weight)``, found from running sums over the sources by cap / weight.
    """
    every = Window.partitionBy(F.lit(0))
    by = every.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    x = sources.withColumn("_cap", max_epochs * F.col("source_size").cast("double")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    x = x.withColumn("_total", F.sum("source_size").over(every).cast("double")).withColumn("_caps", F.coalesce(F.sum("_cap").over(by), F.lit(0.0)))
    x = x.withColumn("_rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by), F.lit(0)))
    x = x.withColumn("_level", (F.col("_total") - F.col("_caps")) / F.col("_rest"))
    # The first source, by cap / weight, that the level doesn't lift above its cap: those before it are at their caps.
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_n", "_level"))).over(every)
    x = x.withColumn("_n", F.row_number().over(every.orderBy("_ratio", F.col("source").asc_nulls_last()))).withColumn("_at", first["_level"])
    capped = F.col("_at").isNull() | (F.col("_cap") <= 0) | (F.col("_at") * F.col("weight") >= F.col("_cap"))
    return x.select("source", "source_size", "weight", F.when(capped, F.col("_cap")).otherwise(F.col("_at") * F.col("weight")).alias("target"), capped.alias("capped"))


def mix(
    docs: DataFrame, weights: Column | None = None, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 17,
    max_epochs: int = 3, rows_per_shard: int = 64, max_shards: int = 1024, block_tokens: int | None = None,
) -> DataFrame:
    """Words that the mix takes of each document.

    Returns (doc_id, size, source, source_size, target, taken, capped, shard, blocks): ``taken``
    counts repeats and is at most ``max_epochs * size``. ``weights`` is a column of
    the rank ``_rank`` (0, 1, ...) of a source by code point, null last; by default
    1, 2, 3, repeating. ``block_tokens`` defaults to a 65,536th of all words, 1 at
    least and 1,024 at most.

    Null texts and texts without words have size 0 and get 0. A null source is a
    source. An empty table gives an empty result. Rows that share a doc_id are
    separate documents. Other columns are not read, whatever their names.
    """
    sized = stash(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size")), "mix-sizes")
    # Spark compares strings by their UTF-8 bytes, which is the order of code points.
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    ranked = per.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", (weights if weights is not None else F.pmod("_rank", F.lit(3)) + 1))
    target = source_targets(ranked.select("source", "source_size", "weight"), max_epochs)
    every = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(every)
    block = F.lit(block_tokens) if block_tokens else F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(total / 65536)))
    target = target.withColumn("block", block.cast("long")).withColumn("_blocks", F.round(total / F.col("block")).cast("long")).withColumn("_all", F.lit(0))
    quota = apportion(target, ["_all"], "target", F.col("_blocks"), ["source"], "seats")
    a, b = quota.alias("a"), per.select("source", "_docs").alias("b")
    quota = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", F.least(F.lit(max_shards), F.ceil(F.col("b._docs") / rows_per_shard)).cast("int").alias("shards"))
    quota = stash(quota.select("source", "source_size", "target", "capped", "block", "seats", "shards"), "mix-quotas")

    d, q = sized.alias("d"), quota.alias("q")
    placed = d.join(q, F.col("d.source").eqNullSafe(F.col("q.source"))).select("d.*", "q.source_size", "q.target", "q.capped", "q.block", "q.seats", "q.shards")
    placed = placed.withColumn("_h", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("shard", F.pmod("_h", F.col("shards")).cast("int"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"), F.first("block").alias("block"))
    shards = apportion(shards, ["source"], "shard_size", F.col("seats"), ["shard"], "blocks")
    tokens = F.least(F.col("blocks") * F.col("block"), max_epochs * F.col("shard_size"))
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "blocks", tokens.alias("tokens"))

    in_shard = Window.partitionBy("source", "shard").orderBy(F.xxhash64("_h", F.lit(seed)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("_end", F.sum("size").over(in_shard))
    x = laid.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    epochs = F.floor(F.col("tokens") / F.greatest(F.col("shard_size"), F.lit(1)))
    rest = F.col("tokens") - epochs * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_end") - F.col("size"))))
    taken = F.when(F.col("capped"), max_epochs * F.col("size")).otherwise(epochs * F.col("size") + part)
    return x.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), "capped", "shard", "blocks")
