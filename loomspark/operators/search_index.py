"""A stored search index (A4, L1): postings in blocks with their best weight, searched with early ending, filters, and vectors.

``build`` reads and tokenizes the items once. A posting holds its BM25 weight (all
but the term's rarity) and the attributes that filters ask for. Postings of a term
are grouped by weight level and a hash of the id into blocks of bounded size, so a
word that stands in every item is as many rows as there are blocks, in any number of
tasks. The folder is partitioned by a bucket of the term.

``search`` reads the buckets of the queries' terms alone, twice. First just the
blocks of each term's highest level: their sums are lower bounds of scores, and the
k-th best one is a score that the k best reach in any case. A posting can belong to
one of the k best only if its own part and the most that the query's other terms can
give reach that score; blocks whose best weight doesn't are left closed. All postings
of the k best pass that test, so their sums are whole and the result is the same as
that of a scan of everything.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = r"[^\p{L}\p{N}]+"
#: Term weights are below k1 + 1; a level is a quarter.
LEVELS_PER_UNIT = 4
#: Scores are compared with this much to spare, since sums of doubles depend on their order.
SLACK = 1e-5
#: Terms of queries, in rows, up to which they are broadcast; vectors of queries, in numbers, that are held at once.
BROADCAST_TERMS, HELD_NUMBERS = 500_000, 4_000_000
#: Items whose postings of a bucket one task writes.
SLICE_ITEMS = 1_000_000


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


@dataclass(frozen=True)
class SearchIndex:
    """An index in a folder; ``attrs`` are the columns that filters can use."""

    spark: SparkSession
    path: str
    attrs: tuple[str, ...] = ()
    buckets: int = 64
    k1: float = 1.2
    b: float = 0.75

    def build(self, items: DataFrame, block: int = 1024) -> "SearchIndex":
        """Write the index of items (id, content, attrs...); ids are distinct."""
        # each item's rows stay together from here on: its words are counted without another exchange
        bag = items.repartition("id").select("id", *self.attrs, words("content").alias("_w")).filter(F.size("_w") > 0)
        # before the words are parted: expressions beside an explode are evaluated for each of its rows, here over the whole text
        bag = bag.select("id", *self.attrs, F.size("_w").alias("len"), F.array_min("_w").alias("_least"), "_w").select("id", *self.attrs, "len", "_least", F.explode("_w").alias("term"))
        counts = bag.groupBy("id", *self.attrs, "len", "term", (F.col("term") == F.col("_least")).alias("lead")).agg(F.count(F.lit(1)).alias("tf"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts")
        counts = self.spark.read.schema(counts.schema).parquet(f"{self.path}/counts")
        n, mean = counts.filter("lead").agg(F.count(F.lit(1)), F.avg("len")).first()
        weight = F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("len") / F.lit(mean or 1.0)))
        slices = 1 + n // SLICE_ITEMS
        x = counts.select("term", "id", *self.attrs, weight.alias("w"), F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket"), F.pmod(F.xxhash64("id"), F.lit(max(1, n // block))).alias("part"))
        # one exchange: a block's postings meet where they are written; buckets of a large corpus are cut in slices of its items
        x = x.withColumns({"level": F.floor(F.col("w") * LEVELS_PER_UNIT).cast("int"), "slice": F.pmod("part", F.lit(slices))}).repartition(self.buckets * slices, "bucket", "slice")
        blocks = x.groupBy("bucket", "slice", "term", "level", "part").agg(F.max("w").alias("top"), F.collect_list(F.struct("id", "w", *self.attrs)).alias("entries")).drop("slice")
        blocks.sortWithinPartitions("bucket", "term", F.desc("top")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        terms = self._read("postings").groupBy("bucket", "term").agg(F.sum(F.size("entries")).alias("df"), F.max("top").alias("top"), F.max("level").alias("level"))
        terms = terms.withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        terms.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms")
        return self

    def _read(self, table: str) -> DataFrame:
        """A partitioned table, which has no file to tell its columns when it is empty."""
        kinds = {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(f"{self.path}/counts").schema}
        entry = ", ".join(f"{c}: {kinds[c]}" for c in ("id", *self.attrs)).replace(",", ", w: double,", 1) if self.attrs else f"id: {kinds['id']}, w: double"
        schemas = {"postings": f"term string, level int, part long, top double, entries array<struct<{entry}>>, bucket int", "terms": "term string, df long, top double, level int, idf double, bucket int"}
        return self.spark.read.schema(schemas[table]).parquet(f"{self.path}/{table}")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, bucket, idf, level, other): the known terms of each query, and the most that its other terms can give."""
        q = queries.select("query_id", F.explode(F.array_distinct(words("query"))).alias("term")).distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        found = q.join(self._read("terms"), ["bucket", "term"])
        most = F.sum(F.col("idf") * F.col("top")).over(Window.partitionBy("query_id"))
        return found.select("query_id", "term", "bucket", "idf", "level", (most - F.col("idf") * F.col("top")).alias("other"))

    def _hits(self, asked: DataFrame, blocks: DataFrame, where: Callable[[Column], Column] | None, need: Column) -> DataFrame:
        """(query_id, id, score) of the postings whose weight is ``need`` (of a term of ``asked``) at least.

        A block that some query needs moves once, to the other blocks of its part of the items. There its postings are
        summed up for each query, so that pairs of queries and items, far more than postings, never move.
        """
        few = asked.count() <= BROADCAST_TERMS
        near = F.broadcast if few else lambda df: df
        asked = asked.select("query_id", "bucket", "term", "idf", need.alias("need"))
        x = blocks.join(near(asked.groupBy("bucket", "term").agg(F.min("need").alias("_least"))), ["bucket", "term"]).filter(F.col("top") >= F.col("_least"))
        ok = (lambda e: (e["w"] >= F.col("_least")) & where(e)) if where else (lambda e: e["w"] >= F.col("_least"))
        x = x.select("bucket", "term", "part", "top", F.transform(F.filter("entries", ok), lambda e: F.struct(e["id"].alias("id"), e["w"].alias("w"))).alias("entries"))
        x = x.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "part")  # few bytes, but many sums: not to be merged into few tasks
        x = x.join(near(asked), ["bucket", "term"]).filter(F.col("top") >= F.col("need"))
        x = x.select("query_id", "part", "idf", "need", F.explode("entries").alias("e")).filter(F.col("e.w") >= F.col("need"))
        return x.groupBy("query_id", "part", F.col("e.id").alias("id")).agg(F.sum(F.col("idf") * F.col("e.w")).alias("score")).drop("part")

    def search(self, queries: DataFrame, k: int = 20, where: Callable[[Column], Column] | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k best items of each query (query_id, query); ``where`` tests an entry's attributes."""
        asked = self._asked(queries)
        path = f"{self.path}/asked-{uuid.uuid4().hex}"  # results are read later, so each search keeps its own
        asked.write.parquet(path)
        asked = self.spark.read.schema(asked.schema).parquet(path)
        wanted = [r[0] for r in asked.select("bucket").distinct().collect()]  # as many as there are buckets
        blocks = self._read("postings").filter(F.col("bucket").isin(wanted))
        first = self._hits(asked, blocks, where, F.col("level") / LEVELS_PER_UNIT)
        bound = _best(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_bound"))
        bounded = asked.drop("level").join(bound, "query_id", "left").withColumn("_bound", F.coalesce("_bound", F.lit(0.0)) - SLACK)
        hits = self._hits(bounded, blocks, where, (F.col("_bound") - F.col("other")) / F.col("idf"))
        return _best(hits.withColumn("score", F.round("score", 6)), k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, score, rank) of the k vectors (id, vector) of highest cosine to each query (query_id, vector).

    Queries are held by every task, a bounded number at once; each task gives its own
    k best for each, and the best of those are taken. Zero and null vectors match nothing.
    """
    width = queries.agg(F.max(F.size("vector"))).first()[0] or 1
    parts = max(1, -(-queries.count() * width // HELD_NUMBERS))
    out = None
    for p in range(parts):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).filter("vector is not null")
        rows = part.collect()  # bounded by HELD_NUMBERS
        near = vectors.filter("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_scan([r["query_id"] for r in rows], [list(r["vector"]) for r in rows], k), "query_id long, id long, score double")
        out = near if out is None else out.unionByName(near)
    return _best(out.withColumn("score", F.round("score", 6)), k)


def _scan(ids: list[int], wanted: list[list[float]], k: int):
    def unit(x: np.ndarray) -> np.ndarray:
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, size, out=np.full_like(x, np.nan), where=size > 0)

    q = unit(np.array(wanted, np.float64)) if ids else None

    def run(batches):
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for batch in batches:
            if not batch.num_rows or not ids:
                continue
            names = batch.column(0).to_pylist()
            lists = batch.column(1)
            if (np.diff(np.asarray(lists.offsets)) != q.shape[1]).any():
                raise ValueError("vectors must have the width of the queries")
            cos = np.round(unit(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)) @ q.T, 6)
            for j in range(len(ids)):
                column = cos[:, j]
                some = np.flatnonzero(~np.isnan(column))
                if len(some) > k:  # all that tie with the k-th stay, so that ids can settle ties
                    limit = np.partition(column[some], -k)[-k]
                    some = some[column[some] >= limit]
                best[j] = sorted([*best[j], *((-column[i], names[i]) for i in some)])[:k]
        rows = [(q_id, i, -s) for q_id, found in zip(ids, best) for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "score"])

    return run


def fuse(rankings: list[DataFrame], k: int = 20, constant: int = 60) -> DataFrame:
    """(query_id, id, score, rank): rankings (query_id, id, rank) joined by the sum of 1 / (constant + rank)."""
    parts = [r.select("query_id", "id", (1.0 / (constant + F.col("rank"))).alias("s")) for r in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return _best(every.groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score")), k)
