"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A table hashes a vector by ``k`` functions: each flips signs and applies the fast
Hadamard transform three times, and names the coordinate of largest size with
its sign. The vector is put in the bucket so named and in those reached by taking
the second largest coordinate in the function where that costs least
(multiprobe). Vectors that share a bucket are compared by their cosine in double
precision; a pair that shares several is counted in the first of them.

``k`` grows with the logarithm of the number of vectors, so that buckets stay
small; all rows are indexed. Equal vectors are one class. A bucket that is large
for all that is cut in chunks, and pairs of chunks are separate blocks, so no
task holds more than two chunks and nothing is capped. Blocks give, for each
vector, its number of links and the smallest id it is connected to there, never
pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .components import components


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def buckets(v: np.ndarray, tables: int, k: int, probes: int, seed: int) -> np.ndarray:
    """Bucket keys (rows, tables, probes) of unit vectors."""
    n, dim = v.shape
    wide = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :dim] = v
    rng = np.random.default_rng([seed, dim])
    out = np.zeros((n, tables, probes), dtype=np.int64)
    base = 2 * wide
    for t in range(tables):
        first, second, gap = [], [], []
        for _ in range(k):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], size=wide)) / math.sqrt(wide)
            size = np.abs(x)
            two = np.argpartition(-size, 1, axis=1)[:, :2] if wide > 2 else np.argsort(-size, axis=1)[:, :2]
            rows = np.arange(n)[:, None]
            swap = size[rows, two][:, 0] < size[rows, two][:, 1]
            two[swap] = two[swap][:, ::-1]
            code = 2 * two + (x[rows, two] > 0)
            first.append(code[:, 0])
            second.append(code[:, 1])
            gap.append(size[rows, two][:, 0] - size[rows, two][:, 1])
        order = np.argsort(np.stack(gap, axis=1), axis=1, kind="stable")
        for p in range(probes):
            key = np.full(n, dim * 1_000_003 + t, dtype=np.int64)
            for j in range(k):
                # Probe p takes the second choice where bit j of p is set, counting functions from the smallest gap.
                bit = np.zeros(n, dtype=bool)
                for b in range(min(k, 8)):
                    if p >> b & 1:
                        bit |= order[:, b] == j
                with np.errstate(over="ignore"):
                    key = key * base + np.where(bit, second[j], first[j])
            with np.errstate(over="ignore"):
                h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out[:, t, p] = (h ^ (h >> np.uint64(29))).astype(np.int64)
    return out


def unit(rows: list) -> tuple[list[int], list[np.ndarray]]:
    """Places and unit vectors of the rows that can link: not null, not zero, all components finite numbers."""
    at, out = [], []
    for i, r in enumerate(rows):
        if r is None or not len(r) or any(x is None for x in r):
            continue
        v = np.array(r, dtype=np.float64)
        size = math.sqrt(float(v @ v)) if np.isfinite(v).all() else 0.0
        if size > 0 and math.isfinite(size):
            at.append(i)
            out.append(v / size)
    return at, out


def _classes(rows: DataFrame) -> DataFrame:
    """(id, cls, v): the class of equal vectors, null for those that link with nothing; v are doubles of length 1."""

    def run(batches):
        for batch in batches:
            listed = batch.column(1).to_pylist()
            at, v = unit(listed)
            cls, vec = [None] * len(listed), [None] * len(listed)
            for i, x in zip(at, v):
                vec[i] = x.tobytes()
                cls[i] = hashlib.blake2b(vec[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(vec, pa.binary())], names=["id", "cls", "v"])

    return rows.mapInArrow(run, "id long, cls binary, v binary")


def _index(reps: DataFrame, tables: int, k: int, probes: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            keys = np.zeros((len(raw), tables * probes), dtype=np.int64)
            by: dict[int, list[int]] = {}
            for i, r in enumerate(raw):
                by.setdefault(len(r), []).append(i)
            for at in by.values():
                v = np.stack([np.frombuffer(raw[i]) for i in at])
                keys[at] = buckets(v, tables, k, probes, seed).reshape(len(at), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "keys"])

    return reps.select("id", "v").mapInArrow(run, "id long, keys array<long>")


def block_links(ids, mult, keys, v, chunk, key: int, pair: tuple[int, int], tables: int, threshold: float):
    """(id, links, root) of the members of a block that have links: counts weigh the other's copies."""
    one = pair[0] == pair[1]
    left = np.arange(len(ids)) if one else np.flatnonzero(chunk == pair[0])
    right = left if one else np.flatnonzero(chunk == pair[1])
    if not len(left) or not len(right):
        return None
    cos = v[left] @ v[right].T
    adj = cos >= threshold
    if one:
        adj &= left[:, None] != right[None, :]
    a, b = np.nonzero(adj)
    if not len(a):
        return None
    # Only the first bucket that two vectors share counts them: no smaller table, no smaller key in this table.
    ka, kb = keys[left[a]].reshape(len(a), tables, -1), keys[right[b]].reshape(len(b), tables, -1)
    same = (ka[:, :, :, None] == kb[:, :, None, :]).any(axis=3)  # by table and probe of the left one
    own = (ka == key) & same
    table = np.argmax(own.any(axis=2), axis=1)
    rows = np.arange(len(a))
    earlier = (same.any(axis=2) & (np.arange(tables)[None, :] < table[:, None])).any(axis=1)
    smaller = (same[rows, table] & (ka[rows, table] < key)).any(axis=1)
    a, b = a[~(earlier | smaller)], b[~(earlier | smaller)]
    if not len(a):
        return None
    i, j = left[a], right[b]
    if not one:
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
    links = np.bincount(i, weights=mult[j], minlength=len(ids)).astype(np.int64)
    root = np.array(ids)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        if (low == root).all():
            break
        root = low
    has = np.flatnonzero(links)
    return ids[has], links[has], root[has]


def _compare(members: DataFrame, tables: int, threshold: float, limit: int) -> DataFrame:
    """(id, links, root) of rows (key, lo, hi, id, mult, keys, v, chunk), which come sorted by block."""

    def settle(rows, out):
        ids, mult = np.array([r[3] for r in rows]), np.array([r[4] for r in rows], dtype=np.float64)
        keys, chunk = np.array([r[5] for r in rows]), np.array([r[7] for r in rows])
        dims: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            dims.setdefault(len(r[6]), []).append(i)
        for at in dims.values():
            if len(at) > 1:
                v = np.stack([np.frombuffer(rows[i][6]) for i in at])
                got = block_links(ids[at], mult[at], keys[at], v, chunk[at], rows[0][0], rows[0][1:3], tables, threshold)
                if got:
                    out.append(got)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r[:3] != held[0][:3]:
                    if len(held) > 1:
                        settle(held, out)
                    held = []
                held.append(r)
            if out:
                yield _batch(out)
        out = []
        if len(held) > 1:
            settle(held, out)
        if out:
            yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], names=["id", "links", "root"])

    return members.select("key", "lo", "hi", "id", "mult", "keys", "v", "chunk").mapInArrow(run, "id long, links long, root long")


def find(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, tables: int = 16, probes: int = 4, chunk: int = 512, seed: int = 11) -> DataFrame:
    """(key, n_links, component_id, kept) for every vector.

    Two vectors are linked if a shared bucket brings them together and their
    cosine is ``threshold`` or more; of pairs at 0.9 more than 99 in 100 are
    found. Null, empty and zero vectors, and those with a null or non-finite
    component, link with nothing, as do vectors of different lengths. Rows with a
    null key have a null component and are kept. Equal vectors are linked. Rows
    that share a key are counted as vectors of their own and share a component.
    An empty table gives an empty result. Other columns are not read.
    """
    every = stash(_classes(rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))), "vec-rows")
    full = every.filter("cls is not null and id is not null")
    cls = stash(full.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v")), "vec-classes")
    n = cls.count()
    wide = (cls.agg(F.max(F.octet_length("v"))).first()[0] or 8) // 8
    per = 2 * (1 << max(1, (wide - 1).bit_length()))
    k = max(1, math.ceil(math.log(max(n, 2) / 64) / math.log(per))) if n > 64 else 1
    # Classes that share a representative (rows of one key with different vectors) stay apart by their own number.
    node = cls.select(F.xxhash64("cls").alias("id"), "mult", "v", "rep", "cls")
    index = stash(_index(node, tables, k, probes, seed), "vec-index")
    sizes = index.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = index.select("id", F.explode(F.array_distinct("keys")).alias("key")).join(sizes, "key")
    placed = placed.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id", "key"), F.col("chunks")).cast("int"))
    blocks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = blocks.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "id", "chunk")
    data = node.select("id", "mult", "v").join(index, "id")
    members = blocks.join(data, "id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = stash(_compare(members, tables, threshold, chunk), "vec-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    named = node.select("id", "rep")
    edges = edges.join(named.withColumnRenamed("id", "a").withColumnRenamed("rep", "ra"), "a").join(named.withColumnRenamed("id", "b").withColumnRenamed("rep", "rb"), "b")
    shared = full.groupBy("id").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1")).filter("c0 <> c1").select("id")
    same_key = full.join(shared, "id").join(cls.select("cls", "rep"), "cls").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(same_key).distinct())
    per_class = node.join(links, "id", "left").select("cls", "rep", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    per_class = per_class.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("cls", "n_links", F.coalesce("component", "rep").alias("component_id"))
    out = every.select("id", "cls").join(per_class, "cls", "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
