"""MinHash near-dedup by chosen-path set similarity join.

Each distinct shingle set is embedded as ``coords`` min-wise hashes. A tree sends
a set down the branches named by the minima it holds at chosen coordinates: its
root branches on one coordinate, and every node that stays large branches on
``fan`` more that its path selects. Sets that meet in a small node are compared
exhaustively. Trees are independent; with the defaults a pair at the threshold of
0.8 misses all of them with a probability below one in a hundred thousand.

Sets equal to one another are one class, so exact copies cost one set. Links
are first sought between the members of a node and its smallest member, which
joins large groups of near copies without listing their pairs; nodes whose
members are all in one component by then have nothing left to say. In the
others members of different components are compared: in small nodes pair by
pair; large ones branch, and those that branching doesn't part (groups of like
sets) are compared in blocks that hold whole sets and give only the links that
join components. All trees do so, whatever the size of a node.

Rows that share a key and differ in text keep a signature and a set for each of
their texts; what links one of these links the document.

An estimate from the embedded coordinates, five standard deviations below the
threshold, drops pairs before the exact check on the whole sets.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, lean, slices, stash
from .components import components

WORDS = re.compile(WORD)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Ids up to this number may be broadcast to pick out texts; more are joined by shuffle.
BROADCAST_IDS = 200_000
_REMEMBER = 150_000
#: Shingles of texts that a worker remembers while it checks pairs.
_REMEMBER_SHINGLES = 100_000


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    """Distinct k-word shingles of the lower-cased words; the whole sequence as one if it is shorter; none without words."""
    words = WORDS.findall(text.translate(LOWER)) if text else []
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)}


def linked(a: set, b: set, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; empty sets are linked with nothing."""
    if not a or not b:
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def embed(docs: DataFrame, shingle: int, coords: int, seed: int) -> DataFrame:
    """(id, cls, n, sig): class of equal sets, set size, and min-wise hashes of each row of (id, text); null class for empty sets."""

    @lean
    def run(batches):
        rng = np.random.default_rng(seed)
        spread = rng.integers(1, 2**63, size=coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        step = rng.integers(1, 2**63, size=shingle, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        known: dict[str, int] = {}
        for batch in slices(batches):
            cls, n, sig = [], [], []
            for text in batch.column(1).to_pylist():
                words = WORDS.findall(text.translate(LOWER)) if text else []
                if not words:
                    cls.append(None)
                    n.append(0)
                    sig.append(None)
                    continue
                if len(known) > _REMEMBER:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
                m = max(1, len(h) - shingle + 1)
                total = np.full(m, np.uint64(min(len(h), shingle)), dtype=np.uint64)
                for j in range(min(shingle, len(h))):
                    total = _mix(total + h[j : j + m] * step[j])
                own = np.unique(total)
                low = np.full(coords, np.uint64(2**64 - 1), dtype=np.uint64)
                for i in range(0, len(own), 2048):
                    low = np.minimum(low, (own[i : i + 2048, None] * spread[None, :]).min(axis=0))
                cls.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                n.append(len(own))
                sig.append((_mix(low) & np.uint64(0x7FFFFFFF)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], names=["id", "cls", "n", "sig"])

    return docs.mapInArrow(run, "id long, cls binary, n long, sig array<int>")


def _close(pairs: DataFrame, sigs: DataFrame, coords: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose coordinates agree often enough."""
    p = percent / 100
    least = coords * p - 5 * (coords * p * (1 - p)) ** 0.5
    a, b = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").filter(same >= least).select("a", "b").distinct()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of (id, text) with an id of ``ids``."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked, by their whole sets."""
    ids = stash(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "dup-ids")
    texts = stash(_texts(docs, ids), "dup-texts")
    a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    @lean
    def run(batches):
        met: dict[str, set] = {}
        held = 0
        for batch in slices(batches):
            keep = []
            for i, (ta, tb) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                sb = met.get(tb)
                if sb is None:
                    if held > _REMEMBER_SHINGLES:
                        met.clear()
                        held = 0
                    sb = met[tb] = shingle_set(tb, shingle)
                    held += len(sb) + 1
                if linked(shingle_set(ta, shingle), sb, percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, trees: int = 10, fan: int = 3, coords: int = 64, leaf: int = 24, depth: int = 4, chunk: int = 1024, seed: int = 5) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their
    sets of distinct ``shingle``-word shingles (A-Z lower-cased); one with fewer
    words has its whole sequence as its one shingle. ``component_id`` is the
    smallest key reachable by links, ``kept`` whether it is the document's own.
    Null texts and texts without words have no set and link with nothing. Rows
    that share a key are one document. Rows with a null key link with nothing and
    have a null component; they are kept. An empty table gives an empty result.
    Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    every = stash(embed(rows, shingle, coords, seed), "dup-sets")
    full = every.filter("cls is not null and id is not null")
    classes = full.groupBy("cls").agg(F.min("id").alias("rep"))
    sigs = stash(full.join(classes, (full["cls"] == classes["cls"]) & (full["id"] == classes["rep"]), "left_semi").dropDuplicates(["id", "cls"]).select("id", "sig"), "dup-reps")

    roots = F.array(*[F.xxhash64(F.lit(seed), F.lit(r), F.col("sig")[r]) for r in range(trees)])
    node = stash(sigs.select("id", F.posexplode(roots).alias("tree", "node")), "dup-nodes")
    size = node.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).filter("size > 1")
    node = stash(node.join(size, "node"), "dup-nodes")

    star = node.filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    links = stash(_confirm(stash(_close(star, sigs, coords, percent), "dup-pairs"), rows, shingle, percent), "dup-links")
    comp = stash(components(links.union(_same_key(full, classes))), "dup-comps")

    def placed(x: DataFrame) -> DataFrame:
        """Members of nodes with more than one component, with theirs."""
        x = x.select("node", "tree", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        s = x.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("node", "size")
        return x.join(s, "node")

    level = stash(placed(node), "dup-level")
    pairs, blocks = None, None
    for d in range(depth + 1):
        found = _small(level.filter(F.col("size") <= leaf))
        pairs = found if pairs is None else pairs.union(found)
        large = level.filter(F.col("size") > leaf)
        if large.isEmpty():
            break
        picks = F.array(*[F.pmod(F.xxhash64("node", F.lit(seed + 1), F.lit(j)), F.lit(coords)).cast("int") for j in range(fan)])
        child = large.select("node", "tree", "size", "id", "c").join(sigs, "id")
        child = stash(child.select("node", "tree", "size", "id", "c", F.posexplode(F.transform(picks, lambda i: F.xxhash64(F.col("node"), i, F.get(F.col("sig"), i)))).alias("j", "child")), "dup-children")
        sizes = child.groupBy("node", "j", "child").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
        # A node most of whose members go down one branch is a group of like sets: branching says no more about it.
        tight = sizes.groupBy("node").agg((F.max("n") >= 0.4 * F.first("size")).alias("tight"))
        tight = tight.withColumn("tight", F.lit(True)) if d == depth else tight
        tight = stash(tight, "dup-tight")
        block = large.join(tight.filter("tight"), "node").select("node", "size", "id", "c")
        blocks = block if blocks is None else blocks.union(block)
        if d < depth:
            grown = sizes.filter("n > 1").select("child").join(child.join(tight.filter("not tight"), "node"), "child")
            level = stash(placed(grown.select(F.col("child").alias("node"), "tree", "id").distinct()), "dup-level")
    near = _close(stash(pairs.distinct(), "dup-pairs"), sigs, coords, percent)
    if blocks is not None:
        near = near.union(_compare_blocks(stash(blocks, "dup-blocks"), rows, shingle, percent, chunk)).distinct()
    more = stash(near, "dup-pairs")
    if not more.isEmpty():
        more = stash(_confirm(more, rows, shingle, percent), "dup-links")
        comp = stash(components(links.union(more).union(_same_key(full, classes))), "dup-comps")

    # A document's component is that of its class's representative.
    out = every.join(classes, "cls", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = out.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _same_key(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between representatives that rows of one key join."""
    x = full.groupBy("id").agg(F.count_distinct("cls").alias("n")).filter("n > 1").select("id")
    y = full.join(x, "id").join(classes, "cls").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    return y.distinct()


def _small(members: DataFrame) -> DataFrame:
    """Pairs of different components in small nodes."""
    lists = members.groupBy("node").agg(F.collect_list(F.struct("id", "c")).alias("m"))
    flat = F.flatten(F.transform("m", lambda p: F.transform(F.filter("m", lambda q: (q["id"] < p["id"]) & (q["c"] != p["c"])), lambda q: F.struct(p["id"].alias("a"), q["id"].alias("b")))))
    return lists.select(F.explode(flat).alias("p")).select("p.a", "p.b")


def block_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (larger, smaller id) between different components, as few as join them.

    Shingles are compared by 64-bit hashes; what is found is checked on the texts afterwards.
    """
    sizes = np.array([len(x) for x in sets])
    names, counts = np.unique(comps, return_counts=True)
    minor = np.flatnonzero(comps != names[np.argmax(counts)])
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    shingles, starts = np.unique(flat[order], return_index=True)
    ends = np.append(starts[1:], len(flat))
    doc = doc[order]
    own = {int(c): int(c) for c in names}

    def root(x: int) -> int:
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    out = []
    for i in minor.tolist():
        at = np.searchsorted(shingles, sets[i])
        both = np.bincount(np.concatenate([doc[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]), minlength=len(sets))
        for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)).tolist():
            a, b = root(int(comps[i])), root(int(comps[j]))
            if a != b:
                own[max(a, b)] = min(a, b)
                out.append((max(int(ids[i]), int(ids[j])), min(int(ids[i]), int(ids[j]))))
    return out


def _compare_blocks(members: DataFrame, docs: DataFrame, shingle: int, percent: int, chunk: int) -> DataFrame:
    """Candidate links (a, b) in large nodes (node, size, id, c): each is cut in chunks, and pairs of chunks are compared whole."""

    @lean
    def sets(batches):
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                h = {xxhash.xxh64_intdigest(" ".join(s).encode("utf-8", "surrogatepass")) for s in shingle_set(text, shingle)}
                out.append(np.sort(np.fromiter(h, dtype=np.uint64, count=len(h))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "own"])

    ids = stash(members.select("id").distinct(), "dup-ids")
    own = stash(_texts(docs, ids).mapInArrow(sets, "id long, own binary").dropDuplicates(["id", "own"]), "dup-block-sets")
    x = members.withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int")).withColumn("k", F.pmod(F.xxhash64("id", "node"), F.col("chunks")).cast("int"))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    x = x.distinct().select("node", F.least("k", "o").alias("lo"), F.greatest("k", "o").alias("hi"), "id", "c").join(own, "id")
    x = x.select("node", "lo", "hi", "id", "c", "own").repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi")

    @lean
    def run(batches):
        held: list[tuple] = []

        def settle():
            found = block_links(np.array([r[3] for r in held]), np.array([r[4] for r in held]), [np.frombuffer(r[5], dtype=np.uint64) for r in held], percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r[:3] != held[0][:3]:
                    yield settle()
                    held = []
                held.append(r)
        if held:
            yield settle()

    return x.mapInArrow(run, "a long, b long").filter("a <> b").distinct()
