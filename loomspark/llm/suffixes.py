"""Suffix-array dedup: removes bytes covered by a 100-byte string that also starts earlier.

Construction is blockwise, over a cover of the suffixes rather than all of them.

1. Cover. Of the 32-byte strings in a window of ``length`` bytes the one of
   smallest hash is the window's cover position. Equal windows have theirs at the
   same offset, which is the property that a difference cover gives to pairs of
   suffixes, with one position in 35 bytes (a difference cover of residues that
   leaves 28 common bytes needs one in 8). A cover position stands for the run of
   windows that chose it; the run's name is a hash of all bytes it spans, so one
   comparison resolves ties of up to ``length + 68`` bytes.
2. Buckets. Cover suffixes are dealt to buckets by the hash of their first 32
   bytes and each bucket is sorted on its own, by those bytes, then by name, then
   by place. A run whose name has come before is a repeat. A run that is the
   first of its name but shares its 32 bytes with other names holds the ends of
   matches: it is a boundary.
3. Boundaries send their bytes (135 or so) to the bucket of their 32 bytes, where
   windows are sorted and each that has come before is a repeat. Buckets with
   very many names are dealt again by window.
4. Windows that repeat are joined to the texts and their bytes removed.

A task sends each name once, so a group of copies or a line that every document
has reaches a bucket once for each task. Strings are compared by 64-bit hashes
with a second hash of 64 bits for windows and names folded in where they decide.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stash

ANCHOR = 32
#: Bytes of text that are looked at at once, about.
BLOCK = 2_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x7FB5D329728EA185)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C
    return h ^ (h >> np.uint64(29))


def window_hashes(x: np.ndarray, length: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``length``-byte string and of every ``ANCHOR``-byte string, by doubling."""
    cur, size = _mix((x.astype(np.uint64) + np.uint64(1)) * (np.uint64(2 * salt + 1) * _A)), 1
    acc, done, anchor = None, 0, cur
    while True:
        if length & size:
            if acc is None:
                acc = cur
            else:
                n = len(x) - done - size + 1
                acc = _mix(acc[: max(0, n)] * _B + cur[done : done + max(0, n)])
            done += size
        if size == ANCHOR:
            anchor = cur
        if 2 * size > max(length, ANCHOR):
            return acc, anchor
        n = max(0, len(cur) - size)
        cur = _mix(cur[:n] * _A + cur[size : size + n])
        size *= 2


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


def cover(texts: list[bytes], length: int):
    """Runs of windows of the texts: (document, first window, windows, hash of the cover string, name of the run)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    x = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.empty(0, dtype=np.int64)
    if len(x) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    whole, anchor = window_hashes(x, length)
    second, _ = window_hashes(x, length, salt=77)
    bits = np.uint64(max(1, int(len(x)).bit_length()))
    place = np.arange(len(anchor), dtype=np.uint64)
    low = _sliding_min(((anchor >> bits) << bits) | place, length - ANCHOR + 1)[: len(whole)]
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(whole)]
    valid = np.arange(len(whole)) + length <= (starts + sizes)[doc]
    rows = np.flatnonzero(valid)
    if not len(rows):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (at[rows[1:]] != at[rows[:-1]]) | (doc[rows[1:]] != doc[rows[:-1]])
    first = rows[new]
    last = rows[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(rows) - 1]])]
    # The first and the last window of a run cover all its bytes: windows start less than ``length`` apart.
    shape = ((last - first).astype(np.uint64) << np.uint64(32)) | (at[first] - first).astype(np.uint64)
    name = _mix(_mix(_mix(whole[first] + _A * shape) + _B * whole[last]) + _mix(_mix(second[first] + _B) + _A * second[last]))
    return doc[first], first - starts[doc[first]], last - first + 1, anchor[at[first]], name


def _runs(rid: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, touching and overlapping ones of a document joined."""
    if not len(rid):
        return rid, p, n
    order = np.lexsort((p, rid))
    rid, p, n = rid[order], p[order].astype(np.int64), n[order].astype(np.int64)
    doc = np.cumsum(np.concatenate([[0], (rid[1:] != rid[:-1]).astype(np.int64)]))
    wide = np.int64(1) << 40
    end = np.maximum.accumulate(p + n + doc * wide) - doc * wide
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (p[1:] > end[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(p) - 1]])
    return rid[first], p[first], end[last] - p[first]


_COLS = "bucket int, h binary, name binary, rid binary, p binary, n binary"
_OUT = pa.schema([("rid", pa.int64()), ("p", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("names", pa.int64())])


def _flagged(rid, p, n, h=None, names=None) -> pa.RecordBatch:
    zero = np.zeros(len(rid), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.int64)) for c in (rid, p, n, zero if h is None else h, zero if names is None else names)], schema=_OUT)


def text_pieces(text: bytes, size: int, length: int):
    """(start, bytes) of pieces of ``size`` windows; they overlap by ``length - 1`` bytes, so each window is in one piece.

    A run that a cut parts has another name than an uncut copy of it. Both have the
    same cover string, so both become boundaries, and their windows are compared.
    """
    for at in range(0, len(text) - length + 1, size):
        yield at, text[at : at + size + length - 1]


def _cover_buckets(rows: DataFrame, length: int, buckets: int, piece: int) -> DataFrame:
    """Blocks of cover suffixes by bucket, each name once for a task's block; bucket -1 holds runs found to repeat on the way."""

    def run(batches):
        held: list[tuple] = []
        texts, ids, starts, size, n_held = [], [], [], 0, 0

        def settle():
            nonlocal texts, ids, starts, size, n_held
            if texts:
                doc, p, n, h, name = cover(texts, length)
                held.append((np.array(ids, dtype=np.int64)[doc], p + np.array(starts, dtype=np.int64)[doc], n, h, name))
                n_held += len(p)
            texts, ids, starts, size = [], [], [], 0

        def flush():
            nonlocal held
            if not held:
                return
            rid, p, n, h, name = (np.concatenate([x[i] for x in held]) for i in range(5))
            held = []
            order = np.lexsort((p, rid, name, h))
            rid, p, n, h, name = rid[order], p[order], n[order], h[order], name[order]
            again = np.concatenate([[False], (h[1:] == h[:-1]) & (name[1:] == name[:-1])]) if len(h) else np.empty(0, dtype=bool)
            d = _runs(rid[again], p[again], n[again])
            parts = [(-1, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64), *d)] if len(d[0]) else []
            rid, p, n, h, name = (c[~again] for c in (rid, p, n, h, name))
            b = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            cuts = np.flatnonzero(np.diff(b[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                parts.append((int(b[own[0]]), h[own], name[own], rid[own], p[own], n[own]))
            for i in range(0, len(parts), 256):
                cols = list(zip(*parts[i : i + 256]))
                raw = lambda c, t: pa.array([np.ascontiguousarray(x, dtype=t).tobytes() for x in c], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), raw(cols[1], "<u8"), raw(cols[2], "<u8"), raw(cols[3], "<i8"), raw(cols[4], "<i4"), raw(cols[5], "<i4")], names=["bucket", "h", "name", "rid", "p", "n"])

        for batch in slices(batches):
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, part in text_pieces(text or b"", piece, length):
                    if size + len(part) > BLOCK:
                        settle()
                        if n_held > 1_500_000:
                            yield from flush()
                            n_held = 0
                    texts.append(part)
                    ids.append(rid)
                    starts.append(at)
                    size += len(part)
        settle()
        yield from flush()

    return rows.select("rid", "raw").mapInArrow(run, _COLS)


def _sort_buckets(blocks: DataFrame) -> DataFrame:
    """Repeats (h 0) and boundaries of the cover; input comes sorted by bucket."""

    def settle(parts):
        read = lambda i, t: np.frombuffer(b"".join(x[i] for x in parts), dtype=t)
        h, name, rid, p, n = read(1, "<u8"), read(2, "<u8"), read(3, "<i8"), read(4, "<i4"), read(5, "<i4")
        if parts[0][0] < 0:
            yield _flagged(rid, p, n)
            return
        # Suffixes whose first bytes stand alone have no match.
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        pair = np.zeros(len(s), dtype=bool)
        pair[1:] |= same
        pair[:-1] |= same
        keep = order[pair]
        if not len(keep):
            return
        h, name, rid, p, n = h[keep], name[keep], rid[keep], p[keep], n[keep]
        order = np.lexsort((p, rid, name, h))
        h, name, rid, p, n = h[order], name[order], rid[order], p[order], n[order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_h | np.concatenate([[True], name[1:] != name[:-1]])
        group = np.cumsum(new_h) - 1
        names = np.bincount(group, weights=new).astype(np.int64)[group]
        yield _flagged(*_runs(rid[~new], p[~new], n[~new]))
        edge = new & (names > 1)
        yield _flagged(rid[edge], p[edge], n[edge], h[edge].view(np.int64), names[edge])

    def run(batches):
        parts: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and (r[0] != parts[0][0] or r[0] < 0):
                    yield from settle(parts)
                    parts = []
                parts.append(r)
        if parts:
            yield from settle(parts)

    return blocks.mapInArrow(run, "rid long, p long, n long, h long, names long")


def _boundary_texts(found: DataFrame, length: int, crowd: int) -> DataFrame:
    """(key, rid, p, data): the bytes of boundary runs by the hash of their cover string; crowded ones as window hashes, dealt again.

    Input rows (rid, raw, edges).
    """

    def run(batches):
        for batch in slices(batches):
            key, ids, ps, data = [], [], [], []
            crowds: dict[int, list] = {}
            for rid, raw, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for e in edges:
                    part = raw[e["p"] : e["p"] + e["n"] + length - 1]
                    if e["names"] <= crowd:
                        key.append(e["h"])
                        ids.append(rid)
                        ps.append(e["p"])
                        data.append(part)
                    else:
                        x = np.frombuffer(part, dtype=np.uint8)
                        a, b = window_hashes(x, length)[0], window_hashes(x, length, salt=77)[0]
                        own = (_mix(a) % np.uint64(e["names"] // crowd + 1)).astype(np.int64)
                        for i in range(len(a)):
                            crowds.setdefault((e["h"] + 1_000_003 * (int(own[i]) + 1)) & (1 << 63) - 1, []).append((int(a[i]), int(b[i]), rid, e["p"] + i))
            for k, rows in crowds.items():
                key.append(k)
                ids.append(-1)
                ps.append(-1)
                data.append(b"".join(struct.pack("<QQqi", *r) for r in rows))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(ps, pa.int64()), pa.array(data, pa.binary())], names=["key", "rid", "p", "data"])

    return found.mapInArrow(run, "key long, rid long, p long, data binary")


_PACKED = np.dtype([("a", "<u8"), ("b", "<u8"), ("rid", "<i8"), ("p", "<i4")])


def _sort_windows(rows: DataFrame, length: int) -> DataFrame:
    """Runs of windows that have come before; input (key, rid, p, data) comes sorted by key."""

    def settle(parts):
        one = [(r, p, d) for r, p, d in parts if p >= 0]
        many = [np.frombuffer(d, dtype=_PACKED) for _, p, d in parts if p < 0]
        a, b, rid, p = [m["a"] for m in many], [m["b"] for m in many], [m["rid"] for m in many], [m["p"].astype(np.int64) for m in many]
        if one:
            x = np.frombuffer(b"".join(d for _, _, d in one), dtype=np.uint8)
            size = np.array([len(d) for _, _, d in one])
            start = np.cumsum(size) - size
            h1, h2 = window_hashes(x, length)[0], window_hashes(x, length, salt=77)[0]
            which = np.repeat(np.arange(len(one)), size - length + 1)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(size - length + 1) - (size - length + 1), size - length + 1)
            at = start[which] + inner
            a.append(h1[at])
            b.append(h2[at])
            rid.append(np.array([r for r, _, _ in one])[which])
            p.append(np.array([p for _, p, _ in one])[which] + inner)
        a, b, rid, p = map(np.concatenate, (a, b, rid, p))
        order = np.lexsort((p, rid, b, a))
        a, b, rid, p = a[order], b[order], rid[order], p[order]
        again = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        r, q, n = _runs(rid[again], p[again], np.ones(int(again.sum()), dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(q, pa.int64()), pa.array(n, pa.int64())], names=["rid", "p", "n"])

    def run(batches):
        parts, size, last = [], 0, None
        for batch in batches:
            for k, r, p, d in zip(*(c.to_pylist() for c in batch.columns)):
                if k != last and size > BLOCK:
                    yield settle(parts)
                    parts, size = [], 0
                parts.append((r, p, d))
                size += len(d)
                last = k
        if parts:
            yield settle(parts)

    return rows.mapInArrow(run, "rid long, p long, n long")


def cut(raw: bytes, runs, length: int) -> tuple[bytes, int, int, list[tuple[int, int]]]:
    """What is left of ``raw`` without the bytes of the windows in ``runs`` (first, count); bytes removed, maximal removed runs, and these."""
    spans: list[list[int]] = []
    for p, n in sorted(runs):
        a, b = p, p + n - 1 + length
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    left, at = [], 0
    for a, b in spans:
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    return b"".join(left), sum(b - a for a, b in spans), len(spans), [tuple(s) for s in spans]


def _numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rid, id, raw) of every row and of every document: rid orders the documents. It is the key itself if that tells rows apart, else a number by key and text."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))
    n, d = rows.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if n == d:
        rows = rows.withColumn("rid", F.col("id"))
        return rows, rows
    tagged = rows.withColumn("th", F.xxhash64("raw"))
    pairs = stash(tagged.select("id", "th").distinct().repartitionByRange(F.col("id").asc_nulls_first(), "th").sortWithinPartitions(F.col("id").asc_nulls_first(), "th").withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "sfx-pairs")
    before = pairs.groupBy("part").agg(F.count(F.lit(1)).alias("c")).withColumn("off", F.coalesce(F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    num = pairs.join(F.broadcast(before.select("part", "off")), "part").select(F.col("id").alias("_id"), F.col("th").alias("_th"), (F.col("i") + F.col("off")).alias("rid"))
    rows = tagged.join(num, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("id", "raw", "rid")
    return rows, rows.dropDuplicates(["rid"])


def repeated_runs(rows: DataFrame, length: int = 100, bucket_bytes: int = 4_000_000, crowd: int = 1000, piece: int = BLOCK // 2) -> DataFrame:
    """(rid, p, n): runs of windows of (rid, raw) that also start earlier; they may overlap.

    The number of buckets follows the bytes, so that a bucket is as large in any
    corpus. Texts of more than ``piece`` windows are cut, so that a text of any
    length is hashed in bounded memory.
    """
    total = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = int(max(16, total // bucket_bytes))
    blocks = _cover_buckets(rows, length, buckets, piece)
    deal = F.when(F.col("bucket") < 0, F.xxhash64("rid")).otherwise(F.col("bucket").cast("long"))
    flags = stash(_sort_buckets(blocks.withColumn("_d", deal).repartition(F.col("_d")).sortWithinPartitions("bucket").drop("_d")), "sfx-flags")
    edges = flags.filter("names > 1").groupBy("rid").agg(F.collect_list(F.struct("p", "n", "h", "names")).alias("edges"))
    texts = rows.select("rid", "raw").join(edges, "rid").select("rid", "raw", "edges")
    windows = _boundary_texts(texts, length, crowd).repartition("key").sortWithinPartitions("key")
    more = stash(_sort_windows(windows, length), "sfx-windows")
    return flags.filter("names <= 1").select("rid", "p", "n").union(more)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, keep_text: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]) of every document.

    Removes each byte covered by a string of ``length`` bytes that also starts
    earlier: in a document of smaller key, or further to the front of the same.
    Strings are judged on the input. Texts are UTF-8; cutting may leave partial
    characters, so ``kept`` is binary. Null texts are empty. Of rows that share a
    key those with equal texts are one document, others are ordered by a hash of
    the text; null keys come first. An empty table gives an empty result. Other
    columns are not read.
    """
    rows, documents = _numbered(docs, key, text)
    runs = repeated_runs(documents, length).groupBy("rid").agg(F.collect_list(F.struct("p", "n")).alias("runs"))
    schema = f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long,end:long>>, kept binary" * keep_text

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for raw, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    left, n, k, spans = cut(raw, [(r["p"], r["n"]) for r in own or ()], length)
                    out.append((len(raw), n, k, hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in spans], left))
                cols = list(zip(*out)) if out else [()] * 6
                arrays = [part.column(0)] + [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())]
                names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    arrays += [pa.array(cols[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(cols[5], pa.binary())]
                    names += ["spans", "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.join(runs, "rid", "left").select("id", "raw", "runs").mapInArrow(run, schema)
