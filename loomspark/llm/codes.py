"""Vector code compression: product codes whose nearest entries are found inside an annulus of norms.

Vectors are cut into equal parts and every part is replaced by the index of the
nearest entry of its position's codebook. A codebook's entries are sorted by norm;
an entry nearer than the best one known so far, at distance r, has a norm between
``|x| - r`` and ``|x| + r`` (triangle inequality), so the entry of the closest norm
gives a first r, two binary searches give the interval of norms that it allows, and
just the entries of that interval, ends included, are compared exactly.

Everything is integer arithmetic: components are ``floor(scale * x)``. Spark deals
the vectors; each round of Lloyd's iteration is one pass in which every task adds
up its own parts, so that a pass moves a few numbers for each entry, task and
position, whatever the number of vectors. The driver gets the sums of the entries
alone (``parts * entries`` times the width of a part), and tasks get the codebooks.

Odd input. Vectors that are null or hold a null or non-finite component are dropped.
Vectors shorter than the longest one are filled up with zeros, and so is the
longest up to a multiple of ``parts`` (an empty vector is all zeros). Equal ids are
rows of their own; among the first ids they are ordered by vector; null ids come
last. With fewer than ``entries`` rows the codebooks have as many entries as there
are rows. Components of any finite size are exact (those beyond 64 bits by Python's
integers); an error above 2**63 - 1 is given as that number. Null labels are one
label. No rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, stash

#: Sums travel in digits of this many bits, so that long columns can add up integers of any size.
LIMB = 40
#: Totals of at most this many labels are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 500_000
MOST = 2**63 - 1


def _limbs(value: int) -> list[int]:
    """Digits of an integer, lowest first; the highest carries the sign."""
    out = []
    while not -(1 << LIMB) < value < (1 << LIMB):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def scaled(x: float, scale: int) -> int:
    """floor(scale * x), exact where the product would leave the range of doubles, too."""
    return math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale


class Book:
    """The entries of one part's position, sorted by norm."""

    def __init__(self, entries: list[list[int]], limit: int):
        squares = [sum(v * v for v in e) for e in entries]
        self.order = sorted(range(len(entries)), key=lambda k: (squares[k], k))
        self.entries = [entries[k] for k in self.order]
        self.roots = [math.isqrt(squares[k]) for k in self.order]
        self.narrow = bool(entries) and all(abs(v) < limit for e in entries for v in e)
        if self.narrow:
            self.table = np.array(self.entries, np.int64).reshape(len(entries), -1)
            self.norms = np.sqrt(np.array([squares[k] for k in self.order], np.float64))
            self.index = np.array(self.order, np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row of 64-bit parts whose distances to the entries fit."""
        norm = np.sqrt((x * x).sum(1).astype(np.float64))
        above = np.searchsorted(self.norms, norm).clip(0, len(self.norms) - 1)
        below = (above - 1).clip(0)
        seed = np.where(norm - self.norms[below] <= self.norms[above] - norm, below, above)
        reach = np.sqrt(((x - self.table[seed]) ** 2).sum(1).astype(np.float64))
        slack = 1e-9 + 1e-12 * (norm + reach)  # roots are rounded: the interval may be a little wide, never narrow
        low = np.minimum(np.searchsorted(self.norms, norm - reach - slack, "left"), seed)
        high = np.maximum(np.searchsorted(self.norms, norm + reach + slack, "right"), seed + 1)
        many = high - low
        starts = np.cumsum(many) - many
        row = np.repeat(np.arange(len(x)), many)
        entry = np.arange(len(row)) - np.repeat(starts - low, many)
        far = ((x[row] - self.table[entry]) ** 2).sum(1)
        best = np.minimum.reduceat(far, starts)
        tied = np.where(far == best[row], self.index[entry], len(self.index))
        return np.minimum.reduceat(tied, starts), best

    def nearest_wide(self, x: list[int]) -> tuple[int, int]:
        """The same of one part of integers of any size."""
        far = lambda k: sum((a - b) ** 2 for a, b in zip(x, self.entries[k]))
        norm = math.isqrt(sum(v * v for v in x))
        seed = min(bisect.bisect_left(self.roots, norm), len(self.roots) - 1)
        reach = math.isqrt(far(seed)) + 2  # roots are cut off, so one more on either side
        low, high = bisect.bisect_left(self.roots, norm - reach), bisect.bisect_right(self.roots, norm + reach)
        best, index = min((far(k), self.order[k]) for k in {seed, *range(low, high)})
        return index, best


class Coder:
    """Codebooks of all positions; assigns batches of vectors."""

    def __init__(self, books: list[list[list[int]]], width: int, scale: int):
        self.parts, self.width, self.scale = len(books), width, scale
        self.limit = math.isqrt(2**62 // max(1, self.parts * width)) // 2  # squared distances of whole vectors stay below 2**62
        self.books = [Book(b, self.limit) for b in books]

    def read(self, column: pa.Array) -> np.ndarray:
        """The vectors of an Arrow list column as doubles, filled up with zeros."""
        flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(column.offsets)
        sizes = np.diff(ends)
        out = np.zeros((len(column), self.parts * self.width))
        if len(sizes) and sizes.min() == sizes.max() == out.shape[1]:
            return flat.reshape(out.shape)
        at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
        out[np.repeat(np.arange(len(column)), sizes), at] = flat
        return out

    def assign(self, vectors: np.ndarray):
        """Narrow rows with their integers, codes and errors as arrays; wide rows as lists of the same."""
        with np.errstate(over="ignore"):
            product = np.floor(vectors * self.scale)
        fits = (np.abs(product) < self.limit).all(1)
        rows = np.flatnonzero(fits)
        whole = product[rows].astype(np.int64)
        codes, errors, wide = np.zeros((len(rows), self.parts), np.int64), np.zeros(len(rows), np.int64), []
        if all(b.narrow for b in self.books):
            for p, book in enumerate(self.books if len(rows) else ()):
                codes[:, p], far = book.nearest(whole[:, p * self.width : (p + 1) * self.width])
                errors += far
        else:
            rows, whole, codes, errors, fits = rows[:0], whole[:0], codes[:0], errors[:0], np.zeros(len(fits), bool)
        for r in np.flatnonzero(~fits):
            ints = [scaled(x, self.scale) for x in vectors[r].tolist()]
            found = [b.nearest_wide(ints[p * self.width : (p + 1) * self.width]) for p, b in enumerate(self.books)]
            wide.append((int(r), ints, [k for k, _ in found], sum(d for _, d in found)))
        return rows, whole, codes, errors, wide


SUMS = "part int, entry int, pos int, limb int, value long"


def _sums(vectors: DataFrame, coder: Coder) -> dict[tuple[int, int, int], int]:
    """For each (part, entry, position) the sum of the components assigned to it; at position -1 their number."""

    @lean
    def add(batches):
        count: dict[tuple[int, int, int], int] = {}

        def more(key, value):
            count[key] = count.get(key, 0) + value

        for batch in slices(batches, 2000):
            _, whole, codes, _, wide = coder.assign(coder.read(batch.column(0)))
            for p in range(coder.parts):
                cut = whole[:, p * coder.width : (p + 1) * coder.width]
                for k in np.unique(codes[:, p]).tolist():
                    mine = cut[codes[:, p] == k]
                    more((p, k, -1), len(mine))
                    for i, v in enumerate(mine.sum(0).tolist()):
                        more((p, k, i), v)
            for _, ints, code, _ in wide:
                for p, k in enumerate(code):
                    more((p, k, -1), 1)
                    for i in range(coder.width):
                        more((p, k, i), ints[p * coder.width + i])
        rows = [(*key, n, digit) for key, v in count.items() for n, digit in enumerate(_limbs(v))]
        names, types = ("part", "entry", "pos", "limb", "value"), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    out: dict[tuple[int, int, int], int] = {}
    summed = vectors.select("_vec").mapInArrow(add, SUMS).groupBy("part", "entry", "pos", "limb").agg(F.sum("value").alias("value"))
    for part, entry, pos, limb, value in summed.collect():  # as many rows as the codebooks have numbers
        out[part, entry, pos] = out.get((part, entry, pos), 0) + (value << (LIMB * limb))
    return out


def _final(vectors: DataFrame, coder: Coder) -> DataFrame:
    """Each vector's code and error under the last codebooks."""

    @lean
    def run(batches):
        for batch in slices(batches, 2000):
            rows, _, codes, errors, wide = coder.assign(coder.read(batch.column(2)))
            code, error = [""] * batch.num_rows, [0] * batch.num_rows
            for r, c, e in [*zip(rows.tolist(), codes.tolist(), errors.tolist()), *((r, c, e) for r, _, c, e in wide)]:
                code[r], error[r] = "".join(f"{k:02x}" for k in c), min(e, MOST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error, pa.int64())], ["_id", "_label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("_id", "_label", "_vec").mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long")


def train(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Coder:
    """Codebooks of ``entries`` entries for each part after ``rounds`` rounds, started at the smallest ids."""
    longest = vectors.agg(F.max(F.size("_vec"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = vectors.orderBy(F.asc_nulls_last("_id"), "_vec").limit(entries).select("_vec").collect()
    start = [[scaled(x, scale) for x in r[0]] + [0] * (parts * width - len(r[0])) for r in first]
    books = [[s[p * width : (p + 1) * width] for s in start] for p in range(parts)]
    for _ in range(rounds if start else 0):
        sums = _sums(vectors, Coder(books, width, scale))
        for p, book in enumerate(books):
            for k in range(len(book)):
                if n := sums.get((p, k, -1), 0):
                    book[k] = [sums.get((p, k, i), 0) // n for i in range(width)]
    return Coder(books, width, scale)


def digest(coder: Coder) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    whole: list[list[list[int]]] = []
    for book in coder.books:
        whole.append([entry for _, entry in sorted(zip(book.order, book.entries))])
    return hashlib.sha256(",".join(str(v) for b in whole for e in b for v in e).encode()).hexdigest()


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256) of every usable vector.

    ``code`` has two hex digits for each part, so ``entries`` may be 256 at most.
    The input is read once for each round and three times more: write it down first
    if it is costly to make.
    """
    if not 0 < entries <= 256:
        raise ValueError("a part's code has two hex digits: entries must be 1 to 256")
    usable = F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = df.select(F.col(key).alias("_id"), F.col(label).alias("_label"), F.col(vector).cast("array<double>").alias("_vec")).filter(F.col("_vec").isNotNull() & usable)
    coder = train(vectors, parts, entries, rounds, scale)
    coded = stash(_final(vectors, coder), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    totals = stash(coded.groupBy(F.col("_label").alias("_of")).agg(total.alias("label_error")), "label-errors")
    few = totals.count() <= BROADCAST_LABELS
    out = coded.join(F.broadcast(totals) if few else totals, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_id").alias(key), F.col("_label").alias(label), "code", "error", "label_error", F.lit(digest(coder)).alias("codebooks_sha256"))
