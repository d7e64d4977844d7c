"""Quality rules: word and line counts, and n-gram perplexity under a modified Kneser-Ney model.

The language model is over the symbols of a text, a space between words, one
model for each language. Its n-grams run across words, so the order of words
counts. They are counted by Spark over all documents: a task counts the n-grams
of its texts by exact keys and sends each distinct one once, packed in blocks by
bucket, so what is shuffled follows the distinct n-grams, not the text. The estimates are joins and sums over
those. The finished model is a sorted array of hashed n-grams with log
probabilities and back-off weights. Hashes have 64 bits; if two n-grams share one,
another hash is taken, so no entries are merged.

Documents are scored under the model of all documents, so each of their n-grams
has an entry. The most frequent entries, ``broadcast_entries`` of them at most,
are sent to the workers. A larger model stays a table: what workers don't hold is
joined to it, n-gram by n-gram of a document, which gives the same sums; the hot
n-grams are never among those.

A document whose log perplexity lies outside its language's band is rejected. The
band ends ``below`` times the distance from the lower quartile to the median under
that median, and ``above`` times the distance from the median to the upper quartile
over it (``least_spread`` at least). The quartiles are of the documents of the
language and of like length (powers of two of words) that pass the base rules, since
the means of short texts spread more; equal values count once, so copies don't move them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, lean, slices, stash

WORDS = re.compile(WORD)
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
_M64 = (1 << 64) - 1
#: Multipliers of the n-gram hash and of its mixing.
_STEP, _MIX = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
#: Probability of a symbol that was never seen, before back-off.
_NOVEL = 1.0 / 65536
#: Symbols of one text that are looked at at once, at most, and those of several texts together.
_LONG, _TOGETHER = 200_000, 300_000
#: Steps of log perplexity in which quantiles are read off.
_GRID = 0.001


def base_counts(text: str | None) -> tuple[list[str], int, int, int, int]:
    """Words, and word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return [], 0, 0, 0, 0
    words = WORDS.findall(text)
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORDS.search(line):
            seen.add(line)
    repeat = 0
    three = list(zip(words, words[1:], words[2:]))
    if len(set(three)) < len(three):
        n, end = Counter(three), 0
        for i, x in enumerate(three):
            if n[x] > 1:
                repeat += i + 3 - max(end, i)
                end = i + 3
    return words, sum(map(len, words)), symbols, dup, repeat


def _pieces(text: str, order: int):
    """(symbols before, part, symbol after) of a text in parts of ``_LONG`` symbols at most."""
    pad = " " * (order - 1)
    before = pad
    for at in range(0, max(len(text), 1), _LONG):
        part, last = text[at : at + _LONG], at + _LONG >= len(text)
        yield before, part, " " if last else ""
        before = (pad + _SPACES.sub(" ", before + part))[-len(pad) :]


def symbols(parts: list[tuple[str, str, str]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the parts one after the other, where in them n-grams of the order end, and the part of each of those.

    Runs of white space are one space; one stands after the last word, and a text begins after ``order - 1`` of them.
    """
    codes = np.frombuffer("".join(x for p in parts for x in p).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.array([order - 1 + len(t) + len(e) for _, t, e in parts])
    start = np.cumsum(size) - size
    pad = np.zeros(len(codes), dtype=bool)
    for j in range(order - 1):
        pad[start + j] = True
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    keep = pad.copy()
    keep |= ~space
    keep[1:] |= ~space[:-1]
    which = np.repeat(np.arange(len(parts)), size)[keep]
    codes = np.where(space, np.uint32(32), codes)[keep]
    at = np.flatnonzero(~pad[keep])
    return codes, at, which[at]


class _Table:
    """Exact counts of 64-bit n-gram keys by direct address: the first key of a slot is counted there, others of the slot by sorting."""

    def __init__(self, bits: int = 20):
        self.shift, self.n = np.uint64(64 - bits), 1 << bits
        self.key, self.count = np.zeros(self.n, dtype=np.uint64), np.zeros(self.n, dtype=np.int64)
        self.rest: dict[int, int] = {}

    def add(self, keys: np.ndarray) -> None:
        at = ((keys * np.uint64(_MIX)) >> self.shift).astype(np.int64)
        free = self.key[at] == 0
        self.key[at[free]] = keys[free]
        own = self.key[at] == keys
        self.count += np.bincount(at[own], minlength=self.n)
        if not own.all():
            for k, n in zip(*(x.tolist() for x in np.unique(keys[~own], return_counts=True))):
                self.rest[k] = self.rest.get(k, 0) + n

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(self.count)
        return (
            np.concatenate([self.key[used], np.fromiter(self.rest.keys(), dtype=np.uint64, count=len(self.rest))]),
            np.concatenate([self.count[used], np.fromiter(self.rest.values(), dtype=np.int64, count=len(self.rest))]),
        )


class _Few:
    """The same for languages beyond the first ones of a task: keys are sorted batch by batch."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))

    def size(self) -> int:
        return sum(len(k) for k, _ in self.parts)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        keys, which = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(which, weights=np.concatenate([n for _, n in self.parts])).astype(np.int64)


class _Counts:
    """N-grams of texts by language: symbols are numbered as they come, so that a whole n-gram is one 64-bit key."""

    def __init__(self, order: int, across: bool = True, tables: int = 8):
        self.order, self.across, self.tables = order, across, tables
        self.bits = 64 // order
        self.number = np.zeros(0x110000, dtype=np.uint32)
        self.codes = [0]
        self.by: dict[str, _Table | _Few] = {}

    def add(self, lang: str, parts: list[tuple[str, str, str]]):
        """Count the parts; gives batches of counts whenever room runs out."""
        codes, at, _ = symbols(parts, self.order)
        if not len(at):
            return
        own = self.number[codes]
        if not own.all():
            fresh = np.unique(codes[own == 0])
            if len(self.codes) + len(fresh) >= 1 << self.bits:
                yield from self.flush()
                fresh = np.unique(codes)
                if len(fresh) + 1 >= 1 << self.bits:  # more symbols than numbers
                    yield from self._halves(lang, parts)
                    return
            self.number[fresh] = np.arange(len(self.codes), len(self.codes) + len(fresh))
            self.codes += fresh.tolist()
            own = self.number[codes]
        own = own.astype(np.uint64)
        key = own[at]
        # Inside words only: what stands before the last space is as if it were spaces.
        last = None if self.across else np.maximum.accumulate(np.where(codes == 32, np.arange(len(codes)), 0))[at - 1]
        for j in range(1, self.order):
            key = key | (own[at - j if last is None else np.maximum(at - j, last)] << np.uint64(self.bits * j))
        if lang not in self.by:
            self.by[lang] = _Table() if len(self.by) < self.tables else _Few()
        self.by[lang].add(key)
        if sum(t.size() for t in self.by.values() if isinstance(t, _Few)) > 2_000_000:
            yield from self.flush()

    def _halves(self, lang: str, parts: list[tuple[str, str, str]]):
        if len(parts) > 1:
            yield from self.add(lang, parts[: len(parts) // 2])
            yield from self.add(lang, parts[len(parts) // 2 :])
        else:
            before, text, after = parts[0]
            cut = len(text) // 2
            left = _SPACES.sub(" ", before + text[:cut])
            yield from self.add(lang, [(before, text[:cut], "")])
            yield from self.add(lang, [(left[-(self.order - 1) :], text[cut:], after)])

    def flush(self):
        """(lang, first and last symbols of each n-gram, counts): what has been counted, which is then forgotten."""
        codes = np.array(self.codes, dtype=np.uint64)
        mask = np.uint64((1 << self.bits) - 1)
        for lang, table in self.by.items():
            keys, n = table.items()
            head, tail = np.zeros(len(keys), dtype=np.uint64), np.zeros(len(keys), dtype=np.uint64)
            for j in range(self.order - 1, -1, -1):
                c = codes[((keys >> np.uint64(self.bits * j)) & mask).astype(np.int64)]
                if j > 2:
                    head = (head << np.uint64(21)) | c
                else:
                    tail = (tail << np.uint64(21)) | c
            yield lang, head, tail, n
        self.by.clear()
        self.number[:] = 0
        self.codes = [0]


def _summed(head: np.ndarray, tail: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal n-grams added up."""
    order = np.lexsort((tail, head))
    head, tail, n = head[order], tail[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]))
    return head[new], tail[new], np.add.reduceat(n, new)


def count_ngrams(docs: DataFrame, order: int, across: bool = True) -> DataFrame:
    """(lang, gram, n) over all documents of (lang, text): every symbol with the ``order - 1`` before it. A null language is ''.

    With ``across`` these run over words; else each word begins after ``order - 1`` spaces, whatever was before it.
    """

    @lean
    def run(batches):
        counts = _Counts(order, across)

        def blocks(found):
            """Rows (lang, bucket, n-grams, counts): few and packed, so that the JVM moves bytes, not strings."""
            for lang, head, tail, n in found:
                bucket = ((head * np.uint64(_MIX) ^ tail) * np.uint64(_STEP) >> np.uint64(32)) % np.uint64(buckets)
                at = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[at])) + 1
                first = np.concatenate([[0], cuts])
                split = lambda x: pa.array([p.tobytes() for p in np.split(x[at], cuts)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first)), pa.array(bucket[at][first].astype(np.int32)), split(head), split(tail), split(n)], names=["lang", "bucket", "head", "tail", "n"])

        for batch in slices(batches):
            by: dict[str, list[tuple[str, str, str]]] = {}
            size: Counter[str] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lang = lang or ""
                for part in _pieces(text, order) if text else ():
                    by.setdefault(lang, []).append(part)
                    size[lang] += len(part[1])
                    if size[lang] > _TOGETHER:
                        del size[lang]
                        yield from blocks(counts.add(lang, by.pop(lang)))
            for lang, parts in by.items():
                yield from blocks(counts.add(lang, parts))
        yield from blocks(counts.flush())

    @lean
    def add_up(batches):
        """Rows come sorted by language and bucket; one bucket is held at a time."""
        key, held, size = None, [], 0

        def settle():
            head, tail, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            for i in range(0, len(n), 50_000):
                h, t = head[i : i + 50_000], tail[i : i + 50_000]
                symbols_ = [(h >> np.uint64(21 * j)) & np.uint64(0x1FFFFF) for j in range(order - 4, -1, -1)] + [(t >> np.uint64(21 * j)) & np.uint64(0x1FFFFF) for j in range(min(order, 3) - 1, -1, -1)]
                text = np.stack(symbols_, axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                part = [text[k : k + order] for k in range(0, len(text), order)]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(n[i : i + 50_000], pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, bucket, *block in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and key != (lang, bucket):
                    yield from settle()
                    held, size = [], 0
                key = lang, bucket
                held.append(tuple(np.frombuffer(x, dtype=d) for x, d in zip(block, ("<u8", "<u8", "<i8"))))
                size += len(held[-1][2])
                if size > 3_000_000:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][2])
        if held:
            yield from settle()

    if not 3 <= order <= 6:
        raise ValueError("n-grams of three to six symbols are packed in two times 64 bits")
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("lang", "text").mapInArrow(run, "lang string, bucket int, head binary, tail binary, n binary")
    return packed.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(add_up, "lang string, gram string, n long")


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, lp, bow, n): interpolated log probability of each n-gram, of each context the log weight of its back-off, and its count.

    Orders below the highest count the distinct symbols before an n-gram. Discounts
    come from the counts of counts, for each language and order. Sums are of whole
    numbers, so reruns agree to the last bit.
    """
    levels = {order: stash(counts, "kn-grams")}
    for k in range(order - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    table = None
    for k, level in levels.items():
        x = level.withColumn("k", F.lit(k))
        table = x if table is None else table.unionByName(x)
    table = stash(table.withColumn("ctx", F.expr("substring(gram, 1, k - 1)")), "kn-counts")
    times = lambda i: F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}")
    coc = table.groupBy("lang", "k").agg(*[times(i) for i in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

    def discount(i: int):
        raw = i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))
        return F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), raw)).alias(f"d{i}")

    disc = stash(coc.select("lang", "k", discount(1), discount(2), discount(3)), "kn-discounts")
    # A row for each language and order: sent to all where they are few, so that the large orders stay spread.
    disc = F.broadcast(disc) if disc.count() <= 100_000 else disc
    ctx = table.groupBy("lang", "k", "ctx").agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") == 1, 1)).alias("c1"), F.count(F.when(F.col("n") == 2, 1)).alias("c2"), F.count(F.when(F.col("n") > 2, 1)).alias("c3"))
    weight = (F.col("c1") * F.col("d1") + F.col("c2") * F.col("d2") + F.col("c3") * F.col("d3")) / F.col("total")
    ctx = stash(ctx.join(disc, ["lang", "k"]).select("lang", "k", "ctx", "total", weight.alias("bow"), "d1", "d2", "d3"), "kn-contexts")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    x = stash(table.join(ctx, ["lang", "k", "ctx"]).select("lang", "k", "gram", "n", ((F.col("n") - d) / F.col("total")).alias("own"), "bow"), "kn-own")
    done = x.filter("k = 1").select("lang", "gram", "n", (F.col("own") + F.col("bow") * _NOVEL).alias("p"))
    parts = [done]
    for k in range(2, order + 1):
        low = done.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
        up = x.filter(F.col("k") == k).withColumn("suffix", F.expr(f"substring(gram, 2, {k - 1})"))
        done = up.join(low, ["lang", "suffix"], "left").select("lang", "gram", "n", (F.col("own") + F.col("bow") * F.coalesce("low", F.lit(_NOVEL))).alias("p"))
        parts.append(done)
    probs = parts[0]
    for p in parts[1:]:
        probs = probs.unionByName(p)
    bows = ctx.select("lang", F.col("ctx").alias("gram"), F.log("bow").alias("bow"))
    return stash(probs.select("lang", "gram", F.log("p").alias("lp"), "n").join(bows, ["lang", "gram"], "full_outer").select("lang", "gram", "lp", "bow", F.coalesce("n", F.lit(0)).alias("n")), "kn-model")


def _seed(lang: str, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")


def gram_hash(lang: str, gram: str, salt: int = 0) -> int:
    """64-bit hash of an n-gram of a language."""
    h = 0
    for c in gram:
        h = (h * _STEP + ord(c) + 1) & _M64
    h = ((h ^ _seed(lang, salt)) * _MIX) & _M64
    h ^= h >> 32
    return (h * _STEP) & _M64


def _mixed(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``gram_hash`` from the sums over symbols, for arrays."""
    h = (h ^ seed) * np.uint64(_MIX)
    return (h ^ (h >> np.uint64(32))) * np.uint64(_STEP)


class Model:
    """Sorted hashes of n-grams, log probabilities and back-off weights; not a number where an entry has none."""

    def __init__(self, keys: np.ndarray, lps: np.ndarray, bows: np.ndarray, order: int, salt: int):
        self.keys, self.lps, self.bows, self.order, self.salt = keys, lps, bows, order, salt
        self.first = None
        self.seeds: dict[str, int] = {}

    def seed(self, lang: str) -> int:
        if lang not in self.seeds:
            self.seeds[lang] = _seed(lang, self.salt)
        return self.seeds[lang]

    def entry(self, lang: str, gram: str) -> tuple[float | None, float | None]:
        """Log probability and back-off weight of one n-gram; None where the model has none."""
        k = gram_hash(lang, gram, self.salt)
        i = int(np.searchsorted(self.keys, np.uint64(k)))
        if i == len(self.keys) or int(self.keys[i]) != k:
            return None, None
        lp, bow = float(self.lps[i]), float(self.bows[i])
        return (None if lp != lp else lp), (None if bow != bow else bow)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes in the arrays, -1 for those that are not there."""
        n = len(self.keys)
        if not n:
            return np.full(len(h), -1)
        if self.first is None:  # where the keys of each leading bits begin
            self.bits = max(1, n.bit_length())
            self.first = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        at = np.minimum(self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)], n - 1).astype(np.int64)
        out = np.where(self.keys[at] == h, at, -1)
        rest = np.flatnonzero(self.keys[at] < h)
        at = at[rest]
        while len(rest):
            at += 1
            inside = at < n
            rest, at = rest[inside], at[inside]
            k = self.keys[at]
            hit = k == h[rest]
            out[rest[hit]] = at[hit]
            on = k < h[rest]
            rest, at = rest[on], at[on]
        return out

    def log_probabilities(self, codes: np.ndarray, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of the symbols at some places given those before them, and which were not found whole.

        The whole n-gram first; one that the model doesn't have backs off.
        """
        sums = [np.zeros(len(at), dtype=np.uint64)]
        up = np.uint64(1)
        own = codes.astype(np.uint64) + np.uint64(1)
        for j in range(self.order):
            sums.append(sums[-1] + own[at - j] * up)
            up = np.uint64((int(up) * _STEP) & _M64)
        place = self.find(_mixed(sums[self.order], seed))
        lp = np.where(place >= 0, self.lps[place], np.nan) if len(self.keys) else np.full(len(at), np.nan)
        lp = lp.astype(np.float64)
        missing = np.isnan(lp)
        todo = np.flatnonzero(missing)
        extra = np.zeros(len(todo))
        for k in range(self.order - 1, -1, -1):
            if not len(todo):
                break
            # The context of the n-gram of k + 1 symbols: those k before the last.
            h = np.zeros(len(todo), dtype=np.uint64)
            up = np.uint64(1)
            for j in range(1, k + 1):
                h = h + own[at[todo] - j] * up
                up = np.uint64((int(up) * _STEP) & _M64)
            place = self.find(_mixed(h, seed[todo]))
            bow = np.where(place >= 0, self.bows[place], 0.0) if len(self.keys) else np.zeros(len(todo))
            extra = extra + np.where(np.isnan(bow), 0.0, bow)
            if k == 0:
                lp[todo] = extra + np.log(_NOVEL)
                break
            place = self.find(_mixed(sums[k][todo], seed[todo]))
            got = np.where(place >= 0, self.lps[place], np.nan) if len(self.keys) else np.full(len(todo), np.nan)
            done = ~np.isnan(got)
            lp[todo[done]] = extra[done] + got[done]
            todo, extra = todo[~done], extra[~done]
        return lp, missing

    def text_log_probability(self, lang: str, text: str) -> float:
        """Log probability of the symbols of a text, the space after its last word included."""
        total = 0.0
        for part in _pieces(text, self.order):
            codes, at, _ = symbols([part], self.order)
            total += float(self.log_probabilities(codes, at, np.full(len(at), self.seed(lang), dtype=np.uint64))[0].sum())
        return total


def hash_arrays(model: DataFrame, order: int, salt: int = 0) -> Model:
    """The rows of a model (lang, gram, lp, bow) as arrays on the driver; its caller bounds their number.

    Each n-gram has an entry of its own: if two share a hash, the next salt is taken.
    """

    def run(batches):
        seeds: dict[str, int] = {}
        for batch in batches:
            langs, grams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x in set(langs).difference(seeds):
                seeds[x] = _seed(x, salt)
            size = np.array([len(g) for g in grams])
            keys = np.zeros(len(grams), dtype=np.uint64)
            seed = np.array([seeds[x] for x in langs], dtype=np.uint64)
            for k in set(size.tolist()):
                rows = np.flatnonzero(size == k)
                h = np.zeros(len(rows), dtype=np.uint64)
                if k:
                    codes = np.frombuffer("".join(grams[i] for i in rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, k).astype(np.uint64)
                    for j in range(k):
                        h = h * np.uint64(_STEP) + codes[:, j] + np.uint64(1)
                keys[rows] = _mixed(h, seed[rows])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(2), batch.column(3)], names=["key", "lp", "bow"])

    hashed = model.select("lang", "gram", F.col("lp").cast("float").alias("lp"), F.col("bow").cast("float").alias("bow")).mapInArrow(run, "key long, lp float, bow float")
    rows = hashed.toArrow()  # one for each n-gram of the model
    key = rows.column("key").to_numpy().view(np.uint64)
    at = np.argsort(key, kind="stable")
    if (key[at][1:] == key[at][:-1]).any():
        return hash_arrays(model, order, salt + 1)
    as_float = lambda c: rows.column(c).to_pandas().to_numpy(dtype=np.float32, na_value=np.nan)[at]
    return Model(key[at], as_float("lp"), as_float("bow"), order, salt)


def frequent(model: DataFrame, entries: int) -> tuple[DataFrame, bool]:
    """The entries of a model of at least some count, as low as leaves ``entries`` of them at most; and whether these are all."""
    step = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1))) * 8).cast("int")
    bins = sorted(((r["b"], r["c"]) for r in model.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)  # 8 x 63 bins at most
    total, least = 0, None
    for b, c in bins:
        if total + c > entries:
            return model.filter(step >= least) if least is not None else model.limit(0), False
        total, least = total + c, b
    return model, True


def score(docs: DataFrame, model: DataFrame, order: int, key: str = "doc_id", broadcast_entries: int = 8_000_000) -> DataFrame:
    """Base counts and log perplexity of each document under the model of a corpus that holds it; null perplexity without words."""
    whole = model.filter(F.char_length("gram") == order)
    held, every = frequent(whole, broadcast_entries)
    sent = docs.sparkSession.sparkContext.broadcast(hash_arrays(held, order))
    schema = f"{key} long, lang string, tid binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lp double, n_missing long"

    def groups(texts: list[str], langs: list[str]):
        """(codes, places, documents, seeds) of texts, some at a time."""
        parts, docs_, size = [], [], 0
        for i, text in enumerate(texts):
            for part in _pieces(text, order) if text else ():
                parts.append(part)
                docs_.append(i)
                size += len(part[1])
                if size > _TOGETHER:
                    yield parts, np.array(docs_)
                    parts, docs_, size = [], [], 0
        if parts:
            yield parts, np.array(docs_)

    def placed(batch):
        known = sent.value
        texts, langs = [x or "" for x in batch.column(2).to_pylist()], [x or "" for x in batch.column(1).to_pylist()]
        seeds = np.array([known.seed(x) for x in langs], dtype=np.uint64)
        for parts, docs_ in groups(texts, langs):
            codes, at, which = symbols(parts, order)
            doc = docs_[which]
            lp, missing = known.log_probabilities(codes, at, seeds[doc])
            yield texts, langs, codes, at, doc, lp, missing

    def tid(text: str) -> bytes:
        return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    @lean
    def run(batches):
        for batch in slices(batches):
            base = [(len(words), *rest_) for words, *rest_ in map(base_counts, batch.column(2).to_pylist())]
            total, lost = np.zeros(len(base)), np.zeros(len(base), dtype=np.int64)
            for _, _, _, _, doc, lp, missing in placed(batch):
                total += np.bincount(doc, weights=np.where(missing, 0.0, lp), minlength=len(base))
                lost += np.bincount(doc[missing], minlength=len(base))
            ids = [None] * len(base) if every else [tid(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array([b[0] for b in base], pa.int64())]
                + [pa.array([b[i] for b in base], pa.int64()) for i in (1, 2, 3, 4)] + [pa.array(total), pa.array(lost)],
                names=[key, "lang", "tid", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lp", "n_missing"],
            )

    @lean
    def rest(batches):
        """(lang, tid, gram, n): n-grams that workers don't hold."""
        for batch in slices(batches):
            for texts, langs, codes, at, doc, _, missing in placed(batch):
                found = Counter()
                for i, a in zip(doc[missing].tolist(), at[missing].tolist()):
                    found[i, codes[a - order + 1 : a + 1].astype("<u4").tobytes()] += 1
                ids = {i: tid(texts[i]) for i, _ in found}
                for k in range(0, len(found), 100_000):
                    some = list(found.items())[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([langs[i] for (i, _), _ in some], pa.string()), pa.array([ids[i] for (i, _), _ in some], pa.binary()), pa.array([g.decode("utf-32-le", "surrogatepass") for (_, g), _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())],
                        names=["lang", "tid", "gram", "n"],
                    )

    rows = docs.select(F.col(key).cast("long").alias(key), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    x = stash(rows.mapInArrow(run, schema), "quality")
    if not every:
        lost = rows.mapInArrow(rest, "lang string, tid binary, gram string, n long")
        # A text that comes twice sends its n-grams twice; the mean doesn't change.
        more = lost.join(whole.select("lang", "gram", F.col("lp").cast("float").cast("double").alias("lp")), ["lang", "gram"]).groupBy(F.col("lang").alias("_lang"), F.col("tid").alias("_tid")).agg((F.sum(F.col("n") * F.col("lp")) / F.sum("n")).alias("_mean"))
        x = x.join(more, (F.coalesce("lang", F.lit("")) == F.col("_lang")) & (F.col("tid") == F.col("_tid")), "left")
        x = stash(x.withColumn("lp", F.col("lp") + F.coalesce(F.col("_mean") * F.col("n_missing"), F.lit(0.0))).drop("_lang", "_tid", "_mean"), "quality")
    sent.destroy()  # the scores are stored
    n = F.col("word_chars") + F.col("n_words")
    return x.select(key, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.when(n > 0, -F.col("lp") / n).alias("log_ppl"))


def quartiles(x: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, q1, q2, q3): quartiles of the distinct values in each group, in steps of ``_GRID``; the same however the rows lie."""
    distinct = x.filter(F.col(value).isNotNull()).select(*by, value).distinct()
    cells = distinct.groupBy(*by, F.round(F.col(value) / _GRID).cast("long").alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    cells = cells.withColumn("_upto", F.sum("_n").over(w.orderBy("_cell"))).withColumn("_all", F.sum("_n").over(w))
    at = lambda share: F.min(F.when(F.col("_upto") >= share * F.col("_all"), F.col("_cell"))) * _GRID
    return cells.groupBy(*by).agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def judge(
    docs: DataFrame, key: str = "doc_id", order: int = 5, below: float = 5.0, above: float = 5.0, least_spread: float = 0.01, min_words: int = 50, broadcast_entries: int = 8_000_000,
) -> DataFrame:
    """Counts, log perplexity, its band, ``base_failed`` and ``kept`` for every document.

    Columns: key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    log_ppl, low, high, base_failed, kept. Null and empty texts have no words and
    fail the base rules; a null language is one of its own. Repeated rows are
    judged alike. A perplexity on the edge of a band is inside it. An empty table
    gives an empty result. Other columns are not read.
    """
    text = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    model = kneser_ney(count_ngrams(text, order), order)
    x = score(docs, model, order, key, broadcast_entries)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    x = x.withColumn("base_failed", failed).withColumn("_size", F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int"))
    q = quartiles(x.filter("not base_failed"), ["lang", "_size"], "log_ppl")
    under, over = F.greatest(F.col("q2") - F.col("q1"), F.lit(least_spread)), F.greatest(F.col("q3") - F.col("q2"), F.lit(least_spread))
    q = q.select(F.col("lang").alias("_l"), F.col("_size").alias("_s"), (F.col("q2") - below * under).alias("low"), (F.col("q2") + above * over).alias("high"))
    x = x.join(q, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("_size") == F.col("_s")), "left").drop("_l", "_s", "_size")
    kept = ~F.col("base_failed") & F.col("log_ppl").between(F.col("low"), F.col("high"))
    return x.withColumn("kept", F.coalesce(kept, F.lit(False)))
