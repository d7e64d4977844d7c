"""Toxicity: noisy-channel deobfuscation, then a scorer learned from labels.

A word that may be disguised (signs or digits, letters said again, separators
inside, letters set apart by spaces) becomes a lattice: each sign may stand for
the letters it is written for, separators and the spaces between single letters
may be dropped or part words, repeats may collapse, each at a cost. The best path
under a character language model (modified Kneser-Ney, counted by Spark over all
documents) gives the restored words. The search is exact: a state is the context
of the model, and no state is dropped. Each distinct word is decoded once while a
worker remembers it, whatever its length. Features are the words as written and
as restored, and how they begin.

Learning: features of toxic documents are counted; those in ``min_share`` of
them or more are counted in the others too. A feature's weight is the lower end
of an interval for its log likelihood ratio, so that chance features weigh
nothing. A document's evidence is the largest weight of its words, the sum over
its distinct words, and its length; a logistic regression on counts by cell of
these three gives the score.

Bounds: at most ``features per document / min_share`` features can be in that
share of documents, so what is collected and broadcast doesn't grow with the
corpus; the cells are a fixed grid; at most about ``max_labels`` labelled rows
(chosen by hash) are learned from. The language model that is sent holds its most
frequent n-grams, ``max_ngrams`` at most; a rarer one backs off.

Left as written: numbers (digits and the punctuation of numbers alone), and words
cut into parts of several letters by spaces, which can't be told from prose.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality
from .common import slices, stash

ORDER = 4
#: What signs and digits are written for; a star hides a vowel.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "¡": "i", "*": "aeiou"}
SEPARATORS = ".-_*~'`,:;/\\· "
SEPARATOR = re.compile("[" + re.escape(SEPARATORS) + "]")
#: A letter that comes twice or more in a row, and a number.
AGAIN = re.compile(r"(.)\1+")
NUMBER = re.compile(r"[\d.,:;/+%€$-]*")
PARTS = re.compile(r"[-.,:;/\\_~'`·\s]+")
EDGE = ".,;:!?\"'()[]{}<>#*%&|~`-_=/\\·«»“”„…"
#: What may be taken from the edges of a word before it is decoded: none of these stands for a letter there.
TIGHT = ".,;:?\"'()[]{}<>#%&*~`-_=/\\·«»“”„…"
_KEEP = 150_000


@lru_cache(maxsize=20_000)
def readings(c: str, again: bool, costs: tuple[float, float, float, float]) -> tuple[tuple[str, float], ...]:
    """What a character may stand for ('' for nothing), and the costs; ``again`` if it is the one before it once more."""
    sign_cost, drop_cost, repeat_cost, plain = costs
    letters = SIGNS.get(c, "")
    out = [(c, 0.0 if c.isalpha() or c == " " else plain)] + [(x, sign_cost) for x in letters]
    drop = []
    if c in SEPARATORS:
        drop.append(drop_cost)
        if c != " ":
            out.append((" ", drop_cost))
    elif letters:
        drop.append(drop_cost + sign_cost)
    if again:
        drop.append(repeat_cost)
    return (*out, ("", min(drop))) if drop else tuple(out)


class Restorer:
    """Restores disguised words under a character model (``quality.Model``, counted inside words)."""

    def __init__(self, model: quality.Model, sign_cost: float = 1.0, drop_cost: float = 0.7, repeat_cost: float = 0.4, plain_sign_cost: float = 6.0):
        self.model = model
        self.costs = sign_cost, drop_cost, repeat_cost, plain_sign_cost
        self.found: dict[str, tuple[float | None, float | None]] = {}
        self.known: dict[str, float] = {}
        self.start = " " * (ORDER - 1)
        self.base = (self._entry("")[1] or 0.0) + float(np.log(quality._NOVEL))

    def _entry(self, gram: str) -> tuple[float | None, float | None]:
        got = self.found.get(gram)
        if got is None:
            if len(self.found) > 200_000:
                self.found.clear()
            got = self.found[gram] = self.model.entry("", gram)
        return got

    def logp(self, context: str, c: str) -> float:
        """Log probability of a symbol after a context of ``ORDER - 1`` symbols."""
        gram = context + c
        got = self.known.get(gram)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[gram] = self._backed_off(context, c)
        return got

    def _backed_off(self, context: str, c: str) -> float:
        extra = 0.0
        while True:
            lp = self._entry(context + c)[0]
            if lp is not None:
                return extra + lp
            if not context:
                return extra + self.base
            extra += self._entry(context)[1] or 0.0
            context = context[1:]

    def choices(self, c: str, last: str) -> tuple[tuple[str, float], ...]:
        """What a character may stand for ('' for nothing) after the one before it, and the costs."""
        return readings(c, c == last, self.costs)

    def restore(self, word: str) -> str:
        """The likeliest undisguised form of a lower-cased word; it may be several words."""
        logp, start = self.logp, self.start
        states: dict[str, tuple[float, tuple]] = {start: (0.0, ())}
        last = ""
        for c in word:
            after: dict[str, tuple[float, tuple]] = {}
            for x, cost in self.choices(c, last):
                for context, (score, path) in states.items():
                    if not x:
                        to, total, way = context, score - cost, path
                    elif x == " ":
                        if context == start:
                            to, total, way = context, score - cost, path
                        else:
                            to, total, way = start, score - cost + logp(context, " "), (path, " ")
                    else:
                        to, total, way = context[1:] + x, score - cost + logp(context, x), (path, x)
                    old = after.get(to)
                    if old is None or total > old[0]:
                        after[to] = (total, way)
            states = after
            last = c
        path = max((score + (logp(context, " ") if context != start else 0.0), context) for context, (score, _) in states.items())
        path = states[path[1]][1]
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out)).strip()

    def words(self, word: str, split: bool = True) -> list[str]:
        """A word as written, lower-cased and without punctuation at its edges, and as restored, if it may be disguised."""
        low = word.lower()
        bare = low.strip(EDGE)
        if not bare:
            return []
        if bare.isalpha():
            # A sign at an edge may be a letter, too: "!diot".
            tight = low.strip(TIGHT)
            if tight == bare and not AGAIN.search(bare):
                return [bare]
        else:
            tight = low.strip(TIGHT)
            if NUMBER.fullmatch(tight):
                return [bare]
        # The whole, and what stands between separators if that is more than letters set apart: "go,idiot".
        parts = [x for x in PARTS.split(tight) if len(x) > 1]
        parts = parts if split and (len(parts) > 1 or parts and parts[0] != tight) else []
        found = [x for t in (tight, *parts) for x in (w.strip(EDGE) for w in (t if t.isalpha() and not AGAIN.search(t) else self.restore(t)).split()) if x]
        return list(dict.fromkeys([bare, *found]))

    def plain(self, word: str) -> str:
        """The word restored, or as written where there is nothing to restore."""
        got = self.words(word, split=False)
        return " ".join(got[1:]) if len(got) > 1 else "".join(got)


def features(word: str) -> list[str]:
    """The word and its beginnings of three to eight characters."""
    return ["=" + word] + ["^" + word[:k] for k in range(3, 9) if len(word) > k] if word else []


def heads(wanted) -> frozenset[str]:
    """What a word must begin with, its first three characters, to have one of the features."""
    return frozenset(f[1:4] for f in wanted)


class _First:
    """What words must begin with to have one of the features: a quick test that never passes over a word that has."""

    COSTS = (0.0, 0.0, 0.0, 0.0)

    def __init__(self, wanted):
        self.heads = heads(wanted)
        self.ways = frozenset(h[:k] for h in self.heads for k in range(len(h)))

    def nothing(self, word: str) -> bool:
        """Whether no reading of a word begins, or has a word that begins, with one of the heads; most words have none."""
        low = word.lower()
        if low.isalpha():
            if low[:3] in self.heads or low[:2] in self.heads or low[:1] in self.heads:
                return False
            if not AGAIN.search(low[:8]):
                return True
        low = low.strip(TIGHT)
        at, last, states = 0, "", {""}
        while at < len(low):
            c = low[at]
            after = set()
            for x, _ in readings(c, c == last, self.COSTS):
                if x == " ":
                    after.add("")
                elif not x:
                    after |= states
                else:
                    for s in states:
                        if s + x in self.heads:
                            return False
                        if s + x in self.ways:
                            after.add(s + x)
            states, last, at = after, c, at + 1
            if not states:  # until a separator begins a word
                found = SEPARATOR.search(low, at)
                if not found:
                    return True
                at, last = found.start(), low[found.start() - 1]
        return True


def spaced(words: list[str]) -> list[str]:
    """Runs of words of one character: as they stand, spaces between; those of four and more also joined into one, and so without a first or last letter, which may be a word of its own."""
    runs, run = [], []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
        elif run:
            if len(run) > 1:
                runs.append(run)
            run = []
    out = [" ".join(r) for r in runs]
    for r in ("".join(r) for r in runs if len(r) > 3):
        out += [x for x in ((r, r[1:], r[:-1], r[1:-1]) if len(r) > 4 else (r,)) if len(x) > 3]
    return out


def document_words(text: str | None) -> tuple[set[str], int]:
    """Distinct words of a text, with the runs of letters set apart, and the number of words."""
    words = text.split() if text else []
    got = set(words)
    if list(map(len, words)).count(1) > 1:
        got.update(spaced(words))
    return got, len(words)


class _Memory:
    """What a worker knows of words, by distinct word: only those with something to say are looked at twice."""

    def __init__(self, of):
        self.of, self.known, self.hits, self.telling = of, set(), {}, set()

    def __getitem__(self, words: set[str]) -> list:
        """What the words among ``words`` that have something say."""
        if len(self.known) > _KEEP:
            self.known.clear()
            self.hits.clear()
            self.telling.clear()
        if new := words.difference(self.known):
            self.known |= new
            for w in new:
                if x := self.of(w):
                    self.hits[w] = x
                    self.telling.add(w)
        return [self.hits[w] for w in words & self.telling]


def _count(rows: DataFrame, arrays, only=None) -> DataFrame:
    """(f, pos, neg): documents with each feature, by label, of (text, y); with ``only`` (a broadcast set) the others are left out."""

    def run(batches):
        restorer = Restorer(arrays.value)
        wanted = None if only is None else only.value
        first = None if only is None else _First(wanted)

        def of(w):
            if first is not None and first.nothing(w):
                return ()
            found = {f for p in restorer.words(w) for f in features(p)}
            return found if wanted is None else found & wanted

        memory = _Memory(of)
        pos, neg = Counter(), Counter()

        def batch_of():
            f = list(pos.keys() | neg.keys())
            for i in range(0, len(f), 50_000):
                part = f[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([pos[x] for x in part], pa.int64()), pa.array([neg[x] for x in part], pa.int64())], names=["f", "pos", "neg"])
            pos.clear()
            neg.clear()

        for batch in slices(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (pos if y else neg).update({f for own in memory[document_words(text)[0]] for f in own})
            if len(pos) + len(neg) > 400_000:
                yield from batch_of()
        yield from batch_of()

    return rows.select("text", "y").mapInArrow(run, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _evidence(docs: DataFrame, arrays, weights) -> DataFrame:
    """(id, top, total, n): evidence of each document of (id, text)."""

    def run(batches):
        restorer, w = Restorer(arrays.value), weights.value
        first = _First(w)

        def of(x):
            if first.nothing(x):
                return 0.0
            return max((w.get(f, 0.0) for p in restorer.words(x) for f in features(p)), default=0.0)

        memory = _Memory(of)
        for batch in slices(batches):
            top, total, n = [], [], []
            for text in batch.column(1).to_pylist():
                words, count = document_words(text)
                found = memory[words]
                top.append(max(found, default=0.0))
                total.append(sum(found))
                n.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.float64()), pa.array(total, pa.float64()), pa.array(n, pa.int64())], names=["id", "top", "total", "n"])

    return docs.mapInArrow(run, "id long, top double, total double, n long")


#: Cells of the grid: steps of the largest weight, of the logarithm of the sum and of the logarithm of the length.
GRID = (("top", 0.5, 12.0), ("ltotal", 0.25, 8.0), ("ln", 1.0, 14.0))


def _inputs(x: DataFrame) -> DataFrame:
    x = x.withColumn("ltotal", F.log1p("total")).withColumn("ln", F.log1p("n"))
    for c, step, most in GRID:
        x = x.withColumn(c, F.least(F.lit(most), F.round(F.col(c) / step) * step))
    return x


def fit_logistic(cells: list[tuple[float, ...]], ridge: float = 1.0) -> list[float]:
    """Weights (constant first) from rows (inputs..., positives, negatives), by Newton steps."""
    if not cells:
        return [0.0] * (len(GRID) + 1)
    a = np.array(cells, dtype=np.float64)
    x, pos, n = np.column_stack([np.ones(len(a)), a[:, :-2]]), a[:, -2], a[:, -2] + a[:, -1]
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + keep, x.T @ (pos - n * p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labels: int = 30_000, min_share: float = 0.005, least_weight: float = 1.5, doubt: float = 2.5, max_ngrams: int = 8_000_000) -> DataFrame:
    """(key, score, predicted, top) for every document; ``labels`` (key, label) are what may be learned from.

    A null or empty text has no evidence and gets the score of such documents.
    Null labels teach nothing; of rows that share a key in ``labels`` the larger
    label holds. Without labels every score is 0.5 and predicted is 1. Rows of
    ``docs`` stay as they are, repeated ones too; an empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = stash(known, "tox-labels")
    n = known.count()
    if n > max_labels:
        known = known.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(1e6 * max_labels / n))
    lower = rows.select(F.lit("").alias("lang"), F.lower("text").alias("text"))
    grams = quality.kneser_ney(quality.count_ngrams(lower, ORDER, across=False), ORDER)
    model = sc.broadcast(quality.hash_arrays(quality.frequent(grams, max_ngrams)[0], ORDER))
    taught = rows.join(F.broadcast(known), "id")  # max_labels rows or so at most
    totals = {r["y"]: r["n"] for r in known.join(rows.select("id").distinct(), "id", "left_semi").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    often = _count(taught.filter("y = 1"), model).filter(F.col("pos") >= max(3, min_share * n_pos)).select("f")
    only = sc.broadcast(frozenset(r["f"] for r in often.collect()))  # bounded by the features of a document / min_share
    counts = _count(taught, model, only).collect()
    weights = {}
    for r in counts:
        p, q = r["pos"] + 0.5, r["neg"] + 0.5
        low = np.log(p / (n_pos + 1)) - np.log(q / (n_neg + 1)) - doubt * np.sqrt(1 / p + 1 / q)
        if low >= least_weight:
            weights[r["f"]] = float(low)
    x = stash(_evidence(rows, model, sc.broadcast(weights)), "tox-evidence")
    model.destroy()  # the evidence is stored
    names = [c for c, _, _ in GRID]
    cells = _inputs(x.join(F.broadcast(known), "id")).groupBy(*names).agg(F.sum("y"), F.sum(1 - F.col("y"))).collect()  # cells of the grid at most
    w = fit_logistic([tuple(map(float, r)) for r in sorted(cells)])
    z = F.lit(w[0])
    for c, v in zip(names, w[1:]):
        z = z + F.lit(v) * F.col(c)
    out = _inputs(x).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
    return out.select(F.col("id").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "top")
