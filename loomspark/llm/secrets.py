"""Secret scans: fixed patterns, and password guess costs of values in a credential context.

The guess cost of a value is the smallest sum, over its segmentations, of the
logarithms (base 10) of the guesses that each segment takes: dictionary words by
rank, dates, repeats, runs along keyboard rows and through the alphabet, and
brute force for what is left. Values that would take ``10 ** min_cost`` guesses
or more are secrets; those that cost less are placeholders, names and prose.

The dictionary is a list of common words of passwords and code, then the words of
the corpus by how often Spark counts them: ``dictionary`` words in all, whatever the
corpus. Scanning alone (``scan``) knows the list only, unless ranks are given.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words of a credential context, wider than those of ``ASSIGN``; a value follows an equals sign, a colon or an arrow, with any run of spaces and tabs at both sides.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?|credentials?|bearer|login|signature)["']?[\x20\t]*+(?:=>|:=|[:=])[\x20\t]*+(?:bearer[\x20\t]++)?["'`]?([!-!#-&(-_a-~]{6,})""",
    re.ASCII | re.IGNORECASE,
)
#: Any text that ``CONTEXT`` matches holds one of these (in lower case).
HINTS = ("pass", "pwd", "secret", "token", "api", "key", "auth", "credential", "bearer", "login", "signature")
KINDS = ("assign", "access", "hex", "guess")

#: Common words of passwords, placeholders and code, most common first; their places are their ranks.
COMMON = (
    "password", "qwerty", "admin", "welcome", "login", "abc", "letmein", "monkey", "dragon", "master", "sunshine", "princess", "football",
    "shadow", "baseball", "superman", "trustno", "iloveyou", "hello", "freedom", "whatever", "starwars", "computer", "michael", "charlie",
    "jordan", "hunter", "batman", "soccer", "killer", "secret", "test", "testing", "example", "sample", "default", "changeme", "change",
    "root", "user", "guest", "demo", "temp", "public", "private", "server", "data", "value", "your", "my", "the", "this", "that", "here",
    "none", "null", "true", "false", "string", "text", "name", "key", "token", "api", "pass", "auth", "redacted", "removed", "hidden",
    "placeholder", "insert", "enter", "todo", "xxx", "foo", "bar", "baz", "dummy", "fake", "mock", "local", "dev", "prod", "stage",
    "staging", "system", "service", "account", "client", "get", "set", "read", "from", "process", "env", "environ", "environment", "config", "settings",
    "self", "args", "input", "request", "response", "header", "session", "param", "http", "https", "localhost", "www", "com", "org", "net",
    "home", "file", "path", "load", "open", "var", "vault", "os", "new", "is", "not", "must", "be", "love", "summer", "winter", "spring",
    "autumn", "monday", "friday", "january", "june", "july", "august", "december", "angel", "tiger", "orange", "purple", "silver", "golden",
    "flower", "cookie", "pepper", "ginger", "maggie", "buster", "hockey", "ranger", "harley", "thomas", "robert", "daniel", "andrew",
    "joshua", "ashley", "jessica", "house", "garden", "mountain", "river", "ocean", "window", "music", "guitar", "coffee", "butter",
)
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
_PLAIN = str.maketrans("@4301!57$", "aaeoiists")
_NEXT = {(a, b) for row in ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
#: What stands between the words of a name, a path or a call; guessed among as many.
JOINTS = "._-/:()[]"
#: A unit that is said again has up to this many characters.
_UNIT = 8


class Ranks:
    """Ranks of the words of a dictionary, most common first."""

    def __init__(self, words):
        self.rank: dict[str, int] = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)
        self.cost = lru_cache(maxsize=50_000)(lambda value: _guess_cost(value, self))


def corpus_words(docs: DataFrame, dictionary: int, text: str = "text", least: int = 10) -> list[str]:
    """The most frequent words of three to twenty letters, a to z, of all texts, lower-cased; ties by the word.

    Counted in full; a task sends each distinct word once. Words that occur fewer
    than ``least`` times are nobody's guess.
    """

    @lean
    def run(batches):
        n: Counter[str] = Counter()

        def flush():
            words = list(n)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[w] for w in part], pa.int64())], names=["word", "n"])
            n.clear()

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                if t:
                    n.update(t.split())
            if len(n) > 100_000:
                yield from flush()
        yield from flush()

    # Words are bared of their punctuation after they are counted as written: far fewer.
    written = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    bare = F.regexp_extract(F.lower("word"), r"^[^a-z]*([a-z]{3,20})[^a-z]*$", 1)
    counted = written.select(bare.alias("word"), "n").filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(dictionary).collect()]  # ``dictionary`` rows


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


def guess_cost(value: str, ranks: Ranks | None = None) -> float:
    """Base-10 logarithm of the guesses that the cheapest segmentation takes; 0 for an empty value.

    Segments: a word (its rank, doubled for capitals and for signs in place of
    letters), a date (its days), a repeat of a unit (the unit's own least cost and
    the number of times), a run between neighbours of a keyboard row or the alphabet
    (its start, direction and length), a joint between words, or one character by
    brute force. Runs and repeats of any length count. Of a repeat of more than 64
    times, and of a run of more than 40 characters, the parts that are offered are
    those up to these lengths and the whole.
    """
    return (ranks or _OWN).cost(value)


def _guess_cost(value: str, ranks: Ranks) -> float:
    n, low = len(value), value.lower()
    low = low if len(low) == n else value
    plain = low.translate(_PLAIN)
    ends: dict[int, list[tuple[int, float]]] = {}
    for m in (DATE.match(value, i) for i in range(n)):
        if m:
            ends.setdefault(m.end(), []).append((m.start(), math.log10(365 * 120)))
    # Runs of neighbours, longest from each start.
    run = [1] * n
    for i in range(n - 2, -1, -1):
        if (low[i], low[i + 1]) in _NEXT:
            run[i] = run[i + 1] + 1
    for i in range(n):
        for k in (*range(3, min(run[i], 40) + 1), *([run[i]] if run[i] > 40 else ())):
            ends.setdefault(i + k, []).append((i, math.log10(47 * 2 * k)))
    same = [0] * (_UNIT + 1)  # characters up to here that are like those a unit before
    best = [0.0] + [math.inf] * n
    for i in range(1, n + 1):
        c = value[i - 1]
        top = best[i - 1] + (math.log10(len(JOINTS)) if c in JOINTS else _brute(c))
        for j in range(max(0, i - ranks.longest), i - 1):
            for text, extra in ((low, 0.0), (plain, math.log10(2))):
                rank = ranks.rank.get(text[j:i])
                if rank:
                    shift = math.log10(2) if value[j:i] != low[j:i] else 0.0
                    top = min(top, best[j] + math.log10(rank + 1) + extra + shift)
        for j, cost in ends.get(i, ()):
            top = min(top, best[j] + cost)
        for k in range(1, _UNIT + 1):
            same[k] = same[k] + 1 if i > k and value[i - 1] == value[i - 1 - k] else 0
            if times := same[k] // k:
                times += 1
                unit = ranks.cost(value[i - k : i])
                for t in (*range(2, min(times, 64) + 1), *([times] if times > 64 else ())):
                    top = min(top, best[i - t * k] + unit + math.log10(t))
        best[i] = top
    return best[n]


_OWN = Ranks(COMMON)


def scan(text: str | None, min_cost: float = 10.0, ranks: Ranks | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start, then kind in the order of ``KINDS``; code points, end exclusive."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        out += [(m.start(1), m.end(1), 3) for m in CONTEXT.finditer(text) if guess_cost(m[1], ranks) >= min_cost]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str | None, spans, mark: str = "[secret]") -> str | None:
    """The text with each run of overlapping or touching spans replaced by ``mark``."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            if not (parts and a == at and at):
                parts += [text[at:a], mark]
            at = b
        else:
            at = max(at, b)
    return "".join(parts) + text[at:]


def _dictionary(docs: DataFrame, text: str, dictionary: int):
    """Ranks of the common words and those of the corpus, sent to the workers; ``dictionary`` entries at most."""
    more = corpus_words(docs, max(0, dictionary - len(COMMON)), text) if dictionary > len(COMMON) else []
    return docs.sparkSession.sparkContext.broadcast((*COMMON, *more))


def find(docs: DataFrame, key: str = "doc_id", min_cost: float = 10.0, dictionary: int = 20_000) -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_guess, base_sha256, spans) for every document.

    ``spans`` holds all spans as kind:start:end, comma-joined; ``base_sha256`` is
    over those of the fixed patterns alone. Null and empty texts have no spans.
    Whole texts are read. Rows stay as they are, repeated ones too; an empty table
    gives an empty result; other columns are not read. A cost of just ``min_cost``
    is a secret.
    """
    schema = f"{key} long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    words = _dictionary(docs, "text", dictionary)

    @lean
    def run(batches):
        ranks = Ranks(words.value)
        for batch in slices(batches):
            found = [scan(t, min_cost, ranks) for t in batch.column(1).to_pylist()]
            counts = [[sum(k == kind for _, _, k in s) for s in found] for kind in KINDS]
            base = [hashlib.sha256(joined(x for x in s if x[2] != "guess").encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(map(joined, found), pa.string())], names=[key, "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str = "text", min_cost: float = 10.0, mark: str = "[secret]", dictionary: int = 20_000) -> DataFrame:
    """The same rows and columns, with every span of ``text`` replaced by ``mark``."""
    words = _dictionary(docs, text, dictionary)

    @F.pandas_udf("string")
    @lean
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = Ranks(words.value)
        for texts in parts:
            yield texts.map(lambda t: redact(t, scan(t, min_cost, ranks), mark))

    return docs.withColumn(text, run(F.col(text)))
