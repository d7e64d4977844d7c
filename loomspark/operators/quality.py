"""Output quality in four dimensions and the refine loop (J12, J13); near-duplicate windows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LOW_CONFIDENCE, jaccard, like, long_words

WEIGHTS = {"completeness": 0.25, "accuracy": 0.30, "consistency": 0.25, "readability": 0.20}


def dimensions(text: Column) -> dict[str, Column]:
    """Scores of the dimensions, each one less its penalties, 0 at least."""
    n = F.char_length(text)
    pen = lambda cond, p: F.when(cond, p).otherwise(0.0)
    low = sum((like(text, p).cast("int") for p in LOW_CONFIDENCE), F.lit(0))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.char_length(w) > 3)
    repeat = F.when(F.size(words) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(words)) / F.size(words))
    longest = F.array_max(F.transform(F.split(text, r"[.!?\n]+"), F.char_length))
    out = {
        "completeness": 1 - pen(like(text, r"(?i)\b(TODO|FIXME|TBD)\b|\[TODO\]"), 0.2) - pen(n < 20, 0.3) - pen(like(text, r"\.\.\.\s*\z"), 0.15),
        "accuracy": 1 - pen(like(text, r"(?i)\b(error|failed|exception|crash)\b"), 0.15) - pen(like(text, r"(?i)\b(undefined|null)\b"), 0.1) - pen(like(text, r"(?i)\bnot found\b|\bdoes not exist\b"), 0.1) - F.least(F.lit(0.3), low * 0.1),
        "consistency": 1 - pen(like(text, r"(?i)\b(but|however)\b.*\bnot\b"), 0.2) - pen(like(text, r"(?i)\bon the one hand\b.*\bon the other hand\b"), 0.1) - pen(repeat > 0.5, 0.2),
        "readability": 1 - pen(longest > 400, 0.2) - pen((n > 2000) & ~text.contains("\n"), 0.2),
    }
    return {k: F.greatest(F.lit(0.0), v) for k, v in out.items()}


def overall(text: Column) -> Column:
    """Struct of the dimensions, the weighted score (two places) and whether it passes 0.7; 0 for blank text."""
    d = dimensions(F.substring(text, 1, 50_000))
    s = F.floor(sum((d[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)) * 100 + 0.5) / 100
    s = F.when(F.trim(text) == "", 0.0).otherwise(s)
    return F.struct(*[F.round(v, 4).alias(k) for k, v in d.items()], s.alias("score"), (s >= 0.7).alias("passed"))


def near_duplicates(messages: DataFrame, by: list[str], idx: str, text: str = "content", window: int = 10, threshold: float = 0.7) -> DataFrame:
    """Adds ``duplicate``: like one of the last ``window`` messages (words of more than three letters)."""
    w = Window.partitionBy(*by).orderBy(idx).rowsBetween(-window, -1)
    x = messages.withColumn("_w", long_words(F.col(text)))
    x = x.withColumn("_before", F.collect_list("_w").over(w))
    return x.withColumn("duplicate", F.exists("_before", lambda b: jaccard(b, F.col("_w")) > threshold)).drop("_w", "_before")


_HEDGES = re.compile(r"\b(?:I think|I believe|maybe|perhaps|possibly|probably)\b,?\s*", re.IGNORECASE)


def refine_once(text: str) -> str:
    """One rule-based rewrite: hedges, repeated sentences and runs of blanks go."""
    out, seen = [], set()
    for s in re.split(r"(?<=[.!?])\s+", _HEDGES.sub("", text)):
        if (k := s.strip().lower()) and k not in seen:
            seen.add(k)
            out.append(s.strip())
    return re.sub(r"[ \t]+", " ", " ".join(out))


def _similar(a: str, b: str) -> float:
    x, y = ({w for w in t.lower().split() if len(w) > 2} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def _refined(t: str | None) -> str | None:
    if t is None:
        return None
    for _ in range(3):
        new = refine_once(t)
        if _similar(t, new) > 0.95:
            return new
        t = new
    return t


def refine(text: Column) -> Column:
    """Up to three rewrites, until one changes less than a twentieth of the words."""
    
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_refined)

    return F.pandas_udf(run, "string")(text)


_VERBS = ("has|have", "contains|includes", "depends on|requires|needs", "writes|runs|builds|owns|manages|uses|supports|stores|deploys|reviews|generates|produces")
_TRIPLE = [re.compile(rf"\b((?:[A-Z][\w-]*\s?){{1,3}})\s+({v})\s+(?:the |a |an )?((?:[A-Z][\w-]*\s?){{1,3}})") for v in _VERBS]


def _relations(t: str | None) -> list[dict]:
    found = {}
    for p in _TRIPLE:
        for a, v, b in p.findall(t or ""):
            if len(a.strip()) >= 3 and len(b.strip()) >= 3:
                found.setdefault((a.strip(), v, b.strip()), None)
    return [dict(zip(("subject", "verb", "object"), k)) for k in found][:50]


def relations(text: Column) -> Column:
    """(subject, verb, object) of capitalized names around a relation verb; 50 at most."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_relations)

    return F.pandas_udf(run, "array<struct<subject:string,verb:string,object:string>>")(text)
