"""Rewriting of outputs (J13) and relation triples (I27, I28), all in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import js

# --- fixed values -------------------------------------------------------------
#: Marks of unfinished text; the first of each is taken out.
INCOMPLETE = (r"\bTODO\b", r"\bFIXME\b", r"\bWIP\b", r"(?i)\bwork in progress\b", r"\.\.\.\z", r"(?i)\bto be continued\b")
UNDEFINED, NULL = r"(?i)\bundefined\b", r"(?i)\bnull\b(?!\s*able)"
STOPWORDS = (
    "a", "an", "the", "this", "that", "these", "those", "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "is", "are", "was", "were", "be", "been", "being",
    "of", "to", "in", "on", "for", "with", "and", "or", "but", "as", "at", "by", "from", "it", "its", "i", "you", "he", "she", "they", "we", "me", "him", "her", "them", "us", "my", "your", "his", "their", "our",
)
VERBS = ("has|have", "contains|includes", "depends on|requires|needs", "writes|runs|cuts|builds|owns|manages|uses|supports|stores|searches|deploys|reviews|generates|produces|designs")
LEAST_LETTERS, MOST_WORDS, MOST_RELATIONS, SHOWN_RELATIONS = 3, 3, 50, 10
# ------------------------------------------------------------------------------


def refine(text: Column, feedback: Column) -> Column:
    """One rewrite: marks of unfinished text go, undefined and null get words; a text that this leaves as it is gets the feedback behind it."""
    new = text
    for p in INCOMPLETE:
        new = F.regexp_replace(new, "(?s)\\A(.*?)" + js(p) if not p.startswith("(?i)") else "(?s)\\A(.*?)(?i:" + js(p[4:]) + ")", "$1")
    new = F.regexp_replace(F.regexp_replace(new, js(UNDEFINED), "specified"), js(NULL), "none")
    told = F.concat(text, F.lit("\n\n[Refined based on: "), feedback, F.lit("]"))
    return F.when((F.length(text) > 0) & (F.length(feedback) > 0), F.when(new == text, told).otherwise(new)).otherwise(text)


def similarity(a: Column, b: Column) -> Column:
    """Common words of more than two characters to all of them; 0 if either text has none."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: F.char_length(w) > 2))
    both, every = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when((F.size(words(a)) == 0) | (F.size(words(b)) == 0), 0.0).otherwise(both / F.greatest(every, F.lit(1)))


def self_refine(df, text: str, evaluate: Callable[[Column], Column], most: int = 2):
    """Adds ``refined``, ``loops``, ``score``, ``accepted``: rewrites while the evaluation fails, until one changes next to nothing.

    ``evaluate`` gives a struct (score, passed, feedback); texts that pass are left alone.
    """
    x = df.withColumns({"refined": F.col(text), "loops": F.lit(0), "_done": F.lit(False)}).withColumn("_e", evaluate(F.col(text)))
    for _ in range(most):
        x = x.withColumn("_go", ~F.col("_done") & ~F.col("_e.passed")).withColumn("_new", F.when(F.col("_go"), refine(F.col("refined"), F.col("_e.feedback"))))
        x = x.withColumn("_same", F.col("_go") & (similarity(F.col("_new"), F.col("refined")) > 0.95))
        x = x.withColumn("refined", F.when(F.col("_go"), F.col("_new")).otherwise(F.col("refined")))
        again = F.col("_go") & ~F.col("_same")
        x = x.withColumns({"_e": F.when(again, evaluate(F.col("refined"))).otherwise(F.col("_e")), "loops": F.when(again, F.col("loops") + 1).otherwise(F.col("loops")), "_done": F.col("_done") | F.col("_same")})
    return x.select(*df.columns, "refined", "loops", F.col("_e.score").alias("score"), F.col("_e.passed").alias("accepted"))


def _pattern(verbs: str) -> str:
    every = "|".join(VERBS).replace("depends on", "depends")
    token = rf"(?!(?:{every})\b)(?!(?:and|or|but)\b)[A-Za-z][A-Za-z0-9_-]*"
    entity = rf"(?:{token})(?:\s+{token}){{0,{MOST_WORDS - 1}}}"
    return js(rf"(?i)\b({entity})\s+({verbs})\s+({entity})")


def _name(raw: Column) -> Column:
    """An entity's words without stopwords at either end."""
    words = F.split(F.trim(raw), r"\s+")
    stop = lambda w: F.lower(w).isin(*STOPWORDS)
    good = F.filter(F.transform(words, lambda w, i: F.when(stop(w), None).otherwise(i)), lambda i: i.isNotNull())
    first, last = F.array_min(good), F.array_max(good)
    return F.when(F.size(good) > 0, F.array_join(F.slice(words, first + 1, last - first + 1), " ")).otherwise("")


TRIPLES = "array<struct<subject:string,predicate:string,object:string,kind:int>>"


def _good(name: Column) -> Column:
    return (F.char_length(name) >= LEAST_LETTERS) & ~F.lower(name).isin(*STOPWORDS)


def relations(text: Column) -> Column:
    """(subject, predicate, object) around relation verbs, each once; a name has three letters at least and is no stopword.

    From fifty on, each further kind of verb adds one at most.
    """
    kinds = []
    for kind, verbs in enumerate(VERBS):
        a, v, b = (F.regexp_extract_all(text, F.lit(_pattern(verbs)), F.lit(i)).alias(n) for i, n in ((1, "a"), (2, "v"), (3, "b")))
        kinds.append(_named(F.arrays_zip(a, v, b), F.lit(kind)))
    every = F.filter(F.coalesce(F.concat(*kinds), F.array().cast(TRIPLES)), lambda t: _good(t["subject"]) & _good(t["object"]))
    same = lambda x, t: (F.lower(x["subject"]) == F.lower(t["subject"])) & (x["predicate"] == t["predicate"]) & (F.lower(x["object"]) == F.lower(t["object"]))

    def step(found: Column, t: Column) -> Column:
        full = (F.size(found) >= MOST_RELATIONS) & (F.try_element_at(found, F.lit(-1))["kind"] == t["kind"])
        known = F.exists(found, lambda x: same(x, t))
        return F.when((F.size(found) > 0) & (full | known), found).otherwise(F.concat(found, F.array(t)))

    found = F.aggregate(every, F.array().cast(TRIPLES), step)
    return F.transform(found, lambda t: F.struct(t["subject"].alias("subject"), t["predicate"].alias("predicate"), t["object"].alias("object")))


def _named(matches: Column, kind: Column) -> Column:
    return F.transform(matches, lambda t: F.struct(_name(t["a"]).alias("subject"), F.lower(t["v"]).alias("predicate"), _name(t["b"]).alias("object"), kind.alias("kind")))


def graph_text(text: Column, triples: Column) -> Column:
    """A text's relations as lines, ten at most; a text without any is itself."""
    lines = F.transform(F.slice(triples, 1, SHOWN_RELATIONS), lambda r: F.concat(F.lit("  "), r["subject"], F.lit(" --["), r["predicate"], F.lit("]--> "), r["object"]))
    head = F.concat(F.lit("[Structured Data: Knowledge Graph — "), F.size(triples).cast("string"), F.lit(" relations]\n"))
    return F.when(F.size(triples) > 0, F.concat(head, F.array_join(lines, "\n"))).otherwise(text)
