"""Rewrites, relation triples and subagents' memories against plain versions."""

import re

import pytest
from pyspark.sql import functions as F

from loomspark.operators import recall, refine
from loomspark.functions import text as tx


@pytest.mark.parametrize(
    "text, want",
    [
        ("undefined. TODO", "specified. "), ("TODO one TODO", " one TODO"), ("null nullable NULL able", "none nullable NULL able"), ("wait...", "wait"), ("a ... b", None), ("Work In Progress\nto be continued", "\n"),
        ("autoTODO stays", None), ("", ""), (None, None), ("é TODO é", "é  é"), ("fine", None),
    ],
)
def test_refine(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(refine.refine(F.col("t"), F.lit("why")).alias("r")).first().r
    assert got == (want if want is not None or text is None else text + "\n\n[Refined based on: why]")


def test_the_loop_stops(spark):
    judge = lambda c: F.struct(F.when(c.contains("undefined"), 0.2).otherwise(0.9).alias("score"), (~c.contains("undefined")).alias("passed"), F.lit("unclear").alias("feedback"))
    df = spark.createDataFrame([(1, "it is undefined"), (2, "good text"), (3, "an undefinedness of many many words that stays as it was before")], "id long, t string")
    out = {r.id: r for r in refine.self_refine(df, "t", judge).collect()}
    assert (out[1].refined, out[1].loops, out[1].accepted) == ("it is specified", 1, True)
    assert (out[2].refined, out[2].loops, out[2].accepted) == ("good text", 0, True)
    assert out[3].accepted is False and out[3].refined.count("[Refined based on: unclear]") >= 1


def plain(text):
    every = "has|have|contains|includes|depends|requires|needs|writes|runs|cuts|builds|owns|manages|uses|supports|stores|searches|deploys|reviews|generates|produces|designs"
    token = rf"(?!(?:{every})\b)(?!(?:and|or|but)\b)[A-Za-z][A-Za-z0-9_-]*"
    entity, out, seen = rf"(?:{token})(?:\s+{token}){{0,2}}", [], set()

    def name(s):
        w = s.split()
        while w and w[0].lower() in refine.STOPWORDS:
            w.pop(0)
        while w and w[-1].lower() in refine.STOPWORDS:
            w.pop()
        return " ".join(w)

    for verbs in refine.VERBS:
        for a, v, b in re.findall(rf"\b({entity})\s+({verbs})\s+({entity})", text or "", re.I | re.A):
            t = (name(a), v.lower(), name(b))
            key = tuple(x.lower() for x in t)
            if min(len(t[0]), len(t[2])) < 3 or t[0].lower() in refine.STOPWORDS or t[2].lower() in refine.STOPWORDS or key in seen:
                continue
            seen.add(key)
            out.append(t)
            if len(out) >= 50:
                break
    return out


TEXTS = [
    "the gateway service requires a token store", "Core Team designs Event Bus", "Alpha builds Beta and Gamma reviews Delta", "what is the thing", "Ci has it", "The engine HAS a cache. the engine has A Cache!", "service depends on\n  the main database or files",
    "A tool uses x", "", None, " ".join(f"part{i}x has item{i}x." for i in range(70)) + " Alpha builds Beta. Gamma owns Delta.", "über gateway uses data-store_1 now then later",
]


@pytest.mark.parametrize("text", TEXTS)
def test_relations_match_a_plain_version(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(refine.relations(F.col("t")).alias("r")).first().r
    assert [tuple(r) for r in got] == plain(text)


def test_known_relations(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS[:3]], "t string").withColumn("r", refine.relations(F.col("t")))
    texts = [r[0] for r in df.select(refine.graph_text(F.col("t"), F.col("r"))).collect()]
    assert texts[0].endswith("1 relations]\n  gateway service --[requires]--> token store")
    assert texts[1].endswith("  Core Team --[designs]--> Event Bus")
    assert texts[2].split("\n")[1:] == ["  Alpha --[builds]--> Beta", "  Gamma --[reviews]--> Delta"]


def test_scaffold_goes_for_spaces(spark):
    text = "[Compacted History - 2 msgs] Next Action: go. Topics: stay"
    assert spark.createDataFrame([(text,)], "t string").select(tx.without_scaffold(F.col("t"))).first()[0] == "  - 2 msgs]   go. Topics: stay"


def test_only_completed_subagents_leave_memories(spark):
    found = spark.createDataFrame([(s, i, "x" * 300 if i else None) for s in (1, 2) for i in range(8)], "s long, i long, content string")
    out = recall.subagent_memories(found, spark.createDataFrame([(1, "completed"), (2, "swept")], "s long, reason string"), ["s"], [F.asc("i")]).orderBy("rank").collect()
    assert [(r.s, r["rank"], len(r.content)) for r in out] == [(1, 1, 11)] + [(1, k, 211) for k in (2, 3, 4, 5)]
