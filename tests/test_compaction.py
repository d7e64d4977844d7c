"""Compaction to a token target against a plain version, message by message."""

import math
import random
import re

import pytest

from loomspark.functions import text as tx
from loomspark.plans import compaction
from loomspark.plans.compaction import compact_to

WORDS = "alpha bravo config delta error foxtrot gateway hotel review kilo".split()


@pytest.fixture(scope="module")
def cases(spark):
    rnd = random.Random(5)
    rows = []
    for s, n in enumerate((0, 3, 25, 40, 45, 200)):
        for i in range(n):
            t = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 12)))
            if i % 9 == 0:
                t += ". We decided to use `cache` for this. "
            if i % 7 == 3:
                t = ""
            rows.append((s, i, rnd.choice(("user", "assistant")), t, False))
    rows += [(5, -1, "user", "[Compacted History - 4 msgs] earlier", False), (5, -2, "system", "handoff", True), (9, 0, "system", "alone", True)]
    df = spark.createDataFrame(rows, "session_id long, idx long, role string, content string, derived boolean")
    priced = {(r[0], r[1]): r[2] for r in df.select("session_id", "idx", tx.heuristic_tokens(df.content)).collect()}
    return df, rows, priced


def plain(rows, priced, window, strategy, scores):
    """{session: (reason or None, places kept)}"""
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == s and not r[4] and not r[3].startswith("[Compacted History"))
        cost = [priced[r[0], r[1]] for r in own]
        target = math.floor(window * 0.75)
        if not own:
            out[s] = ("no messages to compact", None)
            continue
        if sum(cost) <= target:
            out[s] = (f"already under target ({sum(cost)} <= {target})", None)
            continue
        if strategy == "recent":
            acc, start = 0, len(own)
            for i in reversed(range(len(own))):
                acc += cost[i]
                if acc > target:
                    start = min(len(own), max(20, i + 1))
                    break
            kept = set(range(start, len(own)))
        else:
            kept = set(range(max(0, len(own) - 20), len(own)))
            left = target - sum(cost[i] for i in kept)
            for i in sorted(range(max(0, len(own) - 20)), key=lambda i: (-scores[s, own[i][1]], i)):
                if cost[i] <= left:
                    kept.add(i)
                    left -= cost[i]
        gone = len(own) - len(kept)
        out[s] = (f"too few messages to remove ({gone})", None) if gone <= 10 else (None, {own[i][1] for i in kept})
    return out


def plain_scores(spark, df, rows):
    from pyspark.sql import functions as F

    base = {(r[0], r[1]): r[2] for r in df.select("session_id", "idx", tx.importance(F.col("content"))).collect()}
    out = {}
    for s in {r[0] for r in rows}:
        own, seen = sorted(r for r in rows if r[0] == s and not r[4] and not r[3].startswith("[Compacted History")), []
        for r in own:
            words = {w for w in r[3].lower().split() if len(w) > 3} if len(r[3]) >= 5 else None
            like = words is not None and any(b and words and len(b & words) / len(b | words) > 0.7 for b in seen[-10:] if b is not None)
            out[s, r[1]] = 0 if words is None else base[s, r[1]] - 20 * like
            seen.append(words)
    return out


@pytest.mark.parametrize(("strategy", "block", "window"), [("recent", 4, 20), ("recent", 4, 300), ("recent", 1024, 900), ("semantic", 1024, 20), ("semantic", 1024, 300), ("semantic", 1024, 900)])
def test_same_as_plain(spark, cases, monkeypatch, strategy, block, window):
    monkeypatch.setattr(compaction, "BLOCK", block)
    df, rows, priced = cases
    want = plain(rows, priced, window, strategy, plain_scores(spark, df, rows))
    got = compact_to(df, window, strategy)
    verdicts = {r["session_id"]: r for r in got.sessions.collect()}
    after = got.messages.collect()
    assert set(verdicts) == set(want)
    for s, (reason, kept) in want.items():
        v, mine = verdicts[s], [r for r in after if r["session_id"] == s]
        assert v["reason"] == reason and v["compacted"] == (reason is None)
        derived = [r for r in mine if r["part"] == 0]
        assert len(derived) == v["n_derived"] == (2 if s == 5 else 1 if s == 9 else 0)
        own = {r["idx"] for r in mine if r["part"] == 2}
        if reason:
            assert own == {r[1] for r in rows if r[0] == s and not r[4] and not r[3].startswith("[Compacted")} and not v["summary"]
            assert v["tokens_after"] == v["tokens_before"]
        else:
            assert own == kept and v["removed"] == v["n"] - len(kept)
            assert [r["content"] for r in mine if r["part"] == 1] == [v["summary"]]
    if window in (20, 300):
        assert any(r is None for r, _ in want.values())


def test_summaries(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"request {i} about the error in config. " + ("We decided to keep src/app.ts for now. " if i < 3 else ""), False) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id long, idx long, role string, content string, derived boolean")
    recent = compact_to(df, 200).sessions.first()
    lines = recent["summary"].split("\n")
    assert lines[0] == f"[Compacted History — {recent['removed']} earlier messages summarized]"
    assert lines[1].startswith("Topics: config, error") and lines[2].startswith('Key requests: "request 1 about') and lines[2].count('"; "') == 4
    assert lines[-1] == "Continue with the current task using the remaining recent context below."
    own = compact_to(df, 500, "semantic").sessions.first()["summary"]
    assert re.match(r"\[Compacted History - \d+ msgs\] \| Topics: config,error", own)
    assert own.count("We decided to keep src/app") == 3 and " | entities: " in own
    assert not compact_to(df, 200).sessions.filter("tokens_after >= tokens_before").count()


def test_edges(spark):
    schema = "session_id long, idx long, role string, content string"
    empty = compact_to(spark.createDataFrame([], schema), 100)
    assert empty.sessions.count() == empty.messages.count() == 0
    rows = [(None, i // 2, None, None if i % 5 == 0 else "word " * 20) for i in range(60)] + [(2, i, "user", "same text " * 9) for i in (1, 1, 1)]
    df = spark.createDataFrame(rows, schema)
    windows = spark.createDataFrame([(None, 300), (None, 200)], "session_id long, window int")
    for strategy in ("recent", "semantic"):
        got = compact_to(df.selectExpr("*", "1 AS tokens", "2 AS target", "'x' AS _place"), windows, strategy)
        v = {r["session_id"]: r for r in got.sessions.collect()}
        assert v[None]["compacted"] and v[None]["target"] == 225 and v[2]["reason"] == "no context window"
        assert got.messages.filter("session_id is null and part = 2").count() == 60 - v[None]["removed"]
        assert got.messages.filter("session_id = 2").count() == 3
    with pytest.raises(ValueError):
        compact_to(df, 100, "other")
