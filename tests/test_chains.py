"""Dependency chains against a plain walk: any depth, entities outside the walk, strength."""

import os
import random
from collections import deque

import pytest

from loomspark.operators import graph, lineage


def plain(rows):
    out = []
    for s in {r[0] for r in rows}:
        first, pairs, near = {}, set(), {}
        by = {}
        for _, i, e in (r for r in rows if r[0] == s):
            first[e] = min(first.get(e, i), i)
            by.setdefault(i, set()).add(e)
        for names in by.values():
            for a in names:
                for b in names:
                    if a < b:
                        pairs.add((a, b))
                        near.setdefault(a, set()).add(b)
                        near.setdefault(b, set()).add(a)
        start = min(first, key=lambda e: (first[e], e))
        depth, queue, hits, done = {start: 0}, deque([start]), 0, set()
        while queue:
            now = queue.popleft()
            done.add(now)
            hits += sum(o not in done for o in near.get(now, ()))
            for o in near.get(now, ()):
                if o not in depth:
                    depth[o] = depth[now] + 1
                    queue.append(o)
        order = sorted(first, key=lambda e: (depth.get(e, 10**9), first[e], e))
        strength = 0.0 if len(first) < 2 else min(1.0, hits / len(first))
        out += [(s, k + 1, e, depth.get(e), round(strength, 6)) for k, e in enumerate(order)]
    return sorted(out, key=str)


def test_chains_match_a_plain_walk(spark):
    rng = random.Random(4)
    rows = [(s, i, f"e{rng.randint(0, 30)}") for s in range(12) for i in range(rng.choice([1, 5, 25])) for _ in range(rng.randint(1, 2))]
    df = spark.createDataFrame(rows, "session_id long, idx long, entity string")
    assert sorted((tuple(r) for r in graph.dependency_chains(df, ["session_id", "idx"]).collect()), key=str) == plain(rows)


def test_a_chain_deeper_than_ten_is_whole(spark):
    rows = [(1, i, f"n{i + d:03}") for i in range(25) for d in (0, 1)]
    out = graph.dependency_chains(spark.createDataFrame(rows, "session_id long, idx long, entity string"), ["session_id", "idx"]).orderBy("place").collect()
    assert [r.depth for r in out] == list(range(26)) and {r.strength for r in out} == {round(25 / 26, 6)}


def test_no_mentions(spark):
    assert graph.dependency_chains(spark.createDataFrame([], "session_id long, idx long, entity string"), ["session_id", "idx"]).collect() == []


def _crossed(rng, s):
    """A session whose messages name the same few entities again and again, beside many that stand alone."""
    few, rows = [f"f{k}" for k in range(7)], [(s, 0, "f0"), (s, 0, "f1")]
    for i in range(1, rng.randint(2, 12)):
        rows += [(s, i, e) for e in rng.sample(few, rng.randint(2, 4))]
    return rows + [(s, 100 + k, f"alone{k:02}") for k in range(rng.choice([0, 20, 60]))]


@pytest.mark.parametrize(("wide", "sent", "share"), [(500_000, 200_000, 1_000_000), (25, 0, 100), (0, 200_000, 1_000_000)])
def test_pairs_met_again_count_once_however_sessions_are_dealt_out(spark, monkeypatch, wide, sent, share):
    for name, value in (("WIDE", wide), ("SENT", sent), ("SHARE", share)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(9)
    rows = [r for s in range(14) for r in _crossed(rng, s)] + [(50, i, f"n{i + d}") for i in range(4) for d in (0, 1)]
    want = plain(rows)
    assert len({r[4] for r in want}) > 4  # strengths below 1 too
    df = spark.createDataFrame(rows, "session_id long, idx long, entity string")
    assert sorted((tuple(r) for r in graph.dependency_chains(df, ["session_id", "idx"]).collect()), key=str) == want


def test_missing_keys_join_nothing(spark):
    rows = [(1, None, "a"), (1, None, "b"), (1, 3, "c"), (1, 3, "d"), (None, 1, "x"), (None, 1, "y")]
    df = spark.createDataFrame(rows, "session_id long, idx long, entity string")
    got = {(r.session_id, r.entity): (r.place, r.depth, r.strength) for r in graph.dependency_chains(df, ["session_id", "idx"]).collect()}
    assert got == {(1, "c"): (1, 0, 0.25), (1, "d"): (2, 1, 0.25), (1, "a"): (3, None, 0.25), (1, "b"): (4, None, 0.25), (None, "x"): (1, None, 0.0), (None, "y"): (2, None, 0.0)}


def test_what_is_written_grows_with_the_mentions_not_with_their_pairs(spark):
    """20 sessions of a message with 300 entities have 6,000 mentions and 897,000 pairs."""
    df = spark.range(6_000).selectExpr("id div 300 AS session_id", "0L AS idx", "concat('name', id % 300) AS entity")
    top = lineage.shared_dir(spark).removeprefix("file://")
    written = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(top) for f in files)
    before = written()
    out = graph.dependency_chains(df, ["session_id", "idx"]).collect()
    assert len(out) == 6_000 and {r.strength for r in out} == {1.0} and {r.depth for r in out} == {0, 1}
    assert written() - before < 100 * 6_000
