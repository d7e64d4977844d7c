"""The full context of a turn: order of blocks, cold turns, sticky drift alerts, kept prefixes, one warning a session."""

import pytest

from loomspark.functions import text as tx
from loomspark.plans import context
from pyspark.sql import functions as F

HITS = "session_id long, turn long, id long, content string, score double"


@pytest.fixture(scope="module")
def tables(spark):
    turns = spark.createDataFrame([(1, 0, "why does the build fail"), (1, 1, "see https://x.org/a.png and https://x.org/v.mp4?a=1."), (1, 2, "go on"), (2, 0, "hello"), (3, 0, None)], "session_id long, turn long, query string")
    hits = spark.createDataFrame([(1, t, i, c, s) for t in (0, 1, 2) for i, c, s in [(1, "first memory", 0.9), (2, "second memory", 0.8), (3, "weak memory", 0.29)]] + [(1, 2, 4, "a new memory " * 30, 0.5)], HITS)
    history = spark.createDataFrame([(1, "- did things at 2024-01-01T00:00:00Z"), (2, "- older things")], "session_id long, text string")
    cards = spark.createDataFrame([(1, 0, 1, "card one"), (1, 0, 2, "x" * 1100), (2, 0, 1, "card two")], "session_id long, turn long, seq long, card string")
    outside = spark.createDataFrame([(1, 1, "rl", "reward"), (1, 2, "governance", "obey"), (2, 1, "ci", "red")], "session_id long, seq long, source string, block string")
    scores = spark.createDataFrame([(1, 0, 0.1, 0.1, False), (1, 1, 0.8, 0.95, True), (1, 2, 0.75, 0.92, False)], "session_id long, turn long, score double, rolling double, sudden boolean")
    alerts = spark.createDataFrame([(1, 0, 0.6, "medium"), (1, 1, 0.8, "high")], "session_id long, turn long, peak double, level string")
    return turns, hits, history, cards, outside, scores, alerts


def test_blocks_stand_in_order(tables):
    rows = {(r.session_id, r.turn): r for r in context.assemble(context.gather(*tables, budget=60), 60).collect()}
    assert len(rows) == 5
    first = rows[1, 0]
    assert first.prefix == "[Session History — hash:10000000]\n- did things at [timestamp]\n\ncard one\n\n[Context] Relevant information:\n- first memory\n- second memory"
    assert first.sources == "resume,error-card,memory,governance,rl,prompt-strategy"
    assert first.suffix.startswith("obey\n\nreward\n\n[Strategy: ")
    assert first.text == first.prefix + "\n\n" + first.suffix


def test_cold_turns_have_no_prefix(tables):
    rows = {(r.session_id, r.turn): r for r in context.assemble(context.gather(*tables, budget=60), 60).collect()}
    cold = rows[2, 0]
    assert (cold.n_stable, cold.prefix) == (0, "")
    assert cold.suffix == "red\n\ncard two\n\n" + context.HISTORY_INTRO + "- older things" + context.HISTORY_END
    assert (rows[3, 0].text, rows[3, 0].tokens) == ("", 0)


def test_alerts_wait_for_a_jump_and_stay(tables):
    rows = {(r.session_id, r.turn): r for r in context.assemble(context.gather(*tables, budget=60), 60).collect()}
    block = "[Drift Monitor]\n[Drift MEDIUM] Score: 0.60 — Moderate topic drift detected — compact context to refocus; Summarize key points before continuing\n[Drift HIGH] Score: 0.80"
    assert "[Drift" not in rows[1, 0].text
    assert block in rows[1, 1].suffix and block in rows[1, 2].suffix
    assert [rows[1, t].auto_compact for t in range(3)] == [False, True, True]
    assert [rows[1, t].suggestion for t in range(3)] == [None, context.AUTO_SESSION, None]


def test_the_kept_prefix_is_counted_block_by_block(tables):
    rows = {(r.session_id, r.turn): r for r in context.assemble(context.gather(*tables, budget=400), 400).collect()}
    assert [rows[1, t].kept_blocks for t in range(3)] == [0, 1, 1]  # the card goes at turn 1, so the memories stand elsewhere; then they change
    assert rows[1, 1].kept_chars == len("[Session History — hash:10000000]\n- did things at [timestamp]")


def test_one_warning_a_session(tables):
    tokens = {r[0]: r[1] for r in tables[1].filter("turn = 2").select("id", tx.heuristic_tokens(F.col("content"))).collect()}
    budget = tokens[1] + tokens[2] + 1
    rows = [r for r in context.assemble(context.gather(*tables, budget=budget), budget).orderBy("session_id", "turn").collect() if r.session_id == 1]
    used = tokens[1] + tokens[2]
    assert [r.warning for r in rows] == [f"[Token Budget Warning: {used}/{budget} tokens used ({int(used * 100 / budget + 0.5)}%) — consider compaction]", None, None]


def test_media_go_by_kind(tables):
    rows = {(r.session_id, r.turn): r for r in context.assemble(context.gather(*tables, budget=60), 60).collect()}
    assert rows[1, 1].suffix.endswith("[Image URL: a.png]\n\n[Video: v.mp4?a=1]")


def test_lists_share_a_budget(spark):
    x = spark.createDataFrame([(1, n, i, t) for n, i, t in [("a", 1, 5), ("a", 2, 6), ("b", 1, 4), ("b", 2, 4), ("b", 3, 1), ("c", 1, 1)]], "s long, list string, id long, tokens long")
    kept = context.allocate(x, ["s"], "tokens", ["id"], {"b": 8, "a": 20}, 14).collect()
    assert sorted((r.list, r.id) for r in kept) == [("a", 1), ("b", 1), ("b", 2)]


@pytest.mark.parametrize(
    "text, found",
    [
        ("data:image/PNG;base64,xx", [("image", None, "[Image: PNG format, base64 encoded]")]),
        ("look: https://a.b/c/d.JPG?x=1), http://a.b/s.ogg.", [("image", "https://a.b/c/d.JPG?x=1", "[Image URL: d.JPG?x=1]"), ("audio", "http://a.b/s.ogg", "[Audio: s.ogg]")]),
        ("![alt](pics/x.png) ![](p/)", [("image", "pics/x.png", "[Image: x.png]"), ("image", "p/", "[Image: embedded]")]),
        ("https://a.b/page plain", []), ("", []), (None, None),
    ],
)
def test_media_references(spark, text, found):
    got = spark.createDataFrame([(text,)], "t string").select(tx.media_references(F.col("t")).alias("m")).first().m
    assert [tuple(m) for m in got] == (found or [])


def test_empty_tables(spark, tables):
    none = [x.limit(0) for x in tables]
    assert context.assemble(context.gather(*none)).collect() == []
    assert context.assemble(context.gather(tables[0], *none[1:])).count() == 5
