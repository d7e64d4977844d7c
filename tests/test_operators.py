"""Small cases of single operators, by hand."""

import json

from pyspark.sql import functions as F

from loomspark.functions import budget as bg
from loomspark.functions import text as tx
from loomspark.operators import digest, drift, gate, graph, ledger, quality, resume, select
from loomspark.plans import assemble
from loomspark.sources import files
from loomspark.streaming import sessions


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_tokens(spark):
    for text, n in (("", 0), ("a", 1), ("x" * 40, 11), ("中文", 4)):
        assert one(spark, tx.heuristic_tokens(F.lit(text))) == n


def test_word_boundaries_are_ascii(spark):
    assert one(spark, tx.any_of(F.lit("我们decided用"), tx.DECISION))
    assert not one(spark, tx.any_of(F.lit("undecidedly"), (r"(?i)\bdecided\b",)))


def test_structured_kinds(spark):
    for text, kind in (("", None), ("[1,2]", "json"), ("{bad", None), ("a,b\n1,2", "csv"), ("|a|b|\n|--|--|", "table"), ("DELETE from x", "sql-result")):
        assert one(spark, tx.structured_kind(F.lit(text))) == kind


def test_adaptive_threshold(spark):
    assert one(spark, gate.adaptive_threshold(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0.5
    assert one(spark, gate.adaptive_threshold(F.lit(0.2), F.lit(0.1))) == 0.42


def test_static_split(spark):
    r = one(spark, bg.static_split(F.lit(8000)))
    assert tuple(r) == (4800, 800, 800, 1600)
    assert sum(one(spark, bg.static_split(F.lit(100000)))) == 100000


def test_prefix_is_a_prefix_and_fill_is_within_budget(spark):
    df = spark.createDataFrame([("s", i, float(-i % 5), 10 + 7 * i % 13) for i in range(30)], "g string, i long, s double, t long")
    got = [r["i"] for r in select.budget_prefix(df, ["g"], "s", "t", "i", F.lit(100)).collect()]
    order = sorted(range(30), key=lambda i: (-(-i % 5), i))
    assert sorted(got) == sorted(order[: len(got)])
    rows = select.greedy_fill(df, ["g"], "i", "s", "t", 150, min_keep=2).collect()
    assert len(rows) == 30 and {28, 29} <= {r["i"] for r in rows if r["kept"]}
    assert sum(r["t"] for r in rows if r["kept"]) <= 150


def test_cooldown(spark):
    df = spark.createDataFrame([("s", t) for t in (0, 10, 300_000, 300_001, 900_000)], "s string, at long")
    assert ledger.cooldown(df, ["s"], "at", F.lit(True), cap=2).first()["accepted"] == [0, 300_000]


def test_as_of(spark):
    l = spark.createDataFrame([("k", 5), ("k", 1), ("j", 9)], "k string, at long")
    r = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("j", 10, "c")], "k string, at long, v string")
    assert {(x["k"], x["at"]): x["last_v"] for x in ledger.as_of(l, r, "k", "at", ["v"]).collect()} == {("k", 5): "b", ("k", 1): None, ("j", 9): None}


def test_drift_alert_needs_a_run(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate((0.9, 0.9, 0.1, 0.7, 0.7, 0.8, 0.9, 0.9, 0.9))], "session_id string, turn int, score double")
    assert [r["turn"] for r in drift.alerts(df).orderBy("turn").collect()] == [5, 8]


def test_greedy_distinct(spark):
    got = one(spark, resume.greedy_distinct(F.array(*map(F.lit, ("deploy the gateway now", "Deploy the gateway, now!", "other thing entirely")))))
    assert got == ["deploy the gateway now", "other thing entirely"]


def test_open_items(spark):
    got = one(spark, resume.open_items(F.array(F.lit("src/app.ts"), F.lit("a")), F.array(F.lit("app.ts"), F.lit("b/a"))))
    assert got == ["src/app.ts", "b/a"]


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("s", "Alpha", 0.5), ("s", "beta", 0.5), ("s", "gone", 0.1)], "g string, content string, score double")
    b = spark.createDataFrame([("s", "alpha ", 0.5), ("s", "beta", 0.9), ("s", "new", 0.1)], "g string, content string, score double")
    assert {r["key"]: r["change"] for r in graph.snapshot_diff(a, b, ["g"]).collect()} == {"alpha": "unchanged", "beta": "modified", "gone": "deleted", "new": "added"}


def test_dependency_chain(spark):
    e = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("t", "a", "z")], "session_id string, a string, b string")
    start = spark.createDataFrame([("s", "a")], "session_id string, entity string")
    assert {(r["entity"], r["depth"]) for r in graph.dependency_chain(e, start).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_claims_are_parts_of_their_messages_and_digests_parse_back(spark):
    m = spark.createDataFrame([("s", 0, "We decided to use Kafka because it scales. Fine."), ("s", 1, "`parse` throws an error here")], "session_id string, idx int, content string")
    s = digest.sentences(m)
    found = digest.claims(s, ["session_id"], ["idx"]).drop("content")
    assert digest.valid_claims(found, m, ["session_id", "idx"]).count() == 2
    facts = digest.confirmed(s).select("session_id", F.lit("confirmed").alias("kind"), F.col("idx").alias("seq"), F.col("sentence").alias("text"), "confidence")
    back = digest.parse(digest.serialize(facts, ["session_id"]), ["session_id"]).collect()
    assert [(r["kind"], r["text"], r["confidence"]) for r in back] == [("confirmed", "We decided to use Kafka because it scales.", 0.95)]
    r = digest.rejected(digest.sentences(spark.createDataFrame([("s", 0, "We rejected the cache because it leaks.")], "session_id string, idx int, content string"))).first()
    assert (r["approach"], r["reason"]) == ("We rejected the cache", "it leaks.")


def test_quality_and_refine(spark):
    q = one(spark, quality.overall(F.lit("Maybe this failed. TODO")))
    assert q["completeness"] == 0.8 and not one(spark, quality.overall(F.lit("  ")))["passed"]
    assert spark.createDataFrame([("I think it works. It works. it works.",)], "t string").select(quality.refine(F.col("t"))).first()[0] == "it works."


def test_compaction_keeps_and_summarizes_all(spark):
    m = spark.createDataFrame([("s", i, f"We decided to do thing {i} now. Use Json.read") for i in range(9)], "session_id string, idx int, content string")
    kept, summary = assemble.compact(m, keep=4)
    assert kept.count() == 4 and summary.first()["removed"] == 5
    assert summary.first()["summary"].startswith('[Compacted History - 5 msgs] | Topics: general discussion | decisions: "We decided to do thing 0 now";')


def test_transcript_round_trip(spark, tmp_path):
    lines = ['{"type":"session","id":"1"}', "", '{"type":"message","message":{"role":"user","content":"hi"}}', "{oops", '{"x":1}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    x = files.read_transcript(spark, str(tmp_path / "t.jsonl"))
    assert sorted(r["type"] for r in x.collect()) == ["message", "session", "unknown", "unparseable"]
    files.write_transcript([x.filter("is_header").select(F.lit(0).alias("seq"), "raw"), x.filter("type = 'message'").select(F.lit(1).alias("seq"), "raw")], str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == [lines[0], lines[2]]


def test_ledgers_count_bad_lines(spark, tmp_path):
    good = {"at": 1, "sessionId": "s", "triggerReason": "auto", "inputTokens": 5, "outputTokens": 2, "cachedTokenShare": 0.5, "strategyVersion": "v"}
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps(good), json.dumps(good | {"cachedTokenShare": 2}), "{bad"]))
    assert files.read_costs(spark, str(tmp_path / "c.jsonl")).agg(F.count_if(~F.col("valid"))).first()[0] == 2


def _stream(spark, tmp_path, df):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def _drain(query_df, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_df.sparkSession.table(name).collect()


def test_streams_equal_batches(spark, tmp_path):
    m = spark.createDataFrame([(s, i, "word " * (5 + i)) for s in (1, 2) for i in range(8)], "session_id long, idx long, content string")
    rows = _drain(sessions.running_state(_stream(spark, tmp_path / "a", m)), "state", "update")
    want = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(tx.heuristic_tokens(F.col("content"))).alias("t")).collect()
    assert {(r["session_id"], r["messages"], r["tokens"]) for r in rows} == {tuple(r) for r in want}
    t = spark.createDataFrame([(1, x) for x in (0, 10, 300_000, 300_001, 900_000)], "session_id long, at long")
    got = _drain(sessions.cooldown_stream(_stream(spark, tmp_path / "b", t), cap=2), "cool", "append")
    assert sorted(r["at"] for r in got) == [0, 300_000]
    kept = _drain(sessions.budget_stream(_stream(spark, tmp_path / "c", m), 40), "fill", "append")
    size = {r["idx"]: -(-len(r["content"]) // 4) for r in m.collect()}
    used = {s: sum(size[r["idx"]] for r in kept if r["session_id"] == s) for s in (1, 2)}
    assert set(used) == {1, 2} and all(0 < u <= 36 for u in used.values())


def test_ingest_and_windows(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, "short"), (1, 1, "long enough to be stored"), (1, 2, "HEARTBEAT " + "x" * 30)], "session_id long, idx long, content string")
    q = sessions.ingest(_stream(spark, tmp_path, m), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["idx"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
    e = spark.sql("select timestamp_ntz'2024-01-01 00:10:00' ts, 'a' event_type, 1.0 value, 1L user_id union all select timestamp_ntz'2024-01-01 00:20:00', 'a', 2.0, 1L")
    assert sessions.windowed_counts(e).first()["total"] == 3 and sessions.session_windows(e).first()["n"] == 2


def test_state_of_a_session(spark):
    from loomspark.operators import state

    m = spark.createDataFrame([("s", 0, "user", "We decided to use docker because it is simple. See src/a.ts"), ("s", 1, "assistant", "Alice tested src/a.ts with Docker"), ("s", 2, "user", "The Ledger Service fixed #12")], "session_id string, idx int, role string, content string")
    got = {r["key"]: (r["type"], r["mentions"]) for r in state.typed_entities(m, ["session_id"]).collect()}
    assert got == {"src/a.ts": ("file", 2), "docker": ("tool", 2), "alice": ("person", 1), "the ledger service": ("concept", 1)}
    d = state.decisions(m, ["session_id"]).first()
    assert (d["actor"], d["confidence"]) == ("unknown", 0.9) and d["description"].startswith("decided to use docker")
    assert {(r["type"], r["description"]) for r in state.actions(m, ["session_id"]).collect()} == {("test", "tested"), ("code", "fixed")}
    s = state.summaries(m, ["session_id"]).first()
    assert s["n_messages"] == 3 and s["entities"][0] == "Docker" or s["entities"][0] == "docker"
    ids = {(r["kind"], r["value"]): r["rank"] for r in state.handoff(m, ["session_id"]).collect()}
    assert ids == {("file", "src/a.ts"): 1}
    assert json.loads(state.handoff_record(m, ["session_id"]).first()["record"])["recent_user_messages"][1].endswith("#12")


def test_search_prefers_rare_shared_terms(spark):
    from loomspark.operators import recall

    items = spark.createDataFrame([(1, "the cat sat"), (2, "the dog sat down"), (3, "zebra"), (4, "")], "id long, content string")
    q = spark.createDataFrame([(9, "the zebra"), (8, "nothing shared")], "query_id long, query string")
    assert [(r["query_id"], r["id"], r["rank"]) for r in recall.search(items, q, k=1).collect()] == [(9, 3, 1)]


def test_bpe_counts_round_trip_texts(spark):
    import os

    import pytest

    from loomspark.functions import bpe

    if not os.path.exists(bpe.RANKS):
        pytest.skip("no vocabulary file")
    df = spark.createDataFrame([("hello world",), ("hello world",), (None,), ("",)], "content string")
    got = bpe.count_distinct_texts(df).collect()
    assert sorted(r["tokens"] for r in got) == [0, 0, 2, 2]


def test_message_parts(spark):
    assert one(spark, tx.legacy_theme(F.lit("Working on: the plan. more"))) == "the plan"
    assert one(spark, tx.legacy_theme(F.lit('{"theme":"x"}'))) == "x" and one(spark, tx.legacy_theme(F.lit("?"))) == "General discussion"
    assert one(spark, tx.status_key(F.lit(""), F.lit("build"), F.array(*[F.lit(f"e{i}") for i in range(7)]), F.lit("fb"))) == "fb build e0 e1 e2 e3 e4"
    assert one(spark, tx.json_summary(F.lit("[]"))) == "Empty array" and one(spark, tx.json_summary(F.lit("x"))) == "x"
    assert one(spark, tx.lineage_ids(F.array(F.lit(" a"), F.lit("a"), F.lit(""), F.lit("b")))) == ["a", "b"]
    assert one(spark, tx.styled(F.array(F.lit("x")), "explanatory")) == "[Context] Selected because: general relevance\n\nRelevant items:\n- x"


def test_engine(spark):
    from loomspark.api import ContextEngine

    m = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"we fix the bug number {i} in the code") for i in range(6)], "session_id long, idx long, role string, content string")
    mem = spark.createDataFrame([(i, 1, f"memory {i}", (i + 5) / 10) for i in range(5)], "id long, session_id long, content string, score double")
    e = ContextEngine(spark, m, mem)
    assert e.build(50).first()["block"].startswith("[Memory 10000000]\n- memory 4")
    kept, gone = e.compact(keep=2)
    assert kept.count() == 2 and gone.first()["removed"] == 4
    assert e.inject(50).filter("role = 'system'").count() == 1 and e.close(1).messages.count() == 0
    assert e.budget(1000).first()["task"] == "coding" and e.signals() is None and e.drift().count() >= 1
    e.providers.register("ci", lambda s: s.range(2))
    assert e.signals().filter("provider = 'ci'").count() == 2


def test_caches(spark, tmp_path):
    from loomspark.operators import caches

    puts = spark.createDataFrame([("c", "a", 10), ("c", "a", 50), ("c", "b", 60), ("c", "old", 1), ("c", "late", 99)], "c string, key string, at long")
    assert [r["key"] for r in caches.alive(puts, ["c"], 70, 40, 1).collect()] == ["b"]
    p = spark.createDataFrame([("x", 50), ("y", 55)], "task string, at long")
    inv = spark.createDataFrame([("x", 52)], "task string, at long")
    assert [r["task"] for r in caches.preloaded(p, inv, "task", 60, 100).collect()] == ["y"]
    assert caches.preloaded(p, spark.createDataFrame([(None, 56)], "task string, at long"), "task", 60, 100).count() == 0
    caches.emit(p, "preloaded", str(tmp_path / "e"))
    assert {json.loads(r["payload"])["task"] for r in spark.read.parquet(str(tmp_path / "e")).collect()} == {"x", "y"}


def test_unseen_rows_of_a_stream(spark, tmp_path):
    from loomspark.operators import caches

    e = spark.sql("select timestamp'2024-01-01 00:00:01' ts, 'a' k union all select timestamp'2024-01-01 00:00:02', 'a' union all select timestamp'2024-01-01 00:00:03', 'b'")
    assert sorted(r["k"] for r in _drain(caches.unseen(_stream(spark, tmp_path, e), ["k"]), "unseen", "append")) == ["a", "b"]
