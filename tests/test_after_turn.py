"""The after-turn stream: batches equal the table's fold, replays change nothing, silent sessions leave; folds are linear."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.operators import fold, ledger, select
from loomspark.plans.stream_queries import in_parts
from loomspark.streaming import after_turn

MESSAGES = "session_id long, idx long, role string, content string, at timestamp, usage long"


def rows(spark, n=12, sessions=5, minutes=1):
    x = spark.range(n * sessions).select((F.col("id") % sessions).alias("session_id"), F.floor(F.col("id") / sessions).alias("idx"))
    role = F.when(F.col("idx") % 2 == 0, "user").otherwise("assistant")
    usage = F.when(F.col("session_id") == 1, F.col("idx") * 40).cast("long")
    return x.select("session_id", "idx", role.alias("role"), F.repeat(F.lit("some words "), (F.col("idx") + 1).cast("int")).alias("content"), F.timestamp_seconds(1_700_000_000 + F.col("idx") * 60 * minutes).alias("at"), usage.alias("usage"))


TRIGGER = after_turn.Trigger(threshold=60, minimum=20, cap=2, wait_ms=150_000)


def run(spark, tmp_path, stream):
    after_turn.start(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_batches_equal_the_fold(spark, tmp_path):
    m = rows(spark)
    got = run(spark, tmp_path, after_turn.after_turn(in_parts(m, F.floor(F.col("idx") / 4), 3, "turns"), TRIGGER))
    assert got.select("batch_id").distinct().count() >= 3
    want = after_turn.after_turn_batch(m, TRIGGER)
    key = lambda df: sorted(map(tuple, df.filter("turn > 0").select(*want.columns).collect()))
    assert key(got.filter("kind = 'turn'")) == key(want)
    reasons = {r.reason.split(" (")[0].rstrip("0123456789 ") for r in want.collect()}
    assert {"Cooldown active", "Session compaction limit reached", "Token count below minimum"} <= reasons


def test_reported_usage_goes_before_the_estimate(spark):
    out = {(r.session_id, r.idx): r for r in after_turn.after_turn_batch(rows(spark), TRIGGER).collect()}
    assert (out[1, 3].caliber, out[1, 3].effective) == ("reported", 120)
    assert out[0, 3].caliber == "estimated" and out[0, 3].effective == out[0, 3].tokens


def test_repeated_rows_change_nothing(spark, tmp_path):
    m = rows(spark)
    twice = m.withColumn("part", F.floor(F.col("idx") / 6)).unionByName(m.filter("idx < 6").withColumn("part", F.lit(1)))
    got = run(spark, tmp_path, after_turn.after_turn(in_parts(twice, F.col("part"), 2, "turns"), TRIGGER)).filter("kind = 'turn'")
    assert got.count() == after_turn.after_turn_batch(m, TRIGGER).count()
    assert got.groupBy("session_id", "turn").count().filter("count > 1").count() == 0


def test_a_repeated_batch_replaces_its_folder(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "sink")
    for number in (0, 1, 1, 1):
        after_turn.store_batch(df, number, path)
    assert spark.read.parquet(path).groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 5), (1, 5)]


def test_silent_sessions_leave(spark, tmp_path):
    """Session 0 is silent from the second batch on; once the watermark is an hour past it, it is closed, and begins anew if it comes back."""
    m = rows(spark, n=12, sessions=2, minutes=60).withColumn("part", F.floor(F.col("idx") / 3)).filter("session_id = 1 or part = 0")
    back = m.filter("session_id = 0 and idx < 2").withColumns({"part": F.lit(4), "at": F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * 20)), "idx": F.col("idx") + 100})
    stream = after_turn.after_turn(in_parts(m.unionByName(back), F.col("part"), 5, "turns"), TRIGGER, idle_ms=3_600_000)
    got = run(spark, tmp_path, stream)
    assert got.filter("kind = 'closed' and session_id = 0").count() >= 1
    again = got.filter("kind = 'turn' and session_id = 0 and idx >= 100").collect()
    assert [(r.turn, r.messages) for r in again] == [(1, 2)]


@pytest.mark.parametrize("text", [None, ""])
def test_odd_rows(spark, text):
    df = spark.createDataFrame([(None, 1, "assistant", text, None, None), (2, 1, None, text, None, None)], MESSAGES)
    assert after_turn.after_turn_batch(df.withColumn("at", F.current_timestamp()), TRIGGER).count() == 1
    assert after_turn.after_turn_batch(df.limit(0), TRIGGER).count() == 0


def test_folds_carry_state_over_batches():
    def batches():
        for k in range(4):
            yield pa.RecordBatch.from_arrays([pa.array([None, 1, 1] if k == 0 else [1, 1, 1 if k < 3 else 2]), pa.array([5, 5, 5])], ["s", "t"])

    out = pa.Table.from_batches(list(fold.fold_batches(batches(), ["s"], ["t"], lambda: fold.ChunkedFill(100, 3, 1.0), [pa.field("chunk", pa.int64()), pa.field("kept", pa.bool_())])))
    assert out.column("chunk").to_pylist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 0]


def test_a_million_rows_of_one_session_are_linear(spark):
    took = []
    for n in (100_000, 1_000_000):
        df = spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("idx"), (F.col("id") % 97).alias("tokens"), (F.col("id") % 1009 / 1009.0).alias("score"))
        t = time.perf_counter()
        assert select.chunked_fill(df, ["s"], "idx", "tokens", 10_000_000).count() == n
        kept = select.greedy_fill(df, ["s"], "idx", "score", "tokens", 1_000_000, 20).filter("kept").agg(F.sum("tokens")).first()[0]
        assert 999_900 <= kept <= 1_000_000
        took.append(time.perf_counter() - t)
    assert took[1] < 25 * took[0] + 5


def test_cooldown_rows_and_arrays_agree(spark):
    df = spark.createDataFrame([(s, t * 100_000) for s in (1, 2) for t in range(40)], "s long, at long")
    one = {r.s: r.accepted for r in ledger.cooldown(df, ["s"], "at", F.lit(True)).collect()}
    two = sorted(tuple(r) for r in ledger.accepted(df, ["s"], "at", F.lit(True)).select("s", "at").collect())
    assert two == sorted((s, a) for s, x in one.items() for a in x) and np.all(np.diff(one[1]) >= 300_000) and len(one[1]) == 5


def test_parts_arrive_as_files_of_many_tasks(spark):
    from loomspark.plans.stream_queries import arriving

    df = spark.range(0, 400, 1, 4).withColumn("part", F.col("id") % 2)
    stream, arrive = arriving(df, F.col("part"), 2, "parts-test")
    seen = []
    for _ in arrive:
        path = stream._jdf.queryExecution().analyzed().toString()
        seen.append(len([f for f in spark.read.schema(df.schema).parquet(_folder(path)).filter("id is not null").select(F.input_file_name()).distinct().collect()]))
    assert seen == [4, 8] and spark.read.parquet(_folder(path)).count() == 400


def _folder(plan: str) -> str:
    import re

    return re.search(r"file:[^\s,\])]*parts-test-[0-9a-f]+", plan).group(0)
