"""Session state reads every text once, in time that grows with its length."""

import time

from loomspark.operators import state


def test_theme_of_a_long_cjk_text_takes_linear_time(spark):
    rows = [(1, 0, "user", "".join(chr(0x4E00 + i % 1999) for i in range(60_000)))]
    df = spark.createDataFrame(rows, "session_id long, idx long, role string, content string")
    began = time.time()
    got = state.theme_keywords(df, ["session_id"]).collect()
    assert {r["n"] for r in got} == {31} and len(got) == 5
    assert time.time() - began < 20


def test_a_text_of_one_cjk_character_makes_a_cjk_session(spark):
    rows = [(1, 0, "user", "中"), (1, 1, "user", "once upon"), (2, 0, "user", "once upon"), (3, 0, "user", "中中中 the")]
    df = spark.createDataFrame(rows, "session_id long, idx long, role string, content string")
    got = sorted((r["session_id"], r["word"], r["n"]) for r in state.theme_keywords(df, ["session_id"]).collect())
    assert got == [(1, "once", 1), (1, "upon", 1), (3, "中中", 2)]


def test_summaries_and_records_read_the_messages_a_few_times(spark, tmp_path):
    rows = [(s, i, "user", f"We decided to use docker{s} because Alice likes src/a{i}.ts. {c}") for s in range(3) for i, c in enumerate(("", "中文字", "x", " "))][:-1] + [(9, i, "user", " ") for i in range(5)]
    spark.createDataFrame(rows, "session_id long, idx long, role string, content string").write.parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    for f, most in ((state.summaries, 4), (state.handoff_record, 5)):
        plan = f(m, ["session_id"])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= most, plan
    assert sorted(r["session_id"] for r in state.summaries(m, ["session_id"]).collect()) == [0, 1, 2, 9]
    assert sorted(r["session_id"] for r in state.handoff_record(m, ["session_id"]).collect()) == [0, 1, 2]
