"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from loomspark.plans import chain_queries, compaction_queries, context_queries, coverage_queries, more_queries, search_queries, session_queries, stream_queries  # noqa: F401
from loomspark.plans import queries as plans

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_duckdb(spark, duck, tmp_path, name):
    plans.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    out = f"'{tmp_path}/out/*.parquet'"
    cols = sorted(x[0] for x in duck.execute(f"describe select * from {out}").fetchall())
    assert cols == sorted(x[0] for x in duck.execute(f"describe {plans.ORACLE_SQL[name]}").fetchall())
    c = ",".join(f'"{x}"' for x in cols)
    for a, b in ((f"({plans.ORACLE_SQL[name]})", out), (out, f"({plans.ORACLE_SQL[name]})")):
        assert duck.execute(f"select * from (select {c} from {a} except all select {c} from {b}) limit 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_both_classes_occur(spark):
    """Keyword queries say something about the derived texts."""
    rows = plans.j24_screening(spark, SF).collect()
    assert {r["state"] for r in rows} == {r["action"] for r in rows} == {True, False}
    assert len({r["task"] for r in plans.j1_task_type(spark, SF).collect()}) >= 3
