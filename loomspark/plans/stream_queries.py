"""Queries of the after-turn stream: several batches over whole tables, each compared with SQL over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import scratch
from ..sources import tables as t
from ..streaming import after_turn
from .queries import ORACLE_SQL, TOK, query

TRIGGER = after_turn.Trigger(threshold=600, minimum=200, cap=2, wait_ms=120_000)
#: Batches of the stream: the turns of a session come in this many parts.
PARTS = 4


def _turn_stream(spark, d) -> DataFrame:
    """Messages with a time (a minute for each place) and, for every third session, reported usage."""
    m = t.messages(spark, d)
    at = F.timestamp_seconds(1_700_000_000 + F.col("idx") * 60)
    usage = F.when(F.pmod("session_id", F.lit(3)) == 0, F.col("idx") * 150 + 100).cast("long")
    return m.select("session_id", "idx", "role", "content", at.alias("at"), usage.alias("usage"))


def in_parts(df: DataFrame, part, n: int, tag: str) -> DataFrame:
    """A stream of the rows in ``n`` batches, by part (0 to n - 1); each part is one file, so this is for small tables."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    for k in range(n):  # one folder each, so that the files' times are in the parts' order
        df.filter(part == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def arriving(df: DataFrame, part, n: int, tag: str):
    """The rows as a stream, and its parts to come (0 to n - 1): each step of the iterator writes one, in as many tasks as the table has."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    df.limit(0).write.parquet(path)  # the stream's folder must be there

    def arrive():
        for k in range(n):
            df.filter(part == k).write.mode("append").parquet(path)
            yield k

    return spark.readStream.schema(df.schema).parquet(path), arrive()


_GATE = f"CASE WHEN eff < {TRIGGER.minimum} THEN 'low' WHEN eff < {TRIGGER.threshold} THEN '' WHEN f.fired >= {TRIGGER.cap} THEN 'cap' WHEN f.last IS NOT NULL AND x.ms - f.last < {TRIGGER.wait_ms} THEN 'wait' ELSE 'fire' END"


@query(
    f"""WITH RECURSIVE {t.SQL["messages"]},
r AS (SELECT session_id, idx, role, 1700000000000 + idx * 60000 AS ms, row_number() OVER w AS messages, CAST(sum({TOK}) OVER w AS BIGINT) AS tokens, CASE WHEN session_id % 3 = 0 THEN idx * 150 + 100 END AS usage FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
x AS MATERIALIZED (SELECT *, coalesce(usage, tokens) AS eff, CASE WHEN usage IS NULL THEN 'estimated' ELSE 'reported' END AS caliber, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS turn FROM r WHERE role = 'assistant'),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS fired, CAST(NULL AS BIGINT) AS last, '' AS said, CAST(0 AS BIGINT) AS was, CAST(NULL AS BIGINT) AS was_last FROM (SELECT DISTINCT session_id FROM x)
 UNION ALL SELECT x.session_id, x.turn, f.fired + CASE WHEN {_GATE} = 'fire' THEN 1 ELSE 0 END, CASE WHEN {_GATE} = 'fire' THEN x.ms ELSE f.last END, {_GATE}, f.fired, f.last FROM f JOIN x ON x.session_id = f.session_id AND x.turn = f.turn + 1)
SELECT session_id, idx, turn, messages, tokens, eff AS effective, caliber, said = 'fire' AS fire,
 CASE said WHEN 'low' THEN 'Token count below minimum (' || eff || ' < {TRIGGER.minimum})' WHEN 'cap' THEN 'Session compaction limit reached (' || was || '/{TRIGGER.cap})' WHEN 'wait' THEN 'Cooldown active (' || CAST(floor(({TRIGGER.wait_ms} - (ms - was_last)) / 1000.0) AS BIGINT) || 's remaining)' WHEN 'fire' THEN 'Token count ' || eff || ' exceeds threshold {TRIGGER.threshold}' ELSE '' END AS reason
FROM x JOIN f USING (session_id, turn)"""
)
def l7_after_turn_stream(spark, d):
    m = _turn_stream(spark, d)
    parts, arrive = arriving(m, F.least(F.floor(F.col("idx") / 2), F.lit(PARTS - 1)), PARTS, "turns")
    stream, out, state = after_turn.after_turn(parts, TRIGGER), scratch(spark, "after-turn"), scratch(spark, "after-turn-state")
    for _ in arrive:  # what has come is taken as a batch, with the state of those before
        after_turn.start(stream, out, state).awaitTermination()
    return spark.read.parquet(out).filter("kind = 'turn'").drop("kind", "batch_id")


@query(None)
def l2_after_turn_batch(spark, d):
    return after_turn.after_turn_batch(_turn_stream(spark, d), TRIGGER)


#: The same rows, so the same SQL.
ORACLE_SQL["l2_after_turn_batch"] = ORACLE_SQL["l7_after_turn_stream"]
