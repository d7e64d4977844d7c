"""The driver's tables as the engine's model: messages, memories, ledgers, signals, summaries.

Each has the same definition as SQL text (``SQL``), for the oracle. The tables
hold invented prose in which no keyword occurs, so ``messages`` appends to each
text one of ``PHRASES``, chosen by its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = (
    "We decided to use Postgres because writes are safe.",
    "src/app.ts fails with null after release 2.4.1",
    "Could you explain why the build is slow?",
    "Next step: deploy the gateway plugin and verify it.",
    "I think maybe this is unclear and possibly wrong.",
    "`parse` throws an error; workaround: use Json.read instead",
    "The api design is critical, we must fix the database schema.",
    "See https://example.com/a.png and [TODO] docker setup",
    "Alice reviewed the code and tested the deploy pipeline.",
    "We rejected the cache approach because it does not work.",
    "thanks, hello there",
    "The Ledger Service requires Token Store and uses the Event Bus.",
    "Let's go with incremental compaction for the session memory.",
    "I chose yarn over npm; updated config.json and README.md",
    "plain words without any marker here",
    "First refactor the module, then write unit tests, finally release.",
    "我们决定使用缓存方案，因为写入更安全。 旧方案行不通，由于太慢",
    "`load` 报错，改用 Json.read 。 可以试试新的接口",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, idx, role, content)."""
    n = len(PHRASES)
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(F.col("conv_id") * 8 + F.col("turn"), F.lit(n)) + 1).cast("int"))
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "role", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), phrase).alias("content"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, session_id, kind, content, score, score_missing, ts_hours); the score is a fixed function of the id, missing for every 11th."""
    d = load(spark, sf_dir, "documents")
    missing = F.pmod("doc_id", F.lit(11)) == 0
    return d.select(F.col("doc_id").alias("id"), F.pmod("doc_id", F.lit(50)).alias("session_id"), F.col("lang").alias("kind"), F.coalesce("text", F.lit("")).alias("content"), F.when(missing, 0.5).otherwise(F.pmod(F.col("doc_id") * 37, F.lit(100)) / 100.0).alias("score"), missing.alias("score_missing"), F.pmod(F.col("doc_id") * 7, F.lit(400)).alias("age_hours"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost ledger (at ms, session_id, trigger, input_tokens, output_tokens, share, version) out of events."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return e.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("at"),
        F.col("user_id").alias("session_id"), F.col("event_type").alias("trigger"), "event_id",
        (cents + 1000).alias("input_tokens"), (F.pmod(cents, F.lit(700)) + 300).alias("output_tokens"),
        F.when(F.pmod(k, F.lit(5)) == 0, None).otherwise(k / 100.0).alias("share"),
        F.concat(F.lit("v"), F.pmod("event_id", F.lit(3)).cast("string")).alias("version"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, session_id, source, content, conf, at) out of events."""
    e = load(spark, sf_dir, "events")
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.pmod("event_id", F.lit(len(SOURCES))) + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), source.alias("source"), F.concat_ws(" ", F.col("event_type"), F.lit("on"), source).alias("content"), (F.pmod(F.col("event_id") * 13, F.lit(100)) / 100.0).alias("conf"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("at"))


SOURCES = ("memory_store", "governance", "ci_pipeline", "cross_domain", "session", "weather", "policy", "deploy")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session summaries (session_id, ts ms, theme, key_points, tasks, entities, n_messages), several for a session."""
    e = load(spark, sf_dir, "events")
    x = F.col("event_id")
    pick = lambda words, by: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(by, F.lit(len(words))) + 1).cast("int"))
    points = F.array(F.concat(F.lit("point about "), pick(TOPICS, x)), F.concat(F.lit("note on "), pick(TOPICS, x * 3)))
    return e.select(
        F.col("user_id").alias("session_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts"),
        F.concat(pick(TOPICS, x), F.lit(" "), pick(TOPICS, x * 7)).alias("theme"), points.alias("key_points"),
        F.array(F.concat(F.lit("task "), F.pmod(x, F.lit(9)).cast("string"))).alias("tasks"),
        F.array(pick(ENTITIES, x), pick(ENTITIES, x * 5)).alias("entities"), (F.pmod(x, F.lit(20)) + 3).alias("n_messages"),
    )


TOPICS = ("deploy gateway", "memory budget", "token count", "review plugin", "database schema", "release notes", "drift alerts")
ENTITIES = ("docker", "git", "src/app.ts", "Alice", "vitest", "kubernetes")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _pick(words, by: str) -> str:
    return f"list_extract({_list(words)}, CAST((({by}) % {len(words)}) + 1 AS INTEGER))"


_AT = "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"

#: Common table expressions of the same definitions, for DuckDB.
SQL = {
    "messages": f"messages AS (SELECT conv_id AS session_id, turn AS idx, role, coalesce(text, '') || ' ' || {_pick(PHRASES, 'conv_id * 8 + turn')} AS content FROM conversations)",
    "memories": "memories AS (SELECT doc_id AS id, doc_id % 50 AS session_id, lang AS kind, coalesce(text, '') AS content, CASE WHEN doc_id % 11 = 0 THEN 0.5::DOUBLE ELSE (doc_id * 37 % 100) / 100.0::DOUBLE END AS score, doc_id % 11 = 0 AS score_missing, doc_id * 7 % 400 AS age_hours FROM documents)",
    "ledger": f"""ledger AS (SELECT {_AT} AS "at", user_id AS session_id, event_type AS trigger, event_id,
        CAST(floor(value * 100 + 0.5) AS BIGINT) + 1000 AS input_tokens, CAST(floor(value * 100 + 0.5) AS BIGINT) % 700 + 300 AS output_tokens,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0::DOUBLE END AS share,
        'v' || CAST(event_id % 3 AS VARCHAR) AS version FROM events)""",
    "signals": f"signals AS (SELECT event_id AS id, user_id AS session_id, {_pick(SOURCES, 'event_id')} AS source, event_type || ' on ' || {_pick(SOURCES, 'event_id')} AS content, (event_id * 13 % 100) / 100.0::DOUBLE AS conf, {_AT} AS \"at\" FROM events)",
    "summaries": f"""summaries AS (SELECT user_id AS session_id, event_id, {_AT} AS ts, {_pick(TOPICS, 'event_id')} || ' ' || {_pick(TOPICS, 'event_id * 7')} AS theme,
        ['point about ' || {_pick(TOPICS, 'event_id')}, 'note on ' || {_pick(TOPICS, 'event_id * 3')}] AS key_points, ['task ' || CAST(event_id % 9 AS VARCHAR)] AS tasks,
        [{_pick(ENTITIES, 'event_id')}, {_pick(ENTITIES, 'event_id * 5')}] AS entities, event_id % 20 + 3 AS n_messages FROM events)""",
}


def with_tables(body: str, *names: str) -> str:
    """SQL with the definitions of the named tables before it."""
    return "WITH " + ", ".join(SQL[n] for n in names) + (", " if body.lstrip().startswith("~") else " ") + body.lstrip().removeprefix("~")
