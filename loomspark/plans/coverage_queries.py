"""Queries of the operators that no other query runs alone: file ledgers, small expressions, folds and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import budget as bg
from ..functions import bpe
from ..functions import text as tx
from ..operators import caches, digest, drift, gate, models, recall, reports, resume, select, signals
from ..operators.lineage import scratch
from ..sources import files
from ..sources import tables as t
from ..streaming import sessions
from .queries import _THRESH, ORACLE_SQL, TOK, _any, query

#: Lists of values that inputs take in turn.
TASKS = ("coding", "reasoning", "writing", "conversation", "unknown")


def _pick(words, by):
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(by, F.lit(len(words))) + 1).cast("int"))


def _lines(spark: SparkSession, df: DataFrame, tag: str) -> str:
    """The path of a new folder with the rows (value) as lines."""
    path = scratch(spark, tag)
    df.select("value").write.text(path)
    return path


def _drained(spark: SparkSession, df: DataFrame, tag: str, stream, mode: str = "append") -> DataFrame:
    """What a stream over the rows of a table gives until they are used up."""
    source, out = scratch(spark, tag), scratch(spark, tag)
    df.write.parquet(source)
    x = stream(spark.readStream.schema(df.schema).parquet(source))
    store = lambda batch, _: batch.write.mode("append").parquet(out)
    x.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", scratch(spark, tag)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(x.schema).parquet(out)


# --- A: files -------------------------------------------------------------------------------------


def _transcript(spark, d):
    m = t.messages(spark, d)
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.concat_ws("-", "session_id", "idx").alias("id"), F.col("session_id").cast("string").alias("sessionId"), F.struct("role", "content").alias("message")))
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.col("session_id").cast("string").alias("sessionId")))
    s = m.select("session_id").distinct()
    broken = s.select(F.concat(F.lit('{"type": "message", "id": '), F.col("session_id").cast("string"), F.lit(", ")).alias("value"))
    return files.read_transcript(spark, _lines(spark, m.select(line.alias("value")).union(s.select(head)).union(broken), "transcript"))


@query("SELECT 'message' AS type, false AS is_header, count(*) AS n FROM conversations UNION ALL SELECT 'session', true, count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'unparseable', false, count(DISTINCT conv_id) FROM conversations")
def a1_transcript_scan(spark, d):
    return _transcript(spark, d).groupBy("type", "is_header").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(session_id AS VARCHAR) AS \"sessionId\", count_if(role = 'assistant') AS answers, count(*) AS messages, CAST(1 AS BIGINT) AS headers, CAST(sum(length(content)) AS BIGINT) AS chars FROM messages GROUP BY 1", "messages")
def a2_header_split(spark, d):
    x = _transcript(spark, d).filter("type <> 'unparseable'")
    m = ~F.col("is_header")
    return x.groupBy("sessionId").agg(F.count_if(F.col("message.role") == "assistant").alias("answers"), F.count_if(m).alias("messages"), F.count_if("is_header").alias("headers"), F.sum(F.char_length("message.content")).alias("chars"))


@query("SELECT 'H' || CAST(session_id AS VARCHAR) AS raw FROM messages GROUP BY 1 UNION ALL SELECT CAST(session_id AS VARCHAR) || ':' || CAST(idx AS VARCHAR) || ':' || role FROM messages", "messages")
def a3_transcript_rewrite(spark, d):
    m = t.messages(spark, d)
    head = m.select("session_id").distinct().select(F.col("session_id").alias("seq"), F.concat(F.lit("H"), F.col("session_id").cast("string")).alias("raw"))
    kept = m.select((F.col("session_id") * 1000 + F.col("idx")).alias("seq"), F.concat_ws(":", "session_id", "idx", "role").alias("raw"))
    path = scratch(spark, "rewrite")
    files.write_transcript([kept], path)
    files.write_transcript([head, kept], path)  # takes the place of the first
    return spark.read.text(path).select(F.col("value").alias("raw"))


@query("SELECT CAST(session_id AS VARCHAR) AS \"sessionId\", count(*) AS usages, CAST(sum(input_tokens) AS BIGINT) AS input, count_if(share IS NOT NULL) AS evaluations FROM ledger GROUP BY 1", "ledger")
def a6_usage_ledger(spark, d):
    x = t.ledger(spark, d)
    sid = F.col("session_id").cast("string").alias("sessionId")
    usage = x.select(F.to_json(F.struct(F.lit("usage").alias("kind"), sid, F.create_map(F.lit("input"), F.col("input_tokens").cast("double")).alias("record"))).alias("value"))
    judged = x.filter("share is not null").select(F.to_json(F.struct(F.lit("evaluation").alias("kind"), sid, F.create_map(F.lit("share"), F.col("share").cast("string")).alias("evaluation"))).alias("value"))
    path = _lines(spark, usage, "usage")
    judged.write.mode("append").text(path)
    x.limit(5).select(F.lit('{"kind": "usage", ').alias("value")).write.mode("append").text(path)  # malformed
    got = files.read_usage(spark, path)
    return got.groupBy("sessionId").agg(F.count_if(F.col("kind") == "usage").alias("usages"), F.sum(F.element_at("record", "input")).cast("long").alias("input"), F.count_if(F.col("kind") == "evaluation").alias("evaluations"))


def _costs(spark, d):
    tokens = F.when(F.col("event_id") % 10 == 0, -1).otherwise(F.col("input_tokens"))
    return t.ledger(spark, d).select("at", F.col("session_id").cast("string").alias("sessionId"), F.col("trigger").alias("triggerReason"), tokens.cast("long").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"), F.col("share").alias("cachedTokenShare"), F.col("version").alias("strategyVersion"))


@query("SELECT trigger AS \"triggerReason\", event_id % 10 <> 0 AS valid, count(*) AS n, CAST(sum(output_tokens) AS BIGINT) AS output FROM ledger GROUP BY 1, 2", "ledger")
def a7_cost_read(spark, d):
    path = scratch(spark, "costs")
    files.append_costs(_costs(spark, d), path)
    return files.read_costs(spark, path).groupBy("triggerReason", "valid").agg(F.count(F.lit(1)).alias("n"), F.sum("outputTokens").alias("output"))


@query("SELECT CAST(session_id AS VARCHAR) AS \"sessionId\", 2 * count(*) AS n, CAST(2 * sum(output_tokens) AS BIGINT) AS output FROM ledger GROUP BY 1", "ledger")
def a8_cost_append(spark, d):
    path = scratch(spark, "costs")
    for _ in range(2):
        files.append_costs(_costs(spark, d), path)
    return files.read_costs(spark, path).groupBy("sessionId").agg(F.count(F.lit(1)).alias("n"), F.sum("outputTokens").alias("output"))


def _records(spark, d):
    m = t.messages(spark, d)
    return m.select(F.when(F.col("idx") == 0, "other").otherwise("cq").alias("k"), F.col("idx").cast("long").alias("at"), F.col("session_id").cast("string").alias("sessionId"), F.lit("auto").alias("triggerReason"), F.col("content").alias("summaryText"), (F.col("idx") * 3).cast("long").alias("removedCount"), _pick(reports.OUTCOMES, F.col("session_id") + F.col("idx")).alias("consistency"))


@query("SELECT CAST(session_id AS VARCHAR) AS \"sessionId\", idx > 0 AS valid, count(*) AS n, CAST(sum(idx * 3) AS BIGINT) AS removed, CAST(sum(length(content)) AS BIGINT) AS chars FROM messages GROUP BY 1, 2", "messages")
def a9_quality_replay(spark, d):
    path = scratch(spark, "quality")
    files.write_quality(_records(spark, d), path)
    return files.read_quality(spark, path).groupBy("sessionId", "valid").agg(F.count(F.lit(1)).alias("n"), F.sum("removedCount").alias("removed"), F.sum(F.char_length("summaryText")).alias("chars"))


@query("SELECT list_extract(['pass', 'rejected', 'degraded', 'notMeasured'], CAST((session_id + idx) % 4 + 1 AS INTEGER)) AS consistency, count(*) AS n, true AS rolled FROM messages GROUP BY 1", "messages")
def a10_quality_sink(spark, d):
    """Files of seven rows at most, so the ledger is rolled many times."""
    path = scratch(spark, "quality")
    files.write_quality(_records(spark, d), path, rows_per_file=7)
    x = files.read_quality(spark, path)
    most = spark.read.text(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("c")).agg((F.max("c") <= 7).alias("rolled"))
    return x.groupBy("consistency").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(most), F.lit(True))  # one row


@query("SELECT id, 'own' AS provider, max_tokens FROM (VALUES " + ", ".join(f"('{r[0]}', CAST({1000 + i} AS INTEGER))" for i, r in enumerate(models.PROFILES) if i % 2 == 0) + ") AS v(id, max_tokens) UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', '{r[2]}', CAST({r[3]} AS INTEGER))" for i, r in enumerate(models.PROFILES) if i % 2) + ") AS w(id, provider, max_tokens)")
def a11_model_profiles(spark, d):
    builtin = models.profiles(spark).select("id", "provider", F.col("max_tokens").cast("int").alias("max_tokens"))
    custom = spark.createDataFrame([(r[0], "own", 1000 + i) for i, r in enumerate(models.PROFILES) if i % 2 == 0], builtin.schema)
    return files.overlay(builtin, custom)


@query("SELECT CASE WHEN source IN ('policy', 'governance') THEN 'rules' ELSE 'rest' END AS provider, source, count(*) AS n FROM signals GROUP BY 1, 2", "signals")
def a12_signal_providers(spark, d):
    p, rules = files.Providers(), F.col("source").isin("policy", "governance")
    p.register("rules", lambda s: t.signals(s, d).filter(rules))
    p.register("rest", lambda s: t.signals(s, d).filter(~rules).drop("conf"))
    return p.signals(spark).groupBy("provider", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'drift' AS event, event_type AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 2")
def a14_event_emit(spark, d):
    path = scratch(spark, "emitted")
    caches.emit(t.load(spark, d, "events").select("event_id", "event_type"), "drift", path)
    x = spark.read.parquet(path)
    return x.groupBy("event", F.get_json_object("payload", "$.event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("payload", "$.event_id").cast("long")).alias("ids"))


@query(
    """~ e AS (SELECT session_id, list_extract(['completed', 'deleted', 'completed', 'swept', 'released'], CAST(session_id % 5 + 1 AS INTEGER)) AS reason FROM (SELECT DISTINCT session_id FROM messages)),
r AS (SELECT session_id, content, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS rank FROM messages WHERE role = 'assistant')
SELECT session_id, '[subagent] ' || substr(content, 1, 200) AS content, rank FROM r JOIN e USING (session_id) WHERE reason = 'completed' AND rank <= 5""",
    "messages",
)
def a16_subagent_merge(spark, d):
    m = t.messages(spark, d)
    ended = m.select("session_id").distinct().withColumn("reason", _pick(["completed", "deleted", "completed", "swept", "released"], F.col("session_id")))
    return recall.subagent_memories(m.filter("role = 'assistant'"), ended, ["session_id"], [F.desc("idx")])


# --- B: gate and text -----------------------------------------------------------------------------


@query("SELECT session_id, idx, content || ' ' || role AS text FROM messages", "messages")
def b1_extract_text(spark, d):
    part = lambda text, thought: F.struct(text.cast("string").alias("text"), thought.cast("string").alias("thinking"))
    return t.messages(spark, d).select("session_id", "idx", tx.blocks_text(F.array(part(F.col("content"), F.lit(None)), part(F.lit(None), F.col("role")))).alias("text"))


@query(f"SELECT session_id, {_THRESH.format(m='avg(score)', s='stddev_pop(score)')} AS threshold FROM memories GROUP BY 1", "memories")
def b4_adaptive_threshold(spark, d):
    return t.memories(spark, d).groupBy("session_id").agg(gate.adaptive_threshold(F.avg("score"), F.stddev_pop("score")).alias("threshold"))


@query("SELECT session_id, idx, (idx % 3 = 1 AND idx % 2 = 0) OR idx % 5 = 0 AS derived FROM messages", "messages")
def b6_derived(spark, d):
    m = t.messages(spark, d)
    text = F.when(F.col("idx") % 5 == 0, F.concat(F.lit("[Compacted History - "), "content")).otherwise(F.col("content"))
    by = F.when(F.col("idx") % 2 == 0, F.col("role"))
    return m.select("session_id", "idx", F.coalesce(tx.is_derived(text, F.col("idx") % 3, by, F.col("session_id").cast("string")), F.lit(False)).alias("derived"))


@query("SELECT session_id, idx, array_to_string(list_filter([CAST(session_id AS VARCHAR), role, CASE WHEN idx = session_id THEN '' ELSE CAST(idx AS VARCHAR) END], lambda x: x <> ''), ',') AS ids FROM messages", "messages")
def b7_lineage(spark, d):
    s, i = F.col("session_id").cast("string"), F.col("idx").cast("string")
    ids = F.array(F.concat(F.lit(" "), s), F.lit("  "), F.col("role"), F.concat(F.col("role"), F.lit(" ")), i, s)
    return t.messages(spark, d).select("session_id", "idx", F.array_join(tx.lineage_ids(ids), ",").alias("ids"))


@query("SELECT event_id, rpad(substr(CAST(event_id * 7919 AS VARCHAR), 1, 8), 8, '0') AS hash FROM events")
def b11_session_hash(spark, d):
    return t.load(spark, d, "events").select("event_id", tx.session_hash(F.col("event_id") * 7919).alias("hash"))


@query("SELECT session_id, idx, '  - 3 msgs]   ' || content || ' |   ok |   more  ' AS text FROM messages", "messages")
def b14_without_scaffold(spark, d):
    tail = "Continue with the current task using the remaining recent context below."
    text = F.concat(F.lit("[Compacted History - 3 msgs] Recorded Findings: "), F.col("content"), F.lit(" | Workspace State: ok | Next Action: more "), F.lit(tail))
    return t.messages(spark, d).select("session_id", "idx", tx.without_scaffold(text).alias("text"))


@query("SELECT doc_id, substr(text, 1, 50) AS head FROM documents")
def b15_input_caps(spark, d):
    return t.load(spark, d, "documents").select("doc_id", tx.capped(F.col("text"), 50).alias("head"))


# --- C: tokens and budgets ------------------------------------------------------------------------

_CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]"


@query(f"SELECT doc_id, round(CASE WHEN length(x) = 0 THEN 0.85::DOUBLE ELSE 0.8::DOUBLE + 0.15::DOUBLE * (length(x) - length(regexp_replace(x, '{_CJK}', '', 'g'))) / length(x) END, 6) AS accuracy FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)")
def c3_heuristic_accuracy(spark, d):
    return t.load(spark, d, "documents").select("doc_id", F.round(tx.heuristic_accuracy(F.coalesce("text", F.lit(""))), 6).alias("accuracy"))


@query(r"SELECT doc_id, CAST(ceil(c + (n - c) / 3.5::DOUBLE) AS BIGINT) AS tokens FROM (SELECT doc_id, length(x) AS n, length(x) - length(regexp_replace(x, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]', '', 'g')) AS c FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))")
def c4_signal_tokens(spark, d):
    return t.load(spark, d, "documents").select("doc_id", tx.signal_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@query("SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0::DOUBLE) AS BIGINT) AS tokens FROM documents")
def c5_rough_tokens(spark, d):
    return t.load(spark, d, "documents").select("doc_id", tx.rough_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@query(f"SELECT session_id, idx, CASE WHEN idx % 3 = 0 THEN {TOK} WHEN idx % 3 = 1 THEN {TOK} + {TOK.replace('content', 'role')} ELSE 10 END AS tokens FROM messages", "messages")
def c6_message_tokens(spark, d):
    k = F.col("idx") % 3
    block = lambda text, given: F.struct(text.cast("string").alias("text"), given.cast("string").alias("input"))
    blocks = F.when(k == 1, F.array(block(F.col("content"), F.lit(None)), block(F.lit(None), F.col("role")))).otherwise(F.array(block(F.lit(None), F.lit(None))))
    return t.messages(spark, d).select("session_id", "idx", tx.message_tokens(F.when(k == 0, F.col("content")), blocks).cast("long").alias("tokens"))


def _profile(task: str, i: int) -> str:
    return "CASE " + task + " " + " ".join(f"WHEN '{k}' THEN {v[i]}.0::DOUBLE" for k, v in bg.PROFILES.items()) + f" ELSE {bg.PROFILES['unknown'][i]}.0::DOUBLE END"


_TASK_OF = f"list_extract({list(TASKS)!r}, CAST(({{0}}) % {len(TASKS)} + 1 AS INTEGER))"
#: Points that quality moves from base to buffer, and the base after it.
_MOVE = "CASE WHEN 0.5::DOUBLE - {q} > 0 THEN least(15.0::DOUBLE, (0.5::DOUBLE - {q}) * 20) ELSE -least(10.0::DOUBLE, -(0.5::DOUBLE - {q}) * 10) END"


@query(f"""WITH RECURSIVE x AS (SELECT conv_id AS session_id, turn AS idx, 5000.0::DOUBLE + conv_id % 7 * 1000 AS total, {_TASK_OF.format('conv_id + turn')} AS task, 1.0::DOUBLE - (turn * 3 % 10) / 10.0::DOUBLE AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
y AS (SELECT *, floor(greatest(10.0::DOUBLE, least(80.0::DOUBLE, {_profile('task', 0)} - ({_MOVE.format(q='q')}))) + 0.5) AS pct, CAST(floor(total * {_profile('task', 1)} / 100 + 0.5) AS BIGINT) AS cross_, CAST(floor(total * {_profile('task', 2)} / 100 + 0.5) AS BIGINT) AS ci FROM x),
f AS (SELECT session_id, r, idx, total, cross_, ci, greatest(1000.0::DOUBLE, floor(total * pct / 100 + 0.5)) AS base FROM y WHERE r = 1
 UNION ALL SELECT y.session_id, y.r, y.idx, y.total, y.cross_, y.ci, greatest(1000.0::DOUBLE, floor(y.total * (f.base / f.total * 100 + 0.3::DOUBLE * (y.pct - f.base / f.total * 100)) / 100 + 0.5)) FROM f JOIN y ON y.session_id = f.session_id AND y.r = f.r + 1)
SELECT session_id, idx, CAST(base AS BIGINT) AS base, cross_ AS "cross", ci, CAST(greatest(400.0, total - base - cross_ - ci) AS BIGINT) AS buffer FROM f""")
def c11_task_split(spark, d):
    m = t.messages(spark, d)
    x = m.select("session_id", "idx", (F.lit(5000) + F.col("session_id") % 7 * 1000).alias("total"), _pick(TASKS, F.col("session_id") + F.col("idx")).alias("task"), ((F.col("idx") * 3 % 10) / 10.0).alias("drift"))
    return reports.allocate(x, ["session_id"], "idx", "total", "task", "drift")


@query("SELECT event_id, floor(b + 0.5) AS base, greatest(5.0::DOUBLE, least(40.0::DOUBLE, 100.0::DOUBLE - floor(b + 0.5) - 10 - 10)) AS buffer FROM (SELECT event_id, greatest(10.0::DOUBLE, least(80.0::DOUBLE, 55.0::DOUBLE - (event_id % 120 - 50) / 2.0::DOUBLE)) AS b FROM events)")
def c13_budget_shift(spark, d):
    e = t.load(spark, d, "events")
    s = bg.budget_shift(F.lit(55.0), F.lit(25.0), F.lit(10.0), F.lit(10.0), (F.col("event_id") % 120 - 50) / 2.0)
    return e.withColumn("s", s).select("event_id", F.col("s.base").cast("double").alias("base"), F.col("s.buffer").cast("double").alias("buffer"))


@query(f"""WITH x AS (SELECT event_id, {_TASK_OF.format('event_id')} AS task, (event_id % 11) / 10.0::DOUBLE AS q FROM events),
y AS (SELECT event_id, floor(greatest(10.0::DOUBLE, least(80.0::DOUBLE, {_profile('task', 0)} - ({_MOVE.format(q='q')}))) + 0.5) AS base, {_profile('task', 1)} AS c, {_profile('task', 2)} AS i FROM x)
SELECT event_id, base, greatest(5.0::DOUBLE, least(40.0::DOUBLE, 100.0::DOUBLE - base - c - i)) AS buffer FROM y""")
def c14_incremental_adjust(spark, d):
    e = t.load(spark, d, "events")
    x = e.select("event_id", bg.incremental_adjust(_pick(TASKS, F.col("event_id")), (F.col("event_id") % 11) / 10.0).alias("s"))
    return x.select("event_id", F.col("s.base").cast("double").alias("base"), F.col("s.buffer").cast("double").alias("buffer"))


@query("SELECT event_id, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.5 THEN 'medium' WHEN s >= 0.3 THEN 'low' ELSE 'stable' END AS level FROM (SELECT event_id, (event_id * 29 % 100) / 100.0::DOUBLE AS s FROM events)")
def c15_drift_level(spark, d):
    return t.load(spark, d, "events").select("event_id", bg.drift_level((F.col("event_id") * 29 % 100) / 100.0).alias("level"))


@query("SELECT event_id, round(CASE WHEN x > 4000 THEN floor(5000 * 0.7::DOUBLE) / x WHEN x > 4000 * 0.85::DOUBLE THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 6) AS ratio FROM (SELECT event_id, input_tokens AS x FROM ledger)", "ledger")
def c19_compression_target(spark, d):
    return t.ledger(spark, d).select("event_id", F.round(bg.compression_target(F.col("input_tokens"), F.lit(4000), F.lit(5000)), 6).alias("ratio"))


@query("SELECT event_id, input_tokens >= 4000 AS compress, round(CASE WHEN output_tokens % 7 = 0 THEN 0.0::DOUBLE ELSE input_tokens / (output_tokens % 7)::DOUBLE END, 6) AS usage FROM ledger", "ledger")
def c20_should_compress(spark, d):
    x = t.ledger(spark, d)
    return x.select("event_id", bg.should_compress(F.col("input_tokens"), F.lit(4000)).alias("compress"), F.round(bg.usage_ratio(F.col("input_tokens"), F.col("output_tokens") % 7), 6).alias("usage"))


# --- D: selection ---------------------------------------------------------------------------------


@query(f"""~ x AS (SELECT session_id, idx, {TOK} AS tokens FROM messages), r AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY idx DESC ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS pos FROM x),
g AS (SELECT session_id, count(*) AS n, max(CASE WHEN run > 300 THEN pos END) AS over FROM r GROUP BY 1) SELECT session_id, n - CASE WHEN over IS NULL THEN 0 ELSE least(n, greatest(3, over + 1)) END AS kept FROM g""", "messages")
def d4_keep_count(spark, d):
    m = t.messages(spark, d).select("session_id", "idx", tx.heuristic_tokens(F.col("content")).alias("tokens"))
    return select.suffix_keep(m, ["session_id"], "idx", "tokens", 300, least=3).select("session_id", (F.col("n") - F.col("keep_from")).alias("kept"))


def _chunked(budget: int, chunk: int) -> str:
    return f"""WITH RECURSIVE messages AS ({t.SQL['messages'].removeprefix('messages AS (')[:-1]}), x AS (SELECT session_id, idx, CAST(ceil(length(content) / 4.0::DOUBLE) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS r FROM messages),
f AS (SELECT session_id, idx, r, tokens, {budget}.0::DOUBLE AS lft, CASE WHEN tokens <= {budget}.0::DOUBLE * 0.9::DOUBLE THEN tokens ELSE 0 END AS used, tokens <= {budget}.0::DOUBLE * 0.9::DOUBLE AS kept FROM x WHERE r = 0
 UNION ALL SELECT session_id, idx, r, tokens, lft, CASE WHEN ok THEN used + tokens ELSE used END, ok FROM (SELECT *, used + tokens <= lft * 0.9::DOUBLE AS ok FROM (SELECT x.session_id, x.idx, x.r, x.tokens,
  CASE WHEN x.r % {chunk} = 0 THEN f.lft - f.used ELSE f.lft END AS lft, CASE WHEN x.r % {chunk} = 0 THEN 0 ELSE f.used END AS used FROM f JOIN x ON x.session_id = f.session_id AND x.r = f.r + 1)))"""


def _rough(spark, d):
    return t.messages(spark, d).select("session_id", "idx", "content", tx.rough_tokens(F.col("content")).alias("tokens"))


@query(_chunked(2000, 3) + " SELECT session_id, idx, tokens, r // 3 AS chunk, kept FROM f")
def d5_streaming_fill(spark, d):
    return select.chunked_fill(_rough(spark, d), ["session_id"], "idx", "tokens", 2000, chunk=3)


@query(_chunked(1200, 2) + " SELECT session_id, count_if(kept) AS kept, count_if(NOT kept) AS removed, CAST(coalesce(sum(CASE WHEN kept THEN tokens END), 0) AS BIGINT) AS used, max(r // 2) + 1 AS chunks FROM f GROUP BY 1")
def d6_chunked_compression(spark, d):
    x = select.chunked_fill(_rough(spark, d), ["session_id"], "idx", "tokens", 1200, chunk=2)
    return x.groupBy("session_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("tokens"))), F.lit(0)).alias("used"), (F.max("chunk") + 1).alias("chunks"))


@query("SELECT id, source, CAST(coalesce(list_position(['policy', 'session', 'ci_pipeline'], source) - 1, 999) AS INTEGER) AS place FROM signals", "signals")
def d12_preload_order(spark, d):
    order = F.array(*map(F.lit, ("policy", "session", "ci_pipeline")))
    return t.signals(spark, d).select("id", "source", tx.preload_rank(F.col("source"), order).cast("int").alias("place"))


@query("SELECT session_id, event_id, \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY \"at\" DESC, event_id DESC) AS r FROM ledger) WHERE r <= 60", "ledger")
def d18_ledger_cap(spark, d):
    return digest.last_n(t.ledger(spark, d), ["session_id"], [F.desc("at"), F.desc("event_id")]).select("session_id", "event_id", "at")


@query("SELECT session_id, idx, CASE WHEN idx % 2 = 0 THEN substr(content, 4, 12) ELSE substr(content, 1, 5) || '~' END AS span FROM messages WHERE idx % 2 = 0 OR contains(content, substr(content, 1, 5) || '~')", "messages")
def e8_claim_spans(spark, d):
    m = t.messages(spark, d)
    span = F.when(F.col("idx") % 2 == 0, F.substring("content", 4, 12)).otherwise(F.concat(F.substring("content", 1, 5), F.lit("~")))
    return digest.valid_claims(m.select("session_id", "idx", span.alias("span")), m, ["session_id", "idx"]).select("session_id", "idx", "span")


# --- F, G: aggregates and turns -------------------------------------------------------------------

_WORDS_OF = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\w\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 2))"
_LIKE = "(len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE > 0.3)"


@query(f"""~ w AS (SELECT event_id, key_points[1] AS p1, key_points[2] AS p2, theme AS p3 FROM summaries), s AS (SELECT *, {_WORDS_OF.format('p1')} AS a, {_WORDS_OF.format('p2')} AS b, {_WORDS_OF.format('p3')} AS c FROM w),
k AS (SELECT *, NOT {_LIKE.format(a='a', b='b')} AS k2, {_LIKE.format(a='a', b='c')} AS l13, {_LIKE.format(a='b', b='c')} AS l23 FROM s)
SELECT event_id, p1 || CASE WHEN k2 THEN '|' || p2 ELSE '' END || CASE WHEN NOT l13 AND NOT (k2 AND l23) THEN '|' || p3 ELSE '' END AS points FROM k""", "summaries")
def f10_greedy_distinct(spark, d):
    s = t.summaries(spark, d)
    return s.select("event_id", F.array_join(resume.greedy_distinct(F.concat("key_points", F.array("theme")), 0.3), "|").alias("points"))


@query("""~ x AS (SELECT session_id, unnest(regexp_split_to_array(lower(theme), '\\s+')) AS word FROM summaries), c AS (SELECT session_id, word, count(*) AS n FROM x WHERE word <> '' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 4""", "summaries")
def f11_top_words(spark, d):
    return resume.top_words(t.summaries(spark, d), ["session_id"], "theme", 4)


@query("SELECT event_id, CASE WHEN n = 0 THEN 'unhealthy' WHEN p / n::DOUBLE >= 0.8 THEN 'healthy' WHEN p / n::DOUBLE >= 0.5 THEN 'degraded' ELSE 'unhealthy' END AS status, round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE p / n::DOUBLE END, 6) AS share FROM (SELECT event_id, event_id % 6 AS n, (event_id // 6) % (event_id % 6 + 1) AS p FROM events)")
def f19_health(spark, d):
    e = t.load(spark, d, "events").select("event_id", (F.col("event_id") % 6).alias("n"), (F.floor(F.col("event_id") / 6) % (F.col("event_id") % 6 + 1)).alias("p"))
    return e.select("event_id", reports.health_status(F.col("p"), F.col("n")).alias("h")).select("event_id", "h.status", F.round("h.share", 6).alias("share"))


@query("""SELECT event_id, round(CASE WHEN x = 0 AND z = 0 THEN 1.0::DOUBLE WHEN x = 0 OR z = 0 THEN 0.0::DOUBLE WHEN x = 1 THEN CASE WHEN z = 1 THEN 0.0::DOUBLE ELSE 0.0::DOUBLE END
 ELSE CASE WHEN z = 1 THEN w / sqrt(1.0::DOUBLE + w * w) ELSE w * (w + 1) / (sqrt(1.0::DOUBLE + w * w) * sqrt((w + 1) * (w + 1) + 4.0::DOUBLE)) END END, 6) AS similarity
FROM (SELECT event_id, event_id % 3 AS x, (event_id // 3) % 3 AS z, (event_id % 7 + 1) / 2.0::DOUBLE AS w FROM events)""")
def g1_topic_cosine(spark, d):
    """Maps of no, one and two topics against each other."""
    e = t.load(spark, d, "events")
    w, x, z = (F.col("event_id") % 7 + 1) / 2.0, F.col("event_id") % 3, F.floor(F.col("event_id") / 3) % 3
    none = F.create_map().cast("map<string,double>")
    a = F.when(x == 0, none).when(x == 1, F.create_map(F.lit("build"), F.lit(1.0))).otherwise(F.create_map(F.lit("build"), F.lit(1.0), F.lit("test"), w))
    b = F.when(z == 0, none).when(z == 1, F.create_map(F.lit("test"), w)).otherwise(F.create_map(F.lit("test"), w + 1, F.lit("docs"), F.lit(2.0)))
    return e.select("event_id", F.round(drift.cosine(a, b), 6).alias("similarity"))


@query("SELECT user_id, event_id, coalesce(event_type = lag(event_type) OVER w AND event_id % 2 = lag(event_id) OVER w % 2, false) AS redo FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def g16_redo_loop(spark, d):
    e = t.load(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 2).alias("args"))
    return drift.repeats(e, ["user_id"], "event_id", ["event_type", "args"]).select("user_id", "event_id", "redo")


@query("SELECT session_id, CAST(count(*) AS INTEGER) AS turns, arg_max(trigger, (\"at\", event_id)) AS last, CAST(sum(input_tokens) AS BIGINT) AS so_far FROM ledger GROUP BY 1", "ledger")
def g19_last_evaluation(spark, d):
    from ..operators import ledger

    x = ledger.usage_turns(t.ledger(spark, d))
    return x.groupBy("session_id").agg(F.max("turn").alias("turns"), F.max_by("trigger", F.struct("at", "event_id")).alias("last"), F.max("so_far").alias("so_far"))


# --- I, J: text -----------------------------------------------------------------------------------


@query("SELECT session_id, idx, CAST(pos AS INTEGER) AS pos, sentence FROM (" + ORACLE_SQL["i16_confirmed"].split(", f AS (SELECT")[0] + " SELECT session_id, idx, pos, sentence FROM s) WHERE sentence <> ''")
def i15_sentences(spark, d):
    return digest.sentences(t.messages(spark, d)).select("session_id", "idx", "pos", "sentence")


@query("SELECT session_id, idx, role AS kind, 'said ' || CAST(idx AS VARCHAR) AS text, (idx % 10) / 10.0::DOUBLE AS confidence FROM messages", "messages")
def i20_digest_round_trip(spark, d):
    """Entries as one text for each session, and back."""
    m = t.messages(spark, d)
    x = m.select("session_id", F.col("idx").alias("seq"), F.col("role").alias("kind"), F.concat(F.lit("said "), F.col("idx").cast("string")).alias("text"), ((F.col("idx") % 10) / 10.0).alias("confidence"))
    back = digest.parse(digest.serialize(x, ["session_id"]), ["session_id"])
    return back.select("session_id", F.regexp_extract("text", r"(\d+)", 1).cast("long").alias("idx"), "kind", "text", "confidence")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '[Image: ' || url || ']' WHEN 1 THEN '[Audio transcript unavailable: ' || url || ']' WHEN 2 THEN '[Video: ' || url || ']' ELSE url END AS text FROM pages")
def i30_describe_media(spark, d):
    return t.load(spark, d, "pages").select("page_id", tx.describe_media(_pick(("image", "audio", "video", "link"), F.col("page_id")), F.col("url")).alias("text"))


@query(r"SELECT session_id, idx, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2 AND NOT list_contains(['the', 'and', 'for', 'with', 'that', 'this', 'are', 'was', 'is', 'to', 'of', 'in', 'on', 'a', 'an'], w)))), ' ') AS topics FROM messages", "messages")
def i31_role_topics(spark, d):
    return t.messages(spark, d).select("session_id", "idx", F.array_join(F.array_sort(signals.topics(F.col("content"))), " ").alias("topics"))


@query("SELECT session_id, idx, least(1.0::DOUBLE, floor((CASE WHEN length(content) > 500 THEN 0.3::DOUBLE WHEN length(content) > 200 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN n > 5 THEN 0.2::DOUBLE WHEN n > 2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END" + "".join(f" + CASE WHEN {_any('content', [p])} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in tx.COMPLEX) + ") * 100 + 0.5) / 100) AS complexity FROM (SELECT *, len(list_filter(regexp_split_to_array(content, '[.!?]+'), lambda s: length(trim(s)) > 10)) AS n FROM messages)", "messages")
def j6_complexity(spark, d):
    return t.messages(spark, d).select("session_id", "idx", tx.complexity(F.col("content")).alias("complexity"))


_PROMPT_TASKS = tuple(tx.TASK_MAP)


@query(f"SELECT event_id, task, CASE task {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in tx.TASK_MAP.items())} ELSE 'unknown' END AS mapped FROM (SELECT event_id, list_extract({[*_PROMPT_TASKS, 'other']!r}, CAST(event_id % {len(_PROMPT_TASKS) + 1} + 1 AS INTEGER)) AS task FROM events)")
def j8_task_map(spark, d):
    task = _pick((*_PROMPT_TASKS, "other"), F.col("event_id"))
    return t.load(spark, d, "events").select("event_id", task.alias("task"), tx.mapped_task(task).alias("mapped"))


@query(f"SELECT event_id, CASE task {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in bg.ASSEMBLY.items())} ELSE 'balanced' END AS strategy FROM (SELECT event_id, list_extract({[*bg.ASSEMBLY, 'other']!r}, CAST(event_id % {len(bg.ASSEMBLY) + 1} + 1 AS INTEGER)) AS task FROM events)")
def j9_assembly_strategy(spark, d):
    return t.load(spark, d, "events").select("event_id", bg.assembly_strategy(_pick((*bg.ASSEMBLY, "other"), F.col("event_id"))).alias("strategy"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN k * 2 ELSE k * 3 END AS asked FROM (SELECT event_id, event_id % 9 + 1 AS k FROM events)")
def j16_expansion(spark, d):
    return t.load(spark, d, "events").select("event_id", resume.expansion_k(F.col("event_id") % 9 + 1, F.col("event_id") % 4).alias("asked"))


_ASKED = tuple(p[0] for p in models.PROFILES[:5]) + ("no-such-model",)


@query("SELECT event_id, asked, " + ", ".join(f"coalesce({c}, {v!r}) AS {c}" for c, v in (("max_tokens", models.DEFAULTS[3]), ("strategy", models.DEFAULTS[5]), ("threshold", models.DEFAULTS[6]))) + f" FROM (SELECT event_id, list_extract({list(_ASKED)!r}, CAST(event_id % {len(_ASKED)} + 1 AS INTEGER)) AS asked FROM events) LEFT JOIN (VALUES " + ", ".join(f"({p[0]!r}, {p[3]}, {p[5]!r}, {p[6]})" for p in models.PROFILES) + ") AS v(id, max_tokens, strategy, threshold) ON id = asked")
def j22_model_hint(spark, d):
    e = t.load(spark, d, "events").select("event_id", _pick(_ASKED, F.col("event_id")).alias("asked"))
    return models.hint(models.resolve(e, models.profiles(spark))).select("event_id", "asked", "max_tokens", "strategy", "threshold")


# --- K, L: engine and streams ---------------------------------------------------------------------


def _engine(spark, d):
    from ..api import ContextEngine

    return ContextEngine(spark, t.messages(spark, d), t.memories(spark, d))


@query("SELECT session_id, count(*) + count_if(length(content) >= 60 AND NOT starts_with(content, 'HEARTBEAT')) AS n FROM messages GROUP BY 1", "messages")
def k3_after_turn(spark, d):
    m = t.messages(spark, d)
    return _engine(spark, d).ingest(m, least=60).messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT session_id, count(*) AS n FROM messages WHERE session_id <> 3 GROUP BY 1", "messages")
def k18_session_close(spark, d):
    return _engine(spark, d).close(3).messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT session_id, CAST(sum({TOK}) AS BIGINT) AS used, 8000 - CAST(sum({TOK}) AS BIGINT) AS \"left\" FROM messages GROUP BY 1", "messages")
def k19_smart_budget(spark, d):
    return _engine(spark, d).budget(8000).select("session_id", "used", "left")


@query(f"SELECT session_id, count(*) AS messages, CAST(sum({TOK}) AS BIGINT) AS tokens, max(idx) AS last_idx FROM messages GROUP BY 1", "messages")
def l2_running_state(spark, d):
    m = t.messages(spark, d).select("session_id", "idx", "content")
    x = _drained(spark, m, "state", sessions.running_state, "update")
    return x.groupBy("session_id").agg(F.max("messages").alias("messages"), F.max("tokens").alias("tokens"), F.max("last_idx").cast("int").alias("last_idx"))


@query(_chunked(2000, 3) + " SELECT session_id, idx FROM f WHERE kept")
def l3_stream_fill(spark, d):
    m = t.messages(spark, d).select("session_id", "idx", "content").repartition(1)
    return _drained(spark, m, "fill", lambda s: sessions.budget_stream(s, 2000, chunk=3))


@query("SELECT DISTINCT content, length(content) AS chars FROM messages", "messages")
def l5_batch_counts(spark, d):
    """Each distinct text is counted once, and there is a count for each."""
    return bpe.count_distinct_texts(t.messages(spark, d), out="chars", count=F.char_length).select("content", "chars").distinct()


@query("""~ p AS (SELECT trigger AS task, max("at") AS "at" FROM ledger GROUP BY 1), i AS (SELECT trigger AS task, max("at") AS own FROM ledger WHERE share IS NULL AND trigger IN ('click', 'view') GROUP BY 1)
SELECT p.task, p."at" FROM p LEFT JOIN i USING (task) WHERE own IS NULL OR p."at" > own""", "ledger")
def l6_preload_cache(spark, d):
    x = t.ledger(spark, d).select(F.col("trigger").alias("task"), "at", "share")
    gone = x.filter("share is null and task in ('click', 'view')").select("task", "at")
    return caches.preloaded(x.select("task", "at"), gone, "task", 0, ttl_ms=10**15)


@query("""WITH RECURSIVE x AS (SELECT user_id AS session_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events),
f AS (SELECT session_id, r, "at", 1 AS n, "at" AS last, true AS ok FROM x WHERE r = 1 UNION ALL SELECT session_id, r, "at", CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN "at" ELSE last END, ok FROM (SELECT x.session_id, x.r, x."at", f.n, f.last, f.n < 5 AND x."at" - f.last >= 300000 AS ok FROM f JOIN x ON x.session_id = f.session_id AND x.r = f.r + 1))
SELECT session_id, "at" FROM f WHERE ok""")
def l7_trigger_stream(spark, d):
    e = t.ledger(spark, d).select("session_id", "at").repartition(1)
    return _drained(spark, e, "triggers", sessions.cooldown_stream)
