"""More queries of the context engine: session state, search, reports, message parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bpe
from ..functions import text as tx
from ..operators import drift, recall, reports, select, state
from ..sources import tables as t
from .queries import TOK, _any, _has, _mentions, _turns, query


def _all(col: str, pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"regexp_extract_all({col}, '{p}', {group})"


# --- state: entities, decisions, actions, topics --------------------------------------------------

_ENT = "e AS (" + " UNION ALL ".join(f"SELECT session_id, idx, unnest(generate_series(1, len(l))) - 1 AS pos, unnest(l) AS v, '{k}' AS type, {r} AS rank FROM (SELECT session_id, idx, {_all('content', p, g)} AS l FROM messages)" for r, (k, p, g) in enumerate((("file", state.FILES, 1), ("tool", state.TOOLS, 0), ("person", state.PERSONS, 0), ("concept", state.CONCEPTS, 1)))) + "), ge AS (SELECT session_id, lower(v) AS key, count(*) AS mentions, arg_min(v, (rank, idx, pos)) AS name, arg_min(type, (rank, idx, pos)) AS type FROM e GROUP BY 1, 2)"


@query(f"~ {_ENT} SELECT session_id, key, name, type, mentions FROM ge", "messages")
def i5_typed_entities(spark, d):
    return state.typed_entities(t.messages(spark, d), ["session_id"])


@query(f"~ {_ENT} SELECT session_id, count_if(type = 'file') AS file, count_if(type = 'tool') AS tool, count_if(type = 'person') AS person, count_if(type = 'concept') AS concept FROM ge GROUP BY 1", "messages")
def i9_entities_by_type(spark, d):
    return state.by_type(state.typed_entities(t.messages(spark, d), ["session_id"]), ["session_id"])


_DEC = "d AS (" + " UNION ALL ".join(f"SELECT session_id, idx, unnest(generate_series(1, len(l))) - 1 AS pos, trim(unnest(l)) AS v, {r} AS rank FROM (SELECT session_id, idx, {_all('content', p)} AS l FROM messages)" for r, p in enumerate(state.DECISIONS)) + "), gd AS (SELECT session_id, lower(v) AS key, arg_min(v, (rank, idx, pos)) AS description FROM d WHERE length(v) >= 10 GROUP BY 1, 2)"


@query(f"""~ {_DEC} SELECT session_id, key, description, CASE WHEN {_any('description', [r'(?i)\b(I|me|my)\b'])} THEN 'user' WHEN {_any('description', [r"(?i)\b(we|our|us|let's|lets)\b"])} THEN 'team' WHEN {_any('description', [r'(?i)\b(AI|assistant|agent|EDITH|Jarvis|Friday)\b'])} THEN 'agent' ELSE 'unknown' END AS actor,
least(1.0::DOUBLE, (5 + CAST(length(description) > 20 AS INTEGER) + CAST(length(description) > 50 AS INTEGER) + CASE WHEN {_any('description', [r'(?i)\b(decided|agreed|chose|selected|will use)\b'])} THEN 2 ELSE 0 END + CASE WHEN {_any('description', [r'(?i)\b(because|since|due to|for the reason)\b'])} THEN 1 ELSE 0 END) / 10.0::DOUBLE) AS confidence FROM gd""", "messages")
def i6_decisions_with_actor(spark, d):
    return state.decisions(t.messages(spark, d), ["session_id"])


_TAG = "c AS (" + " UNION ALL ".join(f"SELECT session_id, '{k}' AS label, {i} AS place, CAST(sum(len(regexp_extract_all(lower(content), '\\b{k}\\b'))) AS BIGINT) AS n FROM messages GROUP BY 1" for i, k in enumerate(state.TOPIC_TAGS)) + ")"


@query(f"~ {_TAG}, r AS (SELECT *, n / max(n) OVER (PARTITION BY session_id)::DOUBLE AS weight, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, place) AS r FROM c WHERE n > 0) SELECT session_id, label, weight FROM r WHERE r <= 10", "messages")
def i7_topic_tags(spark, d):
    return state.topic_tags(t.messages(spark, d), ["session_id"])


@query("SELECT session_id, idx, type, trim(description) AS description FROM (" + " UNION ALL ".join(f"SELECT session_id, idx, '{k}' AS type, unnest({_all('content', p)}) AS description FROM messages" for k, p in state.ACTIONS) + ")", "messages")
def i8_actions(spark, d):
    return state.actions(t.messages(spark, d), ["session_id"])


@query(f"""~ {_ENT.replace("FROM messages", "FROM messages WHERE TRUE")}, s AS (SELECT session_id, key, name, type, mentions, CASE WHEN session_id % 2 = 0 THEN 0 ELSE 1 END AS half FROM ge)
SELECT session_id // 2 AS pair, key, arg_min(name, half) AS name, arg_min(type, half) AS type, CAST(sum(mentions) AS BIGINT) AS mentions FROM s GROUP BY 1, 2""", "messages")
def e14_merge_entities(spark, d):
    e = state.typed_entities(t.messages(spark, d), ["session_id"]).withColumn("pair", F.floor(F.col("session_id") / 2))
    side = lambda k: e.filter(F.col("session_id") % 2 == k).drop("session_id")
    return state.merge_entities(side(0), side(1), ["pair"])


@query(f"""~ {_DEC}, p AS (SELECT session_id // 2 AS pair, session_id % 2 AS half, key, description FROM gd)
SELECT pair, key, description FROM p WHERE half = 0 UNION ALL SELECT pair, key, description FROM p b WHERE half = 1 AND NOT EXISTS (SELECT 1 FROM p a WHERE a.half = 0 AND a.pair = b.pair AND a.key = b.key)""", "messages")
def e14_merge_decisions(spark, d):
    e = state.decisions(t.messages(spark, d), ["session_id"]).withColumn("pair", F.floor(F.col("session_id") / 2)).select("pair", "session_id", "key", "description")
    side = lambda k: e.filter(F.col("session_id") % 2 == k).drop("session_id")
    return state.merge_decisions(side(0), side(1), ["pair"])


@query(f"""~ c AS (SELECT session_id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND NOT list_contains({list(state.STOP)!r}, x)) AS l, regexp_replace(content, '[^\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{f900}}-\\x{{faff}}]', '', 'g') AS ch FROM messages),
w AS (SELECT session_id, unnest(list_concat(l, list_transform(generate_series(1, length(ch) - 1), lambda i: substr(ch, CAST(i AS INTEGER), 2)))) AS word FROM c), k AS (SELECT session_id, bool_or(length(ch) > 0) AS cjk FROM c GROUP BY 1),
g AS (SELECT session_id, word, count(*) AS n FROM w GROUP BY 1, 2), h AS (SELECT g.* FROM g JOIN k USING (session_id) WHERE n >= 2 OR cjk),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, word) AS r FROM h) SELECT session_id, word, n FROM r WHERE r <= 5""", "messages")
def i10_theme_keywords(spark, d):
    return state.theme_keywords(t.messages(spark, d), ["session_id"])


@query(None)
def i12_session_summaries(spark, d):
    x = state.summaries(t.messages(spark, d), ["session_id"])
    return x.select("session_id", "n_messages", "theme", *[F.array_join(c, "|").alias(c) for c in ("tasks", "points", "entities")])


@query(f"""~ x AS (SELECT session_id, 'file' AS kind, idx, unnest(generate_series(1, len(l))) - 1 AS pos, unnest(l) AS value FROM (SELECT session_id, idx, {_all('content', state.FILES, 1)} AS l FROM messages)
 UNION ALL SELECT session_id, 'id', idx, unnest(generate_series(1, len(l))) - 1, unnest(l) FROM (SELECT session_id, idx, {_all('content', state.IDENT)} AS l FROM messages)),
g AS (SELECT session_id, kind, value, min((-idx, pos)) AS o FROM x GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY o) AS rank FROM g)
SELECT session_id, kind, value, rank FROM r WHERE rank <= 20""", "messages")
def i13_handoff_identifiers(spark, d):
    return state.handoff(t.messages(spark, d), ["session_id"])


@query(None)
def i14_handoff_records(spark, d):
    return state.handoff_record(t.messages(spark, d), ["session_id"])


@query("~ m AS (SELECT session_id, event_id AS idx, unnest(list_distinct(entities)) AS entity FROM summaries) SELECT session_id, entity, count(*) AS n FROM m GROUP BY 1, 2", "summaries")
def f7_entity_frequency(spark, d):
    return _mentions(spark, d).groupBy("session_id", "entity").agg(F.count(F.lit(1)).alias("n"))


# --- search and copies ----------------------------------------------------------------------------


@query("""WITH i AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM i) GROUP BY 1, 2), s AS (SELECT id, CAST(sum(tf) AS DOUBLE) AS len FROM t GROUP BY 1),
c AS (SELECT count(*) AS n, avg(len) AS a FROM s), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM benchmark),
h AS (SELECT q.query_id, t.id, round(sum(ln(1 + (c.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * t.tf * 2.2::DOUBLE / (t.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * s.len / c.a))), 6) AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN s ON s.id = t.id, c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h) SELECT query_id, id, round(score, 4) AS score, rank FROM r WHERE rank <= 5""")
def a4_search_bm25(spark, d):
    items = t.load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    queries = t.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return recall.search(items, queries, k=5).withColumn("score", F.round("score", 4))


@query("""~ a AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, id) AS r FROM memories),
x AS (SELECT session_id, id FROM a WHERE r <= 3), y AS (SELECT session_id, id FROM memories WHERE id % 7 = 0) SELECT * FROM x UNION ALL SELECT * FROM y WHERE id NOT IN (SELECT id FROM x)""", "memories")
def e15_expanded_hits(spark, d):
    m = t.memories(spark, d).select("session_id", "id", "score")
    first = select.top_k(m, ["session_id"], [F.desc("score"), F.col("id")], 3).select("session_id", "id")
    return recall.add_new(first, m.filter("id % 7 = 0").select("session_id", "id"), ["id"])


@query(f"SELECT session_id, content, rank FROM (SELECT session_id, substr(content, 1, 300) AS content, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS rank FROM messages WHERE {_has('content', ('important', 'critical', 'decided', 'must'))}) WHERE rank <= 10", "messages")
def a15_memory_flush(spark, d):
    m = t.messages(spark, d).withColumn("imp", tx.has_words(F.col("content"), ("important", "critical", "decided", "must")))
    return recall.copies(m, ["session_id"], "imp", [F.desc("idx")])


@query("SELECT session_id, idx FROM messages WHERE length(content) >= 60 AND NOT starts_with(content, 'HEARTBEAT')", "messages")
def a5_ingest_filter(spark, d):
    from ..sources.files import ingestable

    return ingestable(t.messages(spark, d), least=60).select("session_id", "idx")


# --- reports --------------------------------------------------------------------------------------

_CQ = "c AS (SELECT session_id, idx AS \"at\", CASE WHEN idx % 2 = 0 THEN 'auto' ELSE 'explicit' END AS trigger, content AS summary, list_extract(['pass', 'rejected', 'degraded', 'notMeasured'], CAST((session_id + idx) % 4 + 1 AS INTEGER)) AS consistency FROM messages)"


@query(f"""~ {_CQ} SELECT role_ AS half, count(*) AS samples, round(count_if(trigger = 'auto') / count(*)::DOUBLE, 6) AS proactive_rate, floor(count_if(NOT {_has('summary', tx.STATE_WORDS)}) * 10000 / count(*)::DOUBLE + 0.5) / 100 AS missing_state_pct, floor(count_if(NOT {_has('summary', tx.ACTION_WORDS)}) * 10000 / count(*)::DOUBLE + 0.5) / 100 AS missing_action_pct,
count_if(consistency = 'pass') AS pass, count_if(consistency = 'rejected') AS rejected, count_if(consistency = 'degraded') AS degraded, count_if(consistency = 'notMeasured') AS "notMeasured", round(count_if(consistency IN ('rejected', 'degraded')) / count(*)::DOUBLE, 6) AS violation_rate, min("at") AS first_at, max("at") AS last_at FROM (SELECT *, session_id % 2 AS role_ FROM c) GROUP BY 1""", "messages")
def f2_compaction_quality(spark, d):
    m = t.messages(spark, d)
    r = m.select((F.col("session_id") % 2).alias("half"), F.col("idx").alias("at"), F.when(F.col("idx") % 2 == 0, "auto").otherwise("explicit").alias("trigger"), F.col("content").alias("summary"), F.element_at(F.array(*map(F.lit, reports.OUTCOMES)), (F.pmod(F.col("session_id") + F.col("idx"), F.lit(4)) + 1).cast("int")).alias("consistency"))
    return reports.compaction_quality(r, ["half"])


@query("SELECT event_id, abs(a - 2000) / 2000.0::DOUBLE AS delta_rate, b - 3000 AS trigger_gap FROM (SELECT event_id, output_tokens AS a, input_tokens AS b FROM ledger)", "ledger")
def f5_waste(spark, d):
    x = t.ledger(spark, d).withColumn("w", reports.waste(F.col("output_tokens"), F.lit(2000), F.col("input_tokens"), F.lit(3000)))
    return x.select("event_id", "w.delta_rate", "w.trigger_gap")


@query("~ g AS (SELECT trigger AS strategy, count(*) AS uses, count_if(share > 0.5) AS wins, round(avg(share), 6) AS mean_reward FROM ledger WHERE share IS NOT NULL GROUP BY 1) SELECT *, round(greatest(0.02::DOUBLE, 0.15::DOUBLE * pow(0.95::DOUBLE, sum(uses) OVER ())), 6) AS epsilon FROM g", "ledger")
def f17_strategy_feedback(spark, d):
    x = t.ledger(spark, d).filter("share is not null")
    return reports.strategy_feedback(x.select(F.col("trigger").alias("strategy"), F.col("share").alias("reward")))


@query("SELECT session_id, count(*) AS turns, count_if(score > 0.6) AS drifted, round(avg(score), 6) AS mean, max(score) AS peak FROM (SELECT user_id AS session_id, (event_id * 29 % 100) / 100.0::DOUBLE AS score FROM events) GROUP BY 1")
def g6_drift_report(spark, d):
    x = t.load(spark, d, "events").select(F.col("user_id").alias("session_id"), (F.pmod(F.col("event_id") * 29, F.lit(100)) / 100.0).alias("score"))
    return reports.drift_report(x)


@query("""WITH RECURSIVE x AS (SELECT user_id AS session_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT session_id, r, n, v AS a FROM x WHERE r = 1 UNION ALL SELECT x.session_id, x.r, x.n, f.a + 0.3::DOUBLE * (x.v - f.a) FROM f JOIN x ON x.session_id = f.session_id AND x.r = f.r + 1) SELECT session_id, round(a, 6) AS last FROM f WHERE r = n""")
def g17_budget_ema(spark, d):
    x = t.load(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", "value")
    return reports.ema(x, ["session_id"], "event_id", "value").withColumn("last", F.round("last", 6))


@query("""WITH h AS (SELECT DISTINCT event_type AS task, event_id // 5 AS unit, user_id AS key FROM events),
f AS (SELECT task, key, min(unit) AS f FROM h GROUP BY 1, 2), ten AS (SELECT task, key AS own FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY f, key) AS r FROM f) WHERE r <= 10),
u AS (SELECT DISTINCT unit, key FROM h), p AS (SELECT a.key AS own, b.key AS other, count(*) AS c FROM u a JOIN u b ON a.unit = b.unit AND a.key <> b.key GROUP BY 1, 2),
g AS (SELECT ten.task, p.other AS key, CAST(sum(c) AS BIGINT) AS n FROM ten JOIN p ON p.own = ten.own WHERE NOT EXISTS (SELECT 1 FROM ten x WHERE x.task = ten.task AND x.own = p.other) GROUP BY 1, 2),
r AS (SELECT *, least(0.7::DOUBLE, n / max(n) OVER (PARTITION BY task)::DOUBLE) AS confidence, row_number() OVER (PARTITION BY task ORDER BY n DESC, key) AS rank FROM g) SELECT task, key, n, round(confidence, 6) AS confidence, rank FROM r WHERE rank <= 5""")
def j21_predict_cooccurring(spark, d):
    h = t.load(spark, d, "events").select(F.col("event_type").alias("task"), F.floor(F.col("event_id") / 5).alias("unit"), F.col("user_id").alias("key")).distinct()
    return reports.cooccurring(h, "task", "unit", "key").withColumn("confidence", F.round("confidence", 6))


@query("""WITH h AS MATERIALIZED (SELECT user_id, event_id, event_id // 5 AS unit, CAST(json_extract_string(props, '$.k') AS BIGINT) AS key FROM events),
l AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM h WHERE key IS NOT NULL) WHERE r <= 10),
u AS MATERIALIZED (SELECT DISTINCT unit, key FROM h), p AS MATERIALIZED (SELECT a.key AS own, b.key AS other, count(*) AS c FROM u a JOIN u b ON a.unit = b.unit AND a.key <> b.key GROUP BY 1, 2),
g AS (SELECT l.user_id, p.other AS key, CAST(sum(c) AS BIGINT) AS n FROM l JOIN p ON p.own = l.key WHERE l.r <= 3 AND NOT EXISTS (SELECT 1 FROM l x WHERE x.user_id = l.user_id AND x.key = p.other) GROUP BY 1, 2),
r AS (SELECT *, least(0.5::DOUBLE, n / max(n) OVER (PARTITION BY user_id)::DOUBLE) AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, key) AS rank FROM g) SELECT user_id, key, n, round(confidence, 6) AS confidence, rank FROM r WHERE rank <= 5""")
def j21_predict_sequence(spark, d):
    key = F.get_json_object("props", "$.k").cast("long").alias("key")
    h = t.load(spark, d, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 5).alias("unit"), key)
    return reports.sequence_next(h, "user_id", "event_id", "unit", "key").withColumn("confidence", F.round("confidence", 6))


# --- message parts --------------------------------------------------------------------------------

_LOOK = [(n, " + ".join(f"CAST(contains(lower(content), '{w}') AS INTEGER)" for w in ws)) for n, ws in tx.LOOKUP_TASK]
_LNAMES = [n for n, _ in _LOOK]


@query("~ s AS (SELECT session_id, idx, " + ", ".join(f"{e} AS {n}" for n, e in _LOOK) + f" FROM messages) SELECT session_id, idx, CASE WHEN greatest({', '.join(_LNAMES)}) = 0 THEN 'simple_lookup' " + " ".join(f"WHEN {n} = greatest({', '.join(_LNAMES)}) THEN '{n}'" for n in _LNAMES) + " END AS task FROM s", "messages")
def j4_lookup_task(spark, d):
    return t.messages(spark, d).select("session_id", "idx", tx.lookup_task(F.col("content")).alias("task"))


@query("SELECT task, CASE task " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.REASONING.items()) + " ELSE 'chain-of-thought' END AS strategy, CASE task " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.TASK_MAP.items()) + " ELSE 'unknown' END AS mapped, count(*) AS n FROM (SELECT list_extract([" + ", ".join(f"'{k}'" for k in tx.REASONING) + ", 'odd'], CAST(event_id % 13 + 1 AS INTEGER)) AS task FROM events) GROUP BY 1")
def j7_reasoning_strategy(spark, d):
    x = t.load(spark, d, "events").select(F.element_at(F.array(*map(F.lit, [*tx.REASONING, "odd"])), (F.pmod("event_id", F.lit(13)) + 1).cast("int")).alias("task"))
    return x.groupBy("task").agg(F.count(F.lit(1)).alias("n")).select("task", tx.reasoning(F.col("task"), F.lit(0.4)).alias("strategy"), tx.mapped_task(F.col("task")).alias("mapped"), "n")


@query("SELECT session_id, idx, array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in tx.CONTEXT_WORDS) + "], lambda w: contains(lower(content), w)), ',') AS words FROM messages", "messages")
def i33_context_words(spark, d):
    return t.messages(spark, d).select("session_id", "idx", F.array_join(tx.context_words(F.col("content")), ",").alias("words"))


@query("SELECT session_id, idx, CASE WHEN n > 2 AND i > 0 AND i < n - 1 THEN '[Position ' || CAST(i + 1 AS VARCHAR) || '/' || CAST(n AS VARCHAR) || '] ' || content ELSE content END AS content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM messages)", "messages")
def i25_position_markers(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id")
    m = t.messages(spark, d).withColumn("i", F.row_number().over(w.orderBy("idx")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return m.select("session_id", "idx", tx.position_marker(F.col("content"), F.col("i"), F.col("n")).alias("content"))


@query("SELECT event_id, trim(concat_ws(' ', CASE WHEN event_id % 3 = 0 THEN 'fallback' ELSE event_type END, CASE WHEN event_id % 2 = 0 THEN 'stage' END, CASE WHEN event_type = 'error' THEN 'e' || CAST(event_id AS VARCHAR) END)) AS key FROM events")
def b12_status_key(spark, d):
    e = t.load(spark, d, "events")
    task = F.when(F.pmod("event_id", F.lit(3)) != 0, F.col("event_type"))
    errors = F.when(F.col("event_type") == "error", F.array(F.concat(F.lit("e"), F.col("event_id").cast("string"))))
    return e.select("event_id", tx.status_key(task, F.when(F.pmod("event_id", F.lit(2)) == 0, "stage"), errors, F.lit("fallback")).alias("key"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || ' work' ELSE 'General discussion' END AS theme FROM events")
def b9_legacy_theme(spark, d):
    e = t.load(spark, d, "events")
    k = F.pmod("event_id", F.lit(3))
    stored = F.when(k == 0, F.concat(F.lit('{"theme": "'), F.col("event_type"), F.lit('"}'))).when(k == 1, F.concat(F.lit("Working on: "), F.col("event_type"), F.lit(" work. Then more."))).otherwise("nothing of the kind")
    return e.select("event_id", tx.legacy_theme(stored).alias("theme"))


@query("SELECT session_id, idx < 1 AS opening, NOT bool_or(role = 'assistant') AS cold FROM messages GROUP BY 1, 2", "messages")
def b13_cold_start(spark, d):
    m = t.messages(spark, d)
    return m.groupBy("session_id", (F.col("idx") < 1).alias("opening")).agg((~F.bool_or(F.col("role") == "assistant")).alias("cold"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Array with 2 items' WHEN 1 THEN 'Object with fields: a, b' WHEN 2 THEN 'Object with 6 fields: a, b, c, d, e... and 1 more' ELSE 'Empty array' END AS summary FROM events")
def i28_json_summary(spark, d):
    samples = F.array(*map(F.lit, ("[1, 2]", '{"a": 1, "b": 2}', '{"a":1,"b":1,"c":1,"d":1,"e":1,"f":1}', "[]")))
    return t.load(spark, d, "events").select("event_id", tx.json_summary(F.element_at(samples, (F.pmod("event_id", F.lit(4)) + 1).cast("int"))).alias("summary"))


@query("SELECT session_id, '[Context] Use the following to answer:' || chr(10) || string_agg('- ' || kind || ' ' || CAST(id AS VARCHAR), chr(10) ORDER BY id) AS block FROM memories GROUP BY 1", "memories")
def j20_prompt_style(spark, d):
    m = t.memories(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", F.concat_ws(" ", "kind", F.col("id").cast("string")).alias("line")))).alias("l"))
    return m.select("session_id", tx.styled(F.transform("l", lambda r: r["line"]), tx.STYLE_OF_TASK["coding"]).alias("block"))


@query("SELECT event_id, CASE kind WHEN 'image' THEN 1 WHEN 'audio' THEN 2 WHEN 'video' THEN 3 WHEN 'text' THEN 4 ELSE 99 END AS modality, CASE kind WHEN 'text' THEN 0 WHEN 'image' THEN 1 ELSE 999 END AS preload FROM (SELECT event_id, list_extract(['text','video','image','other','audio'], CAST(event_id % 5 + 1 AS INTEGER)) AS kind FROM events)")
def d11_modality_rank(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("text", "video", "image", "other", "audio"))), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    x = t.load(spark, d, "events").select("event_id", kind.alias("kind"))
    return x.select("event_id", tx.modality_rank(F.col("kind")).cast("int").alias("modality"), tx.preload_rank(F.col("kind"), F.array(F.lit("text"), F.lit("image"))).cast("int").alias("preload"))


@query(None)
def c1_bpe_tokens(spark, d):
    m = t.messages(spark, d)
    return m.select("session_id", "idx", bpe.counter(spark)(F.col("content")).alias("tokens"))


@query(f"~ x AS (SELECT session_id, max(idx) AS m FROM messages GROUP BY 1), a AS (SELECT messages.session_id, idx, content, CASE WHEN idx = m THEN 1 ELSE 0 END AS last FROM messages JOIN x USING (session_id)), w AS (SELECT session_id, idx, last, list_distinct(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9_./-]+'), lambda s: length(s) >= 6)) AS w FROM a) SELECT a.session_id, a.idx, len(list_intersect(a.w, b.w)) >= 3 AS overlaps FROM w a JOIN w b ON a.session_id = b.session_id AND b.last = 1", "messages")
def i32_recovery_overlap(spark, d):
    m = t.messages(spark, d)
    last = m.groupBy("session_id").agg(F.max_by("content", "idx").alias("summary"))
    return m.join(last, "session_id").select("session_id", "idx", tx.recovery_overlap(F.col("content"), F.col("summary")).alias("overlaps"))
