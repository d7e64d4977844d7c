"""Queries of session blocks, levels of history and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import budget as bg
from ..operators import blocks, graph, models, resume, signals
from ..sources import files
from ..sources import tables as t
from .queries import _MEN, NOW, _mentions, query


@query(None)
def i11_pattern_sentences(spark, d):
    m = t.messages(spark, d)
    return m.select("session_id", "idx", F.array_join(blocks.task_sentences(F.col("content")), "|").alias("tasks"), F.array_join(blocks.point_sentences(F.col("content")), "|").alias("points"))


@query(None)
def i22_three_sections(spark, d):
    return blocks.three_sections(t.messages(spark, d), ["session_id"])


@query("""~ x AS (SELECT *, strftime(make_timestamp_ms(ts), '%Y-%m') AS month FROM summaries),
w AS (SELECT session_id, month, word, count(*) AS n FROM (SELECT session_id, month, unnest(string_split(theme, ' ')) AS word FROM x) GROUP BY 1, 2, 3),
wr AS (SELECT *, row_number() OVER (PARTITION BY session_id, month ORDER BY n DESC, word) AS r FROM w),
wt AS (SELECT session_id, month, string_agg(word, ', ' ORDER BY r) AS theme FROM wr WHERE r <= 3 GROUP BY 1, 2),
e AS (SELECT session_id, month, entity, count(*) AS n FROM (SELECT session_id, month, unnest(entities) AS entity FROM x) GROUP BY 1, 2, 3),
er AS (SELECT *, row_number() OVER (PARTITION BY session_id, month ORDER BY n DESC, entity) AS r FROM e),
et AS (SELECT session_id, month, string_agg(entity, ', ' ORDER BY r) AS entities FROM er WHERE r <= 15 GROUP BY 1, 2)
SELECT g.session_id, g.month, g.ts, g.n_messages, theme, entities FROM (SELECT session_id, month, min(ts) AS ts, CAST(sum(n_messages) AS BIGINT) AS n_messages FROM x GROUP BY 1, 2) g LEFT JOIN wt USING (session_id, month) LEFT JOIN et USING (session_id, month)""", "summaries")
def f9_monthly_merge(spark, d):
    return blocks.monthly_merge(t.summaries(spark, d), ["session_id"])


@query(f"~ {_MEN} SELECT entity, count(DISTINCT session_id) AS sessions, count(*) AS mentions, max(idx) AS last_idx FROM m GROUP BY 1", "summaries")
def f13_graph_nodes(spark, d):
    return blocks.graph_nodes(_mentions(spark, d))


@query(f"~ {_MEN}, p AS (SELECT DISTINCT a.entity AS a, b.entity AS b FROM m a JOIN m b ON a.session_id = b.session_id AND a.idx = b.idx AND a.entity < b.entity) SELECT count(DISTINCT entity) AS entities, count(DISTINCT session_id) AS sessions, count(*) AS mentions, (SELECT count(*) FROM p) AS pairs FROM m", "summaries")
def f14_tracker_stats(spark, d):
    m = _mentions(spark, d)
    return blocks.tracker_stats(m, graph.cooccurrence(m, ["session_id", "idx"]))


@query("SELECT event_id, event_type AS cause, CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'purchase' ELSE 'error' END AS effect, 0.8::DOUBLE AS confidence FROM events WHERE event_type = 'click' OR event_type = 'view'")
def e6_causality(spark, d):
    k = F.col("event_type")
    links = t.load(spark, d, "events").select("event_id", k.alias("cause"), F.when(k == "view", "click").when(k == "click", "purchase").otherwise("error").alias("effect"), F.lit(0.8).alias("confidence"))
    return blocks.causality(links, "click")


@query("SELECT session_id, id, rank FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rank FROM signals WHERE source = 'deploy') WHERE rank <= 5", "signals")
def d10_experience_topk(spark, d):
    from ..operators import select

    x = t.signals(spark, d).filter("source = 'deploy'").select("session_id", "id")
    return select.top_k(x, ["session_id"], [F.col("id")], 5)


@query("SELECT doc_id, array_to_string(list_filter(l, lambda x, i: (i - 1) % 4 = 0), ' ') AS kept FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS l FROM documents)")
def d15_uniform_subsample(spark, d):
    from ..operators import select

    x = t.load(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("l"))
    return x.select("doc_id", F.array_join(select.uniform_subsample(F.col("l"), 0.25), " ").alias("kept"))


@query("SELECT id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY \"at\" DESC, id DESC) AS r FROM signals) WHERE r <= 20", "signals")
def a13_snapshot_store(spark, d):
    return files.keep_last(t.signals(spark, d), most=20).select("id", "session_id")


@query(None)
def k5_history_levels(spark, d):
    return blocks.hierarchy(t.summaries(spark, d), ["session_id"], NOW)


@query("SELECT session_id, string_agg(strftime(make_timestamp_ms(ts), '%Y-%m-%d') || ' ' || theme, chr(10) ORDER BY r) AS block FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS r FROM summaries) WHERE r <= 5 GROUP BY 1", "summaries")
def k6_timeline_block(spark, d):
    return blocks.templated(t.summaries(spark, d), ["session_id"], "chronological", "timeline")


@query("SELECT session_id, string_agg('* ' || array_to_string(entities, ', ') || ': ' || theme, chr(10) ORDER BY r) AS block FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n_messages DESC, ts DESC, event_id) AS r FROM summaries) WHERE r <= 5 GROUP BY 1", "summaries")
def k6_facts_block(spark, d):
    return blocks.templated(t.summaries(spark, d), ["session_id"], "relevance", "facts")


@query("SELECT session_id, 'Last: ' || CASE WHEN length(theme) <= 20 THEN theme ELSE substr(theme, 1, 17) || '...' END || ' | Next: ' || tasks[1] AS recap FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id) AS r FROM summaries) WHERE r = 1", "summaries")
def k7_recap(spark, d):
    x = resume.latest_per_session(t.summaries(spark, d))
    return x.select("session_id", blocks.recap(F.col("theme"), F.get("tasks", F.lit(0)), most=20).alias("recap"))


@query("SELECT session_id, '[Governance Signals]' || chr(10) || string_agg('  ' || content || ' (' || CAST(CAST(round(conf * 100) AS BIGINT) AS VARCHAR) || '%)', chr(10) ORDER BY id) AS block FROM signals WHERE source = 'governance' GROUP BY 1", "signals")
def k10_signal_block(spark, d):
    x = t.signals(spark, d).filter("source = 'governance'")
    line = F.concat(F.lit("  "), F.col("content"), F.lit(" ("), F.round(F.col("conf") * 100).cast("long").cast("string"), F.lit("%)"))
    return blocks.signal_block(x, ["session_id"], "Governance Signals", line, ["id"])


@query(None)
def k16_resume_block(spark, d):
    h = resume.history_block(t.summaries(spark, d), ["session_id"], NOW, max_age_hours=240)
    return h.select("session_id", blocks.resume_block(F.col("session_id"), F.col("block")).alias("block"))


@query("""~ q AS (SELECT session_id, 1 - count(*) FILTER (WHERE event_id % 8 = 0) / count(*)::DOUBLE AS red, avg(CASE WHEN ts > 1706659200000 THEN 1.0::DOUBLE ELSE exp(-((1706659200000 - ts) / 3600000.0::DOUBLE) / 240.0::DOUBLE) END) AS fresh FROM summaries GROUP BY 1)
SELECT session_id, round(0.4::DOUBLE * 1.0 + 0.35::DOUBLE * red + 0.25::DOUBLE * fresh, 6) AS score, CASE WHEN round(0.4::DOUBLE * 1.0 + 0.35::DOUBLE * red + 0.25::DOUBLE * fresh, 6) >= 0.7 THEN 'good' WHEN round(0.4::DOUBLE * 1.0 + 0.35::DOUBLE * red + 0.25::DOUBLE * fresh, 6) >= 0.4 THEN 'acceptable' ELSE 'poor' END AS grade FROM q""", "summaries")
def j14_context_quality(spark, d):
    s = t.summaries(spark, d)
    red = s.groupBy("session_id").agg((1 - F.count_if(F.col("event_id") % 8 == 0) / F.count(F.lit(1))).alias("red"))
    x = red.join(resume.freshness(s, ["session_id"], NOW, hours=240.0, digits=None), "session_id")
    return x.select("session_id", resume.context_quality(F.lit(1.0), F.col("red"), F.col("freshness")).alias("q")).select("session_id", "q.score", "q.grade")


@query("SELECT session_id, array_to_string(list_filter(['src/app.ts', 'docker', theme, 'a/' || theme], lambda x: x <> theme), '|') AS items FROM (SELECT session_id, min(theme) AS theme FROM summaries GROUP BY 1)", "summaries")
def h2_open_items(spark, d):
    s = t.summaries(spark, d).groupBy("session_id").agg(F.min("theme").alias("theme"))
    items = resume.open_items(F.array(F.lit("src/app.ts"), F.lit("docker")), F.array(F.col("theme"), F.concat(F.lit("a/"), F.col("theme"))))
    return s.select("session_id", F.array_join(items, "|").alias("items"))


@query("SELECT event_id, CASE WHEN r >= 0.7 THEN 'compact_and_refresh' WHEN r >= 0.5 THEN 'refresh_context' WHEN r >= 0.3 THEN 'monitor' ELSE 'none' END AS action, CASE WHEN r >= 0.7 THEN 'high' WHEN r >= 0.5 THEN 'medium' WHEN r >= 0.3 THEN 'low' ELSE 'stable' END AS level, 10 * CASE WHEN event_id % 3 <= 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 3 END AS k FROM (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS r FROM events)")
def g7_suggested_actions(spark, d):
    from ..operators import drift

    r = F.pmod("event_id", F.lit(11)) / 10.0
    return t.load(spark, d, "events").select("event_id", drift.suggested_action(r).alias("action"), bg.drift_level(r).alias("level"), resume.expansion_k(F.lit(10), F.pmod("event_id", F.lit(3))).alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'window differs from profile|no reserve' WHEN event_id % 2 = 0 THEN 'window differs from profile' WHEN event_id % 3 = 0 THEN 'no reserve' ELSE '' END AS warnings FROM events")
def j23_window_warnings(spark, d):
    w = models.window_warnings(F.when(F.pmod("event_id", F.lit(2)) == 0, 1).otherwise(2), F.lit(2), F.pmod("event_id", F.lit(3)))
    return t.load(spark, d, "events").select("event_id", F.array_join(w, "|").alias("warnings"))


@query("""~ x AS (SELECT source, count(*) AS n FROM signals GROUP BY 1) SELECT source, n, floor(n * 10000 / CAST(sum(n) OVER () AS DOUBLE) + 0.5) / 100 AS share_pct FROM x""", "signals")
def f18_source_listing(spark, d):
    from ..operators import ledger

    return ledger.share_of(t.signals(spark, d), "source")


@query("SELECT id, score FROM memories WHERE score >= 0.3", "memories")
def b2_legacy_filter(spark, d):
    from ..operators import gate

    return gate.legacy_filter(t.memories(spark, d).select("id", "score"))


@query("SELECT session_id, arg_max(content, idx) AS digest, max(idx) AS idx FROM (SELECT session_id, idx, CASE WHEN idx % 3 = 1 THEN '[Structural Digest v2] ' || CAST(idx AS VARCHAR) ELSE role END AS content FROM messages) WHERE starts_with(content, '[Structural Digest') GROUP BY 1", "messages")
def b8_newest_digest(spark, d):
    from ..operators import digest

    m = t.messages(spark, d).select("session_id", "idx", F.when(F.col("idx") % 3 == 1, F.concat(F.lit("[Structural Digest v2] "), F.col("idx").cast("string"))).otherwise(F.col("role")).alias("content"))
    return digest.newest_digest(m, ["session_id"])[0]


@query("SELECT event_id, greatest(0, 1000 - u) AS remaining, u + 300 <= 1000 AS fits, u >= 800 AS compress, u / 1000.0::DOUBLE AS ratio FROM (SELECT event_id, event_id * 37 % 1300 AS u FROM events)")
def c10_budget_checks(spark, d):
    u = F.pmod(F.col("event_id") * 37, F.lit(1300))
    x = t.load(spark, d, "events")
    return x.select("event_id", bg.remaining(F.lit(1000), u).alias("remaining"), bg.can_fit(F.lit(1000), u, F.lit(300)).alias("fits"), bg.should_compress(u, F.lit(800)).alias("compress"), bg.usage_ratio(u, F.lit(1000)).alias("ratio"))


@query("""WITH f AS (SELECT event_type AS task, user_id AS key, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT task, key, round(n / CAST(sum(n) OVER (PARTITION BY task) AS DOUBLE), 9) AS confidence, 0 AS s FROM f),
b AS (SELECT DISTINCT event_type AS task, user_id AS key, 0.01::DOUBLE AS confidence, 1 AS s FROM events WHERE user_id % 3 = 0), c AS (SELECT * FROM a WHERE key % 2 = 0 UNION ALL SELECT * FROM b),
g AS (SELECT task, key, arg_min(confidence, s) AS confidence, min(s) AS source FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY confidence DESC, key) AS rank FROM g) SELECT task, key, confidence, source, rank FROM r WHERE rank <= 10""")
def h1_union_predictions(spark, d):
    from pyspark.sql import Window

    e = t.load(spark, d, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("key"))
    f = e.groupBy("task", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("confidence", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("task")), 9)).filter("key % 2 = 0")
    b = e.filter("key % 3 = 0").distinct().withColumn("confidence", F.lit(0.01))
    return graph.union_predictions([f, b], ["task"])


@query("~ g AS (SELECT trigger, session_id AS key, max(\"at\") AS \"at\" FROM ledger WHERE \"at\" <= 1706000000000 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trigger ORDER BY \"at\" DESC, key) AS rank FROM g WHERE \"at\" > 1706000000000 - 86400000) SELECT trigger, key, \"at\", rank FROM r WHERE rank <= 32", "ledger")
def l4_cache_entries(spark, d):
    from ..operators import caches

    x = t.ledger(spark, d).select("trigger", F.col("session_id").alias("key"), "at")
    return caches.alive(x, ["trigger"], 1706000000000, 86_400_000, 32)


@query(None)
def k15_bootstrap(spark, d):
    s = t.summaries(spark, d)
    c = resume.checkpoint_record(s, ["session_id"], [F.desc("ts"), F.col("event_id")])
    return blocks.bootstrap(s, c, resume.history_block(s, ["session_id"], NOW, max_age_hours=96), ["session_id"])


@query("SELECT user_id AS session_id, 'card ' || CAST(user_id % 5 AS VARCHAR) AS block FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 < 3")
def k11_error_cards(spark, d):
    cards = spark.createDataFrame([(f"k{i}", f"card {i}", 0) for i in range(3)], "key string, card string, seq int")
    keys = t.load(spark, d, "events").select(F.col("user_id").alias("session_id")).distinct().withColumn("key", F.concat(F.lit("k"), F.pmod("session_id", F.lit(5)).cast("string")))
    return blocks.error_cards(cards, keys, ["session_id"])
