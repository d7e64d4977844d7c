"""Queries of the context engine over the driver's tables, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import budget as bg
from ..functions import text as tx
from ..operators import digest, drift, gate, graph, ledger, models, quality, resume, select, signals
from ..sources import tables as t
from ..sources.tables import with_tables
from . import assemble

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Processing time of the age windows, in ms: 2024-01-31.
NOW = 1_706_659_200_000


def query(sql: str | None = None, *tables: str):
    """Register a query by its function's name, with its SQL over the named derived tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return add


def _any(col: str, patterns) -> str:
    """RE2 alternative of ``text.any_of``."""
    one = lambda p: f"regexp_matches({col}, '{p.replace(chr(39), chr(39) * 2)}')"
    return "(" + " OR ".join(map(one, patterns)) + ")"


def _has(col: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w.lower()}')" for w in words) + ")"


TOKENS = "CASE WHEN length({0}) = 0 THEN 0 ELSE CAST(greatest(1, ceil(((length({0}) - length(regexp_replace({0}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{f900}}-\\x{{faff}}]', '', 'g'))) * 1.5::DOUBLE + length(regexp_replace({0}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{f900}}-\\x{{faff}}]', '', 'g')) * 0.25::DOUBLE) * 1.1::DOUBLE)) AS BIGINT) END"
TOK = TOKENS.format("content")


# --- C: token counts and budgets ------------------------------------------------------------------


@query(f"SELECT session_id, idx, {TOK} AS tokens, CAST(ceil(length(content) / 4.0::DOUBLE) AS BIGINT) AS rough, CAST(ceil((length(content) - length(regexp_replace(content, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]', '', 'g'))) + (length(content) - (length(content) - length(regexp_replace(content, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]', '', 'g')))) / 3.5::DOUBLE) AS BIGINT) AS signal FROM messages", "messages")
def c2_token_estimate(spark, d):
    m = t.messages(spark, d)
    return m.select("session_id", "idx", tx.heuristic_tokens(F.col("content")).alias("tokens"), tx.rough_tokens(F.col("content")).alias("rough"), tx.signal_tokens(F.col("content")).alias("signal"))


@query(f"SELECT role, CAST(sum({TOK}) AS BIGINT) AS total, count(*) AS n, CAST(floor(sum({TOK}) / count(*)::DOUBLE + 0.5) AS BIGINT) AS mean FROM messages GROUP BY role", "messages")
def c8_token_stats(spark, d):
    m = t.messages(spark, d).withColumn("k", tx.heuristic_tokens(F.col("content")))
    return m.groupBy("role").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"), F.floor(F.sum("k") / F.count(F.lit(1)) + 0.5).alias("mean"))


@query(f"""~ s AS (SELECT session_id, CAST(sum({TOK}) AS BIGINT) AS used FROM messages GROUP BY 1)
SELECT session_id, used, CAST(80 AS BIGINT) AS reserve, greatest(0, 1000 - used - 80) AS remaining, used / 1000.0::DOUBLE AS utilization FROM s""", "messages")
def c7_token_budget(spark, d):
    g = t.messages(spark, d).groupBy("session_id").agg(F.sum(tx.heuristic_tokens(F.col("content"))).alias("used"))
    return g.select("session_id", "used", bg.token_budget(F.lit(1000), F.col("used")).alias("b")).select("session_id", "used", "b.reserve", "b.remaining", "b.utilization")


@query("""WITH x AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice / 10) AS BIGINT) AS total FROM orders),
a AS (SELECT *, CAST(floor(total * 60 / 100.0::DOUBLE) AS BIGINT) AS b0, CAST(floor(total * 10 / 100.0::DOUBLE) AS BIGINT) AS p, CAST(floor(total * 20 / 100.0::DOUBLE) AS BIGINT) AS q FROM x),
c AS (SELECT k, total, CASE WHEN b0 < 1000 AND total >= 1000 THEN 1000 ELSE b0 END AS base, least(2000, CASE WHEN b0 < 1000 AND total >= 1000 THEN least(2000, total - 1000 - p - q) ELSE p END) AS "cross", least(2000, p) AS ci FROM a)
SELECT k, total, base, "cross", ci, total - base - "cross" - ci AS buffer FROM c""")
def c9_static_split(spark, d):
    x = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") / 10).alias("total"))
    return x.select("k", "total", bg.static_split(F.col("total")).alias("s")).select("k", "total", "s.base", "s.cross", "s.ci", "s.buffer")


_PROFILE = lambda i: "CASE task " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in bg.PROFILES.items()) + " END"


@query(f"""WITH x AS (SELECT doc_id, list_extract(['coding','reasoning','writing','conversation','unknown'], CAST(doc_id % 5 + 1 AS INTEGER)) AS task, (doc_id % 101) / 100.0::DOUBLE AS q FROM documents),
a AS (SELECT *, CASE WHEN 0.5 - q > 0 THEN least(15.0::DOUBLE, (0.5::DOUBLE - q) * 20) ELSE -least(10.0::DOUBLE, (q - 0.5::DOUBLE) * 10) END AS shift, {_PROFILE(0)} AS b, {_PROFILE(1)} AS c, {_PROFILE(2)} AS i FROM x),
s AS (SELECT *, floor(greatest(10.0::DOUBLE, least(80.0::DOUBLE, b - shift)) + 0.5) AS base FROM a)
SELECT doc_id, task, round(shift, 6) AS shift, CAST(base AS BIGINT) AS base, CAST(greatest(5, least(40, 100 - base - c - i)) AS DOUBLE) AS buffer FROM s""")
def c12_quality_shift(spark, d):
    x = t.load(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, bg.PROFILES)), (F.pmod("doc_id", F.lit(5)) + 1).cast("int")).alias("task"), (F.pmod("doc_id", F.lit(101)) / 100.0).alias("q"))
    p = [bg.lookup(F.col("task"), {k: v[i] for k, v in bg.PROFILES.items()}, 0) for i in range(4)]
    x = x.withColumn("shift", bg.quality_adjustment(F.col("q"))).withColumn("s", bg.budget_shift(p[0], p[3], p[1], p[2], F.col("shift")))
    return x.select("doc_id", "task", F.round("shift", 6).alias("shift"), F.col("s.base").cast("long").alias("base"), F.col("s.buffer").cast("double").alias("buffer"))


@query("""WITH x AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS total, list_extract(['static-prefix','dynamic-load','hybrid'], CAST(o_orderkey % 3 + 1 AS INTEGER)) AS strategy FROM orders),
a AS (SELECT *, CAST(floor(total * 0.9::DOUBLE) AS BIGINT) AS effective, CASE strategy WHEN 'static-prefix' THEN 0.4::DOUBLE WHEN 'dynamic-load' THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS r, CASE strategy WHEN 'static-prefix' THEN 20 WHEN 'dynamic-load' THEN 10 ELSE 15 END AS n FROM x),
s AS (SELECT *, CAST(floor(effective * r) AS BIGINT) AS stable FROM a)
SELECT k, strategy, effective, stable, CAST(least(floor(stable / 2.0::DOUBLE), n * 500) AS BIGINT) AS preload, effective - stable AS dynamic, total - effective AS reserve FROM s""")
def c16_model_split(spark, d):
    x = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("total"), F.element_at(F.array(*map(F.lit, bg.STRATEGIES)), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int")).alias("strategy"))
    return x.select("k", "strategy", bg.model_split(F.col("total"), F.col("strategy")).alias("s")).select("k", "strategy", "s.effective", "s.stable", F.col("s.preload").cast("long").alias("preload"), "s.dynamic", "s.reserve")


@query(f"""~ s AS (SELECT session_id, list_extract(['simple_lookup','multi_lookup','summarization','complex_reasoning'], CAST(session_id % 4 + 1 AS INTEGER)) AS task, CAST(sum({TOK}) AS BIGINT) * 5 AS tokens FROM messages GROUP BY 1, 2),
l AS (SELECT *, CASE task WHEN 'simple_lookup' THEN 10000 WHEN 'multi_lookup' THEN 5000 WHEN 'summarization' THEN 3000 ELSE 2000 END AS most FROM s)
SELECT session_id, task, tokens, tokens <= most AS within, round(tokens / most::DOUBLE, 6) AS ratio, tokens / most::DOUBLE >= 0.8 AS warning, CASE WHEN tokens > 2500 THEN floor(3000 * 0.7::DOUBLE) / tokens WHEN tokens > 2500 * 0.85::DOUBLE THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS target FROM l""", "messages")
def c18_context_check(spark, d):
    tasks = F.array(*map(F.lit, bg.TASK_LIMITS))
    g = t.messages(spark, d).groupBy("session_id").agg((F.sum(tx.heuristic_tokens(F.col("content"))) * 5).alias("tokens"))
    g = g.withColumn("task", F.element_at(tasks, (F.pmod("session_id", F.lit(4)) + 1).cast("int"))).withColumn("c", bg.context_check(F.col("task"), F.col("tokens")))
    return g.select("session_id", "task", "tokens", "c.within", F.round("c.ratio", 6).alias("ratio"), "c.warning", bg.compression_target(F.col("tokens"), F.lit(2500), F.lit(3000)).alias("target"))


_MODELS = "models(pos, id, name, provider, max_tokens, ratio, strategy, threshold) AS (VALUES " + ", ".join(f"({i}, '{r[0]}', '{r[1]}', '{r[2]}', {r[3]}::BIGINT, {r[4]}::DOUBLE, '{r[5]}', {r[6]}::BIGINT)" for i, r in enumerate(models.PROFILES)) + ")"
_ASKED = ("o1", "GPT-5", "claude", "deepseek v3", "nothing here", "GLM", "qwen-3.5", "gemini")


@query(f"""WITH {_MODELS}, tasks(task, f) AS (VALUES ('simple_lookup', 1.0::DOUBLE), ('multi_lookup', 0.8::DOUBLE), ('summarization', 0.7::DOUBLE), ('complex_reasoning', 0.6::DOUBLE))
SELECT id, task, CAST(floor(max_tokens * ratio * f) AS BIGINT) AS mecw FROM models, tasks""")
def c17_mecw(spark, d):
    tasks = spark.createDataFrame([(k,) for k in bg.COMPLEXITY_FACTORS], "task string")
    return models.profiles(spark).join(F.broadcast(tasks), F.lit(True)).select("id", "task", bg.mecw(F.col("max_tokens"), F.col("ratio"), F.col("task")).alias("mecw"))


@query(f"""WITH {_MODELS}, asked(asked) AS (VALUES {", ".join(f"('{a}')" for a in _ASKED)}),
m AS (SELECT asked, models.*, CASE WHEN id = asked THEN 0 WHEN lower(id) = lower(asked) OR lower(name) = lower(asked) THEN 1 WHEN contains(lower(id), lower(asked)) OR contains(lower(name), lower(asked)) THEN 2 END AS tier FROM asked, models),
b AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY tier, pos) AS r FROM m WHERE tier IS NOT NULL)
SELECT a.asked, b.id, b.tier, coalesce(b.max_tokens, 128000) AS max_tokens, coalesce(b.strategy, 'hybrid') AS strategy, coalesce(b.threshold, 96000) AS threshold FROM asked a LEFT JOIN b ON a.asked = b.asked AND b.r = 1""")
def e9_resolve_model(spark, d):
    asked = spark.createDataFrame([(a,) for a in _ASKED], "asked string")
    return models.hint(models.resolve(asked, models.profiles(spark))).select("asked", "id", "tier", "max_tokens", "strategy", "threshold")


@query(f"WITH {_MODELS} SELECT id, max_tokens, CAST(floor(max_tokens * ratio) AS BIGINT) AS effective, threshold, CAST(floor(max_tokens * 0.75::DOUBLE) AS BIGINT) AS auto_trigger FROM models")
def k14_model_config(spark, d):
    return models.export_config(models.profiles(spark))


@query(f"WITH {_MODELS}, g AS (SELECT provider, count(*) AS n FROM models GROUP BY 1) SELECT provider, n, floor(n * 10000 / CAST(sum(n) OVER () AS DOUBLE) + 0.5) / 100 AS share_pct FROM g")
def f18_providers(spark, d):
    return ledger.share_of(models.profiles(spark), "provider")


# --- D: selection ---------------------------------------------------------------------------------


@query(f"""~ x AS (SELECT session_id, idx, {TOK} AS tokens, (idx * 37 % 10) / 10.0::DOUBLE AS score FROM messages),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY score DESC, idx ROWS UNBOUNDED PRECEDING) AS running FROM x)
SELECT session_id, idx, CAST(running AS BIGINT) AS running FROM r WHERE running <= 300""", "messages")
def d1_budget_prefix(spark, d):
    m = t.messages(spark, d).select("session_id", "idx", tx.heuristic_tokens(F.col("content")).alias("tokens"), (F.pmod(F.col("idx") * 37, F.lit(10)) / 10.0).alias("score"))
    return select.budget_prefix(m, ["session_id"], "score", "tokens", "idx", F.lit(300)).select("session_id", "idx", "running")


@query(f"""WITH RECURSIVE {t.SQL["messages"]}, x AS (SELECT session_id, idx, {TOK} AS tokens, (idx * 37 % 10) / 10.0::DOUBLE AS score, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) <= 2 AS fresh FROM messages),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, idx) AS r FROM x WHERE NOT fresh),
u AS (SELECT session_id, CAST(sum(tokens) AS BIGINT) AS used FROM x WHERE fresh GROUP BY 1),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS idx, false AS kept, used FROM u
 UNION ALL SELECT f.session_id, o.r, o.idx, f.used + o.tokens <= 300, CASE WHEN f.used + o.tokens <= 300 THEN f.used + o.tokens ELSE f.used END FROM f JOIN o ON o.session_id = f.session_id AND o.r = f.r + 1)
SELECT session_id, idx, kept FROM f WHERE r > 0 UNION ALL SELECT session_id, idx, true FROM x WHERE fresh""")
def d2_greedy_fill(spark, d):
    m = t.messages(spark, d).select("session_id", "idx", tx.heuristic_tokens(F.col("content")).alias("tokens"), (F.pmod(F.col("idx") * 37, F.lit(10)) / 10.0).alias("score"))
    return select.greedy_fill(m, ["session_id"], "idx", "score", "tokens", 300, min_keep=2).select("session_id", "idx", "kept")


@query(f"""~ x AS (SELECT session_id, idx, {TOK} AS tokens FROM messages),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY idx DESC ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS pos FROM x),
g AS (SELECT session_id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS total, max(CASE WHEN run > 200 THEN pos END) AS over FROM r GROUP BY 1)
SELECT session_id, n, total, CASE WHEN over IS NULL THEN 0 ELSE least(n, greatest(2, over + 1)) END AS keep_from FROM g""", "messages")
def d3_suffix_keep(spark, d):
    m = t.messages(spark, d).select("session_id", "idx", tx.heuristic_tokens(F.col("content")).alias("tokens"))
    return select.suffix_keep(m, ["session_id"], "idx", "tokens", 200, least=2)


@query("""~ r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, id) AS rank FROM memories)
SELECT session_id, id, score, rank FROM r WHERE rank <= CASE WHEN session_id % 2 = 0 THEN 12 ELSE 6 END""", "memories")
def d7_topk_recall(spark, d):
    k = F.when(F.pmod("session_id", F.lit(2)) == 0, 12).otherwise(6)
    return select.top_k(t.memories(spark, d).select("session_id", "id", "score"), ["session_id"], [F.desc("score"), F.col("id")], k)


@query("""~ r AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN content LIKE 'error%' THEN 0 ELSE 1 END, \"at\" DESC, id) AS rank FROM signals)
SELECT session_id, id, rank FROM r WHERE rank <= 5""", "signals")
def d8_ci_order(spark, d):
    return signals.ci_first(t.signals(spark, d).select("session_id", "id", "content", "at"), ["session_id"], F.col("content").startswith("error")).select("session_id", "id", "rank")


@query(f"""~ r AS (SELECT session_id, id, conf, row_number() OVER (PARTITION BY session_id ORDER BY conf DESC, id) AS rank FROM signals WHERE lower(source) <> 'governance' AND "at" >= {NOW} - 96 * 3600000 AND "at" <= {NOW})
SELECT session_id, id, conf, rank FROM r WHERE rank <= 3""", "signals")
def d9_cross_domain_topk(spark, d):
    return signals.cross_domain(t.signals(spark, d), ["session_id"], "governance", NOW, hours=96).select("session_id", "id", "conf", "rank")


@query("""~ x AS (SELECT session_id, idx, (idx * 13 % 7) / 7.0::DOUBLE AS imp, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY (idx * 13 % 7) / 7.0::DOUBLE DESC, idx) AS r FROM messages),
k AS (SELECT *, r <= 3 AND imp > 0.1 AND n > 3 AS key FROM x),
s AS (SELECT *, CASE WHEN NOT key THEN 1 WHEN row_number() OVER (PARTITION BY session_id, key ORDER BY idx) <= 2 THEN 0 ELSE 2 END AS section FROM k)
SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY section, idx) - 1 AS place FROM s""", "messages")
def d13_head_tail(spark, d):
    m = t.messages(spark, d).select("session_id", "idx", (F.pmod(F.col("idx") * 13, F.lit(7)) / 7.0).alias("imp"))
    return select.reorder_balanced(m, ["session_id"], "idx", "imp").select("session_id", "idx", F.col("place").cast("long").alias("place"))


@query("""~ x AS (SELECT session_id, idx, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS i FROM messages)
SELECT session_id, idx FROM x WHERE n <= 5 OR i = 0 OR i >= n - 3 OR (i - 1) % greatest(1, CAST(ceil((n - 4) / 1.0) AS BIGINT)) = 0""", "messages")
def d14_sliding_subsample(spark, d):
    return select.sliding_subsample(t.messages(spark, d).select("session_id", "idx"), ["session_id"], "idx", 5)


@query(f"""~ x AS (SELECT session_id, idx, {TOK} AS tokens, idx % 3 AS tier FROM messages),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY tier DESC, idx DESC ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT session_id, idx FROM r WHERE run <= 250""", "messages")
def d16_capacity_cut(spark, d):
    m = t.messages(spark, d).select("session_id", "idx", tx.heuristic_tokens(F.col("content")).alias("tokens"), F.pmod("idx", F.lit(3)).alias("tier"))
    return select.capacity_cut(m, ["session_id"], "tokens", ["tier", "idx"], 250).select("session_id", "idx")


# --- B: gate --------------------------------------------------------------------------------------

_THRESH = "coalesce(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE - greatest(0.0::DOUBLE, 0.5::DOUBLE - {m}) * 0.3::DOUBLE + least(0.1::DOUBLE * {s}, 0.05::DOUBLE))) * 100 + 0.5) / 100, 0.5)"


@query(f"""~ g AS (SELECT *, {_THRESH.format(m="avg(score) OVER (PARTITION BY session_id)", s="stddev_pop(score) OVER (PARTITION BY session_id)")} AS threshold FROM memories),
o AS (SELECT *, score >= threshold AS ok FROM g),
r AS (SELECT *, count_if(ok) OVER (PARTITION BY session_id) AS passed, row_number() OVER (PARTITION BY session_id, ok ORDER BY score DESC, id) AS rk FROM o)
SELECT session_id, id, score, threshold FROM r WHERE ok OR rk <= 3 - passed""", "memories")
def b3_confidence_gate(spark, d):
    m = t.memories(spark, d).select("session_id", "id", "score")
    return gate.gate(m, ["session_id"], "score", "id", least=3)


@query(f"""~ g AS (SELECT session_id, count(*) AS total, avg(score) AS m, {_THRESH.format(m="avg(score)", s="stddev_pop(score)")} AS threshold, count_if(score_missing) AS missing, list(score) AS l FROM memories GROUP BY 1)
SELECT session_id, total, len(list_filter(l, lambda s: s >= threshold)) AS passed, round(m, 6) AS mean, threshold, missing, total - len(list_filter(l, lambda s: s >= threshold)) AS dropped FROM g""", "memories")
def b5_gate_report(spark, d):
    return gate.report(t.memories(spark, d), ["session_id"], "score", "score_missing")


@query("SELECT event_id, regexp_replace(regexp_replace(x, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z?', '[timestamp]', 'g'), '\\bmsg-\\d+\\b', '[msg]', 'g') AS clean, rpad(substr(CAST(user_id AS VARCHAR), 1, 8), 8, '0') AS hash FROM (SELECT event_id, user_id, event_type || ' at 2024-01-02T03:04:05Z in msg-' || CAST(event_id AS VARCHAR) AS x FROM events)")
def b10_sanitize(spark, d):
    e = t.load(spark, d, "events")
    x = F.concat("event_type", F.lit(" at 2024-01-02T03:04:05Z in msg-"), F.col("event_id").cast("string"))
    return e.select("event_id", tx.sanitize(x).alias("clean"), tx.session_hash(F.col("user_id")).alias("hash"))


# --- F, E: ledgers --------------------------------------------------------------------------------

_COST = "count(*) AS events, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(greatest(0, coalesce(sum(input_tokens) - sum(output_tokens), 0)) AS BIGINT) AS saved, round(avg(share), 4) AS avg_share, coalesce(min(\"at\"), 0) AS first_at, coalesce(max(\"at\"), 0) AS last_at, array_to_string(list_sort(list_distinct(list(version))), ',') AS versions"


@query(f"SELECT {_COST} FROM ledger", "ledger")
def f1_cost_summary(spark, d):
    return ledger.cost_summary(t.ledger(spark, d))


@query(f"SELECT trigger, {_COST} FROM ledger WHERE \"at\" >= 1704500000000 AND version = 'v1' GROUP BY trigger", "ledger")
def f1_cost_by_trigger(spark, d):
    return ledger.cost_summary(t.ledger(spark, d), by=["trigger"], since=1704500000000, version="v1")


@query("""~ a AS (SELECT count(*) AS events, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, round(avg(share), 4) AS avg_share FROM ledger WHERE \"at\" <= 1705300000000),
b AS (SELECT count(*) AS events, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, round(avg(share), 4) AS avg_share FROM ledger WHERE "at" >= 1705300000001)
SELECT a.events AS a_events, a.input_tokens AS a_input_tokens, a.avg_share AS a_avg_share, b.events AS b_events, b.input_tokens AS b_input_tokens, b.avg_share AS b_avg_share,
 b.events - a.events AS delta_events, b.input_tokens - a.input_tokens AS delta_input_tokens, b.avg_share - a.avg_share AS delta_avg_share FROM a, b""", "ledger")
def e17_cost_compare(spark, d):
    x = t.ledger(spark, d)
    return ledger.compare(ledger.cost_summary(x, until=1705300000000), ledger.cost_summary(x, since=1705300000001), ["events", "input_tokens", "avg_share"])


@query("SELECT trigger, n, floor(n * 10000 / CAST(sum(n) OVER () AS DOUBLE) + 0.5) / 100 AS share_pct FROM (SELECT trigger, count(*) AS n FROM ledger GROUP BY 1)", "ledger")
def f3_trigger_shares(spark, d):
    return ledger.share_of(t.ledger(spark, d), "trigger")


@query("SELECT session_id, count(*) AS n, round(avg(input_tokens / 50000.0::DOUBLE), 6) AS avg_use, round(max(input_tokens / 50000.0::DOUBLE), 6) AS peak_use, arg_max(share, (\"at\", event_id)) AS last_share, max(\"at\") - min(\"at\") AS range_ms FROM (SELECT * FROM ledger WHERE share IS NOT NULL) GROUP BY ROLLUP (session_id)", "ledger")
def f4_efficiency_rollup(spark, d):
    return ledger.efficiency(t.ledger(spark, d).filter("share is not null"))


@query("SELECT session_id, event_id, row_number() OVER w AS turn, CAST(sum(input_tokens) OVER (PARTITION BY session_id ORDER BY \"at\", event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM ledger WINDOW w AS (PARTITION BY session_id ORDER BY \"at\", event_id)", "ledger")
def f6_usage_turns(spark, d):
    return ledger.usage_turns(t.ledger(spark, d)).select("session_id", "event_id", F.col("turn").cast("long").alias("turn"), "so_far")


@query("""~ l AS (SELECT * FROM ledger WHERE trigger = 'error'), r AS (SELECT * FROM ledger WHERE trigger = 'purchase')
SELECT l.session_id, l.event_id, (SELECT arg_max(r.input_tokens, (r."at", r.event_id)) FROM r WHERE r.session_id = l.session_id AND r."at" <= l."at") AS last_input_tokens FROM l""", "ledger")
def e10_usage_as_of(spark, d):
    x = t.ledger(spark, d)
    return ledger.as_of(x.filter("trigger = 'error'").select("session_id", "event_id", "at"), x.filter("trigger = 'purchase'"), "session_id", "at", ["input_tokens"]).select("session_id", "event_id", "last_input_tokens")


@query("SELECT version, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s FROM (SELECT version, session_id, count(*) AS n, sum(output_tokens) AS s FROM ledger GROUP BY 1, 2) GROUP BY 1", "ledger")
def e16_merge_counts(spark, d):
    parts = t.ledger(spark, d).groupBy("version", "session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("output_tokens").alias("s"))
    return ledger.merge_counts(parts, ["n", "s"], ["version"])


@query(f"""WITH RECURSIVE {t.SQL["ledger"]}, x AS (SELECT session_id, "at", row_number() OVER (PARTITION BY session_id ORDER BY "at") AS r FROM ledger WHERE input_tokens > 2000),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS hit FROM (SELECT DISTINCT session_id FROM x)
 UNION ALL SELECT f.session_id, x.r, CASE WHEN f.n < 5 AND (f.last IS NULL OR x."at" - f.last >= 86400000) THEN f.n + 1 ELSE f.n END, CASE WHEN f.n < 5 AND (f.last IS NULL OR x."at" - f.last >= 86400000) THEN x."at" ELSE f.last END, CASE WHEN f.n < 5 AND (f.last IS NULL OR x."at" - f.last >= 86400000) THEN x."at" END
 FROM f JOIN x ON x.session_id = f.session_id AND x.r = f.r + 1)
SELECT session_id, hit AS "at" FROM f WHERE hit IS NOT NULL""")
def g14_cooldown(spark, d):
    x = ledger.accepted(t.ledger(spark, d), ["session_id"], "at", F.col("input_tokens") > 2000, cap=5, wait_ms=86_400_000)
    return x.select("session_id", "at")


@query("SELECT session_id, event_id, coalesce(turn - max(CASE WHEN input_tokens > 6000 THEN turn END) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING) < 3, false) AS armed FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY \"at\", event_id) AS turn FROM ledger)", "ledger")
def g18_armed_window(spark, d):
    x = ledger.usage_turns(t.ledger(spark, d)).withColumn("fired", F.col("input_tokens") > 6000)
    return ledger.armed(x, ["session_id"], "turn", "fired").select("session_id", "event_id", "armed")


@query("""~ x AS (SELECT *, CASE WHEN version = 'v0' THEN '' ELSE trigger END AS stage FROM ledger),
w AS (SELECT *, last_value(CASE WHEN stage <> '' THEN stage END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, lag(trigger) OVER (PARTITION BY session_id ORDER BY event_id) AS lt, lag(version) OVER (PARTITION BY session_id ORDER BY event_id) AS lv FROM x)
SELECT event_id, coalesce(stage <> '' AND prev <> stage, false) AS boundary, coalesce(lt = trigger AND lv = version, false) AS redo FROM w""", "ledger")
def g15_stage_boundary(spark, d):
    x = t.ledger(spark, d).withColumn("stage", F.when(F.col("version") == "v0", "").otherwise(F.col("trigger")))
    x = drift.stage_changes(x, ["session_id"], "event_id", "stage")
    return drift.repeats(x, ["session_id"], "event_id", ["trigger", "version"]).select("event_id", "boundary", "redo")


# --- G: drift -------------------------------------------------------------------------------------

_W = "x AS (SELECT session_id, idx // 2 AS turn, idx, content FROM messages)"
_TOPIC = f"""~ {_W}, n AS (SELECT session_id, turn, count(*) AS m FROM x GROUP BY 1, 2),
w AS (SELECT session_id, turn, unnest(list_distinct(regexp_extract_all(lower(content), '\\b[a-z][a-z0-9\\-_]{{1,30}}\\b'))) AS keyword FROM x),
f AS (SELECT session_id, turn, keyword, count(*) AS c FROM w WHERE keyword NOT IN ({", ".join(f"'{s}'" for s in drift.STOP)}) AND (length(keyword) >= 3 OR keyword IN ({", ".join(f"'{s}'" for s in drift.TECH)})) GROUP BY 1, 2, 3),
k AS (SELECT f.session_id, f.turn, keyword, least(1.0::DOUBLE, c / m::DOUBLE * CASE WHEN keyword IN ({", ".join(f"'{s}'" for s in drift.TECH)}) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM f JOIN n USING (session_id, turn))"""

_TOP = _TOPIC + ", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY weight DESC, keyword) AS r FROM k) WHERE r <= 20)"
_DRIFT = _TOP + """, seen AS (SELECT * FROM (SELECT session_id, turn, sum(m) OVER (PARTITION BY session_id ORDER BY turn) AS s FROM n) WHERE s >= 2),
o AS (SELECT session_id, turn, lag(turn) OVER (PARTITION BY session_id ORDER BY turn) AS prev FROM seen),
z AS (SELECT session_id, turn, sqrt(sum(weight * weight)) AS size FROM top GROUP BY 1, 2),
dots AS (SELECT o.session_id, o.turn, sum(a.weight * b.weight) AS dot FROM o JOIN top a ON a.session_id = o.session_id AND a.turn = o.turn JOIN top b ON b.session_id = o.session_id AND b.turn = o.prev AND b.keyword = a.keyword GROUP BY 1, 2),
sc AS (SELECT o.session_id, o.turn, CASE WHEN prev IS NULL THEN 0.0::DOUBLE WHEN za.size IS NULL AND zb.size IS NULL THEN 0.0::DOUBLE WHEN za.size IS NULL OR zb.size IS NULL THEN 1.0::DOUBLE ELSE round(1 - coalesce(dot, 0.0) / (za.size * zb.size), 6) END AS score
 FROM o LEFT JOIN z za ON za.session_id = o.session_id AND za.turn = o.turn LEFT JOIN z zb ON zb.session_id = o.session_id AND zb.turn = o.prev LEFT JOIN dots ON dots.session_id = o.session_id AND dots.turn = o.turn)"""


def _turns(spark, d):
    return t.messages(spark, d).withColumn("turn", F.floor(F.col("idx") / 2))


@query(_TOP + " SELECT session_id, turn, keyword, weight FROM top", "messages")
def f20_turn_topics(spark, d):
    return drift.turn_topics(_turns(spark, d), ["session_id", "turn"])


@query(_DRIFT + " SELECT session_id, turn, score, round(avg(score) OVER w3, 6) AS rolling, coalesce(abs(score - lag(score) OVER w) > 0.3, false) AS sudden FROM sc WINDOW w AS (PARTITION BY session_id ORDER BY turn), w3 AS (PARTITION BY session_id ORDER BY turn ROWS 2 PRECEDING)", "messages")
def g2_drift_scores(spark, d):
    return drift.drift(_turns(spark, d), warm_up=2)


@query(None)
def g4_drift_alerts(spark, d):
    return drift.alerts(drift.drift(_turns(spark, d), warm_up=2))


@query("""WITH x AS (SELECT user_id AS session_id, event_id AS turn, (event_id * 29 % 100) / 100.0::DOUBLE AS score FROM events),
h AS (SELECT *, score > 0.6 AS high, sum(CAST(NOT score > 0.6 AS INTEGER)) OVER (PARTITION BY session_id ORDER BY turn) AS island, max(score) OVER (PARTITION BY session_id ORDER BY turn ROWS 2 PRECEDING) AS peak FROM x),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id, island, high ORDER BY turn) AS pos FROM h)
SELECT session_id, turn, peak, CASE WHEN peak >= 0.7 THEN 'high' WHEN peak >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM p WHERE high AND pos % 3 = 0""")
def g4_alert_machine(spark, d):
    x = t.load(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), (F.pmod(F.col("event_id") * 29, F.lit(100)) / 100.0).alias("score"))
    return drift.alerts(x)


# --- I, J: features and classes -------------------------------------------------------------------

_IMP = f"CASE WHEN length(content) < 5 THEN 0 ELSE CASE WHEN {_any('content', tx.CODE)} THEN 30 ELSE 0 END + CASE WHEN {_any('content', tx.DECISION)} THEN 25 ELSE 0 END + CASE WHEN {_any('content', tx.ENTITY)} THEN 20 ELSE 0 END + CASE WHEN {_any('content', tx.QUESTION)} THEN 15 ELSE 0 END END"


@query(f"SELECT session_id, idx, {_IMP} AS importance FROM messages", "messages")
def i1_importance(spark, d):
    return t.messages(spark, d).select("session_id", "idx", tx.importance(F.col("content")).alias("importance"))


@query(f"SELECT session_id, idx, array_to_string(list_filter([{', '.join(repr(x) for x in tx.TOPICS)}], lambda k: contains(lower(content), lower(k))), ',') AS topics FROM messages", "messages")
def i4_topics(spark, d):
    return t.messages(spark, d).select("session_id", "idx", F.array_join(tx.topics(F.col("content")), ",").alias("topics"))


@query(f"SELECT session_id, idx, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(content, '[.!?\\n]+'), lambda s: trim(s)), lambda s: {_any('s', tx.DECISION)} AND length(s) > 10), lambda s: substr(s, 1, 150)), '|') AS decisions FROM messages", "messages")
def i3_decisions(spark, d):
    return t.messages(spark, d).select("session_id", "idx", F.array_join(tx.decision_sentences(F.col("content")), "|").alias("decisions"))


@query(f"SELECT session_id, idx, {_has('content', tx.STATE_WORDS)} AS state, {_has('content', tx.ACTION_WORDS)} AS action FROM messages", "messages")
def j24_screening(spark, d):
    return t.messages(spark, d).select("session_id", "idx", tx.has_words(F.col("content"), tx.STATE_WORDS).alias("state"), tx.has_words(F.col("content"), tx.ACTION_WORDS).alias("action"))


_TASK = {k: " + ".join(f"CASE WHEN {_any('content', [p])} THEN 2 ELSE 0 END" for p in ps) for k, ps in tx.TASK.items()}


@query("~ s AS (SELECT session_id, idx, " + ", ".join(f"{v} AS {k}" for k, v in _TASK.items()) + " FROM messages) SELECT session_id, idx, CASE WHEN greatest(coding, reasoning, writing, conversation) < 2 THEN 'unknown' WHEN coding = greatest(coding, reasoning, writing, conversation) THEN 'coding' WHEN reasoning = greatest(reasoning, writing, conversation) THEN 'reasoning' WHEN writing >= conversation THEN 'writing' ELSE 'conversation' END AS task, CASE WHEN coding + reasoning + writing + conversation = 0 THEN 0.0::DOUBLE ELSE round(greatest(coding, reasoning, writing, conversation) / (coding + reasoning + writing + conversation)::DOUBLE, 6) END AS confidence FROM s", "messages")
def j1_task_type(spark, d):
    c = F.col("content")
    return t.messages(spark, d).select("session_id", "idx", tx.task_type(c).alias("task"), F.round(tx.task_confidence(c), 6).alias("confidence"))


_PT = " ".join(f"WHEN regexp_matches(lower(content), '{p}') THEN '{k}'" for p, k in (*tx.PROMPT_TASK, *tx.PROMPT_TASK_UNGROUPED))
_CX = f"least(1.0::DOUBLE, floor((CASE WHEN length(content) > 500 THEN 0.3::DOUBLE WHEN length(content) > 200 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(list_filter(regexp_split_to_array(content, '[.!?]+'), lambda s: length(trim(s)) > 10)) > 5 THEN 0.2::DOUBLE WHEN len(list_filter(regexp_split_to_array(content, '[.!?]+'), lambda s: length(trim(s)) > 10)) > 2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + " + " + ".join(f"CASE WHEN {_any('content', [p])} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in tx.COMPLEX) + ") * 100 + 0.5) / 100)"


@query(f"SELECT session_id, idx, CASE {_PT} ELSE 'quick-answer' END AS task, {_CX} AS complexity FROM messages", "messages")
def j5_prompt_task(spark, d):
    c = F.col("content")
    return t.messages(spark, d).select("session_id", "idx", tx.prompt_task(c).alias("task"), tx.complexity(c).alias("complexity"))


_AD = ", ".join(f"least(0.95::DOUBLE, ({' + '.join(f'''CAST(contains(lower(content), '{w}') AS INTEGER)''' for w in ws)}) * 0.25::DOUBLE * {wt}::DOUBLE) AS {n}" for n, ws, wt in tx.ADAPTIVE_TASK)
_NAMES = [n for n, _, _ in tx.ADAPTIVE_TASK]


@query(f"~ s AS (SELECT session_id, idx, {_AD} FROM messages) SELECT session_id, idx, CASE WHEN greatest({', '.join(_NAMES)}) = 0 THEN 'unknown' " + " ".join(f"WHEN {n} = greatest({', '.join(_NAMES)}) THEN '{n}'" for n in _NAMES) + f" END AS task, greatest({', '.join(_NAMES)}) AS confidence FROM s", "messages")
def j3_adaptive_task(spark, d):
    x = t.messages(spark, d).select("session_id", "idx", tx.adaptive_task(F.col("content")).alias("a"))
    return x.select("session_id", "idx", F.col("a.type").alias("task"), F.col("a.confidence").alias("confidence"))


@query("""WITH x AS (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS dr, CAST(event_id * 977 % 80000 AS BIGINT) AS b, list_extract([0.8::DOUBLE, 1.0::DOUBLE, 1.2::DOUBLE], CAST(event_id % 3 + 1 AS INTEGER)) AS w FROM events),
s AS (SELECT event_id, round(least(1.0::DOUBLE, b / 80000.0::DOUBLE * 0.5::DOUBLE + (1 - dr) * 0.3::DOUBLE + w * 0.2::DOUBLE), 9) AS s1, round(least(1.0::DOUBLE, b / 80000.0::DOUBLE * 0.3::DOUBLE + dr * 0.3::DOUBLE + w * 0.3::DOUBLE + 0.1::DOUBLE), 9) AS s2, round(least(1.0::DOUBLE, (1 - b / 80000.0::DOUBLE) * 0.5::DOUBLE + dr * 0.3::DOUBLE + w * 0.2::DOUBLE), 9) AS s3, round(least(1.0::DOUBLE, dr * 0.4::DOUBLE + b / 80000.0::DOUBLE * 0.3::DOUBLE + w * 0.3::DOUBLE), 9) AS s4 FROM x)
SELECT * FROM s""")
def j11_strategy_scores(spark, d):
    x = t.load(spark, d, "events").select("event_id", (F.pmod("event_id", F.lit(11)) / 10.0).alias("dr"), F.pmod(F.col("event_id") * 977, F.lit(80000)).alias("b"), F.element_at(F.array(F.lit(0.8), F.lit(1.0), F.lit(1.2)), (F.pmod("event_id", F.lit(3)) + 1).cast("int")).alias("w"))
    s = bg.recall_scores(F.col("dr"), F.col("b"), F.col("w"))
    return x.select("event_id", *[F.round(v, 9).alias(f"s{i + 1}") for i, v in enumerate(s.values())])


@query("SELECT event_id, task, CASE task WHEN 'coding' THEN 'procedural_execution' WHEN 'review' THEN 'compositional_reasoning' WHEN 'debugging' THEN 'factual_recall' WHEN 'planning' THEN 'compositional_reasoning' WHEN 'question' THEN 'factual_recall' ELSE 'balanced' END AS strategy, CASE WHEN event_id % 2 = 0 THEN least(least(m, 3500) * 1.5::DOUBLE, 8000.0) ELSE CAST(least(m, 3500) AS DOUBLE) END AS tokens FROM (SELECT event_id, task, CASE task WHEN 'coding' THEN 4000 WHEN 'review' THEN 3000 WHEN 'debugging' THEN 5000 WHEN 'planning' THEN 4000 WHEN 'question' THEN 1500 WHEN 'conversation' THEN 2000 ELSE 2500 END AS m FROM (SELECT event_id, list_extract(['coding','review','debugging','planning','question','conversation','unknown'], CAST(event_id % 7 + 1 AS INTEGER)) AS task FROM events))")
def j10_injection(spark, d):
    x = t.load(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, bg.INJECTION)), (F.pmod("event_id", F.lit(7)) + 1).cast("int")).alias("task"))
    return x.select("event_id", "task", bg.lookup(F.col("task"), bg.ASSEMBLY, "balanced").alias("strategy"), bg.injection_tokens(F.col("task"), F.lit(3500), F.pmod("event_id", F.lit(2)) == 0).alias("tokens"))


@query("SELECT score, CASE WHEN score IS NULL OR score >= 0.4 THEN 'use' WHEN score >= 0.2 THEN 'expand' ELSE 'max_expand' END AS action, n FROM (SELECT CASE WHEN score_missing THEN NULL ELSE score END AS score, count(*) AS n FROM memories GROUP BY 1)", "memories")
def j15_completeness(spark, d):
    x = t.memories(spark, d).select(F.when(~F.col("score_missing"), F.col("score")).alias("score")).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    return x.select("score", bg.completeness_action(F.col("score")).alias("action"), "n")


@query(None)
def j12_output_quality(spark, d):
    return t.messages(spark, d).select("session_id", "idx", quality.overall(F.col("content")).alias("q")).select("session_id", "idx", "q.*")


@query(None)
def j13_self_refine(spark, d):
    return t.messages(spark, d).select("session_id", "idx", quality.refine("content").alias("refined"))


@query(None)
def i27_relations(spark, d):
    return t.messages(spark, d).select("session_id", "idx", F.explode(quality.relations("content")).alias("r")).select("session_id", "idx", "r.*")


@query("""~ x AS (SELECT session_id, idx, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: length(w) > 3)) AS w FROM messages)
SELECT a.session_id, a.idx, coalesce(bool_or(len(list_intersect(a.w, b.w)) > 0 AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE > 0.2), false) AS duplicate FROM x a LEFT JOIN x b ON a.session_id = b.session_id AND b.idx BETWEEN a.idx - 10 AND a.idx - 1 GROUP BY 1, 2""", "messages")
def e12_window_near_dup(spark, d):
    return quality.near_duplicates(t.messages(spark, d), ["session_id"], "idx", threshold=0.2).select("session_id", "idx", "duplicate")


_POS = " + ".join(f"least({3 * w}::DOUBLE, len(regexp_extract_all(content, '{p}')) * {w}::DOUBLE)" for p, w in tx.IMPORTANCE)


@query(f"SELECT session_id, idx, least(1.0::DOUBLE, floor((0.0::DOUBLE + {_POS} + CASE WHEN length(content) > 100 AND length(content) < 2000 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) * 100 + 0.5) / 100) AS importance FROM messages", "messages")
def i24_position_importance(spark, d):
    return t.messages(spark, d).select("session_id", "idx", tx.position_importance(F.col("content")).alias("importance"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'https?://[^\\s\"''<>)]+')) AS url FROM pages")
def i29_page_links(spark, d):
    return t.load(spark, d, "pages").select("page_id", F.explode(tx.media_refs(F.col("html"))).alias("r")).select("page_id", "r.url")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'table' WHEN 3 THEN 'sql-result' ELSE 'kg' END AS kind FROM events")
def i26_structured_kind(spark, d):
    samples = F.array(*map(F.lit, ('{"a": 1}', "a,b\n1,2\n3,4", "|a|b|\n|-|-|\n|1|2|", "select 1", "the sky is blue")))
    return t.load(spark, d, "events").select("event_id", tx.structured_kind(F.element_at(samples, (F.pmod("event_id", F.lit(5)) + 1).cast("int"))).alias("kind"))


# --- digest ---------------------------------------------------------------------------------------

_SENT = "s AS (SELECT session_id, idx, unnest(generate_series(1, len(p))) - 1 AS pos, trim(unnest(p)) AS sentence FROM (SELECT session_id, idx, string_split(regexp_replace(regexp_replace(content, '([.!?。！？])\\s+', '\\1\n', 'g'), '\\n+', '\n', 'g'), chr(10)) AS p FROM messages))"


@query(f"""~ {_SENT}, f AS (SELECT *, CASE WHEN {_any('sentence', digest.CONFIRMED)} THEN least(0.95::DOUBLE, floor((0.85::DOUBLE + CASE WHEN {_any('sentence', [digest.LINKER])} THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN length(sentence) > 50 THEN 0.05::DOUBLE ELSE 0 END) * 100 + 0.5) / 100) WHEN {_any('sentence', digest.CONFIRMED_WEAK)} AND NOT {_any('sentence', digest.SUPPRESS)} AND {_any('sentence', [digest.LINKER])} THEN 0.75::DOUBLE END AS confidence FROM s)
SELECT session_id, idx, pos, sentence, confidence FROM f WHERE confidence IS NOT NULL AND NOT ends_with(sentence, '?') AND length(sentence) >= 12""", "messages")
def i16_confirmed(spark, d):
    x = digest.confirmed(digest.sentences(t.messages(spark, d)))
    return x.select("session_id", "idx", F.col("pos").cast("long").alias("pos"), "sentence", "confidence")


@query(f"""~ {_SENT}, w AS (SELECT *, regexp_extract(sentence, '{digest.REASON}') AS word FROM s WHERE {_any('sentence', digest.REJECTED)}), p AS (SELECT *, CASE WHEN word = '' THEN 0 ELSE strpos(sentence, word) END AS at_ FROM w)
SELECT session_id, idx, CAST(pos AS INTEGER) AS pos, substr(CASE WHEN at_ > 1 THEN regexp_replace(trim(substr(sentence, 1, at_ - 1)), '[,;:]\\s*$', '') ELSE sentence END, 1, 300) AS approach,
 substr(CASE WHEN at_ > 1 THEN trim(substr(sentence, at_ + length(word))) ELSE '' END, 1, 300) AS reason FROM p""", "messages")
def i17_rejected(spark, d):
    return digest.rejected(digest.sentences(t.messages(spark, d))).select("session_id", "idx", "pos", "approach", "reason")


@query(f"""~ {_SENT}, f AS (SELECT *, regexp_extract(sentence, '{digest.SYMBOL}', 1) AS a, regexp_extract(sentence, '{digest.TICKED}', 1) AS b FROM s WHERE {_any('sentence', [digest.NEGATIVE])})
SELECT session_id, idx, CASE WHEN a <> '' THEN a ELSE b END AS symbol, trim(coalesce(nullif(regexp_extract(sentence, '{digest.WORKAROUND}', 1), ''), regexp_extract(sentence, '{digest.WORKAROUND_CJK}', 1))) AS workaround FROM f WHERE a <> '' OR b <> ''""", "messages")
def i18_pitfalls(spark, d):
    return digest.pitfalls(digest.sentences(t.messages(spark, d))).select("session_id", "idx", "symbol", "workaround")


@query(f"""~ {_SENT}, b AS (SELECT session_id, idx, pos, sentence, greatest(CASE WHEN {_any('sentence', digest.REJECTED)} THEN 3 ELSE 0 END, CASE WHEN {_any('sentence', [digest.NEGATIVE])} THEN 2 ELSE 0 END, CASE WHEN {_any('sentence', [digest.PENDING])} THEN 3 ELSE 0 END, CASE WHEN {_any('sentence', digest.CONFIRMED)} THEN 2 ELSE 0 END) + CASE WHEN {_any('sentence', [digest.SYMBOL, digest.TICKED])} THEN 1 ELSE 0 END AS strength FROM s WHERE sentence <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id, idx ORDER BY strength DESC, pos) AS best FROM b WHERE strength > 0), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY strength DESC, idx) AS rank FROM o WHERE best = 1)
SELECT r.session_id, r.idx, substr(sentence, 1, 512) AS span, strength, CASE WHEN strength >= 4 THEN 0.9::DOUBLE WHEN strength = 3 THEN 0.8::DOUBLE WHEN strength = 2 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM r JOIN messages m ON m.session_id = r.session_id AND m.idx = r.idx WHERE rank <= 20 AND contains(m.content, substr(sentence, 1, 512))""", "messages")
def i19_claims(spark, d):
    m = t.messages(spark, d)
    found = digest.claims(digest.sentences(m), ["session_id"], ["idx"])
    return digest.valid_claims(found.drop("content"), m, ["session_id", "idx"]).select("session_id", "idx", "span", "strength", "confidence")


@query(None)
def i21_digest_text(spark, d):
    x = digest.confirmed(digest.sentences(t.messages(spark, d)))
    rows = x.select("session_id", F.lit("confirmed").alias("kind"), (F.col("idx") * 1000 + F.col("pos")).alias("seq"), F.col("sentence").alias("text"), "confidence")
    return digest.serialize(rows, ["session_id"])


# --- resume ---------------------------------------------------------------------------------------


@query("SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id) AS r FROM summaries) WHERE r = 1", "summaries")
def g11_latest_per_session(spark, d):
    return resume.latest_per_session(t.summaries(spark, d)).select("session_id", "event_id")


@query(f"SELECT session_id, event_id, bucket FROM (SELECT session_id, event_id, CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id) <= 3 THEN 'recent' WHEN ({NOW} - ts) / 86400000.0::DOUBLE <= 7 THEN 'this_week' WHEN ({NOW} - ts) / 86400000.0::DOUBLE <= 30 THEN 'older' END AS bucket FROM summaries) WHERE bucket IS NOT NULL", "summaries")
def g10_time_buckets(spark, d):
    return resume.time_buckets(t.summaries(spark, d), NOW, ["session_id"]).select("session_id", "event_id", "bucket")


@query(f"SELECT session_id, round(avg(CASE WHEN ts > {NOW} THEN 1.0::DOUBLE ELSE exp(-(({NOW} - ts) / 3600000.0::DOUBLE) / 24.0::DOUBLE) END), 6) AS freshness FROM summaries GROUP BY 1", "summaries")
def g12_freshness(spark, d):
    return resume.freshness(t.summaries(spark, d), ["session_id"], NOW)


@query("SELECT session_id, CASE WHEN s >= 86400000 THEN CAST(CAST(floor(s / 86400000.0::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || ' days' ELSE CAST(CAST(floor(s / 3600000.0::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || ' hours' END AS timeline FROM (SELECT session_id, max(ts) - min(ts) AS s FROM summaries GROUP BY 1)", "summaries")
def g13_timeline(spark, d):
    return resume.timeline(t.summaries(spark, d), ["session_id"])


@query(None)
def f8_daily_merge(spark, d):
    x = resume.daily_merge(t.summaries(spark, d), ["session_id"])
    return x.select("session_id", "day", "theme", F.array_join("key_points", "|").alias("points"), F.array_join("tasks", "|").alias("tasks"), F.array_join(F.array_sort("entities"), "|").alias("entities"), "ts", "n_messages")


@query("""~ w AS (SELECT session_id, unnest(string_split(lower(theme), ' ')) AS word FROM summaries), g AS (SELECT session_id, word, count(*) AS n FROM w GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, word) AS rank FROM g) SELECT session_id, word, n, rank FROM r WHERE rank <= 3""", "summaries")
def f9_top_theme_words(spark, d):
    return resume.top_words(t.summaries(spark, d), ["session_id"], "theme", 3)


@query("""~ p AS (SELECT session_id, event_id, list_distinct(list_transform(key_points, lambda x: lower(x))) AS a, list_distinct(list_transform(lead(key_points) OVER (PARTITION BY session_id ORDER BY ts, event_id), lambda x: lower(x))) AS b FROM summaries)
SELECT session_id, event_id, CASE WHEN b IS NULL THEN NULL ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) END AS similarity FROM p""", "summaries")
def e11_adjacent_similarity(spark, d):
    x = resume.adjacent_similarity(t.summaries(spark, d), ["session_id"], [F.col("ts"), F.col("event_id")])
    return x.select("session_id", "event_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, len(l) - len(list_distinct(l)) AS duplicates FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: lower(trim(x))), lambda x: x <> '') AS l FROM documents)")
def h3_duplicate_lines(spark, d):
    return t.load(spark, d, "documents").select("doc_id", resume.duplicate_lines(F.coalesce("text", F.lit(""))).cast("long").alias("duplicates"))


@query("""~ q AS (SELECT session_id, event_id, list_distinct(string_split(theme, ' ')) AS w, array_to_string(key_points, ' ') AS c FROM summaries)
SELECT session_id, event_id, round(len(list_filter(w, lambda k: contains(lower(c), k))) / len(w)::DOUBLE, 6) AS coverage FROM q""", "summaries")
def j14_coverage(spark, d):
    return t.summaries(spark, d).select("session_id", "event_id", F.round(resume.coverage(F.col("theme"), F.array_join("key_points", " ")), 6).alias("coverage"))


@query(f"""~ x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id) AS r FROM summaries WHERE {NOW} - ts <= 240 * 3600000)
SELECT session_id, string_agg('- ' || theme || ' (' || CAST(n_messages AS VARCHAR) || ' messages)', chr(10) ORDER BY r) AS block, count(*) AS entries FROM x WHERE r <= 5 GROUP BY 1""", "summaries")
def k4_history_block(spark, d):
    return resume.history_block(t.summaries(spark, d), ["session_id"], NOW, max_age_hours=240)


@query(None)
def k8_checkpoint(spark, d):
    x = resume.checkpoint_record(t.summaries(spark, d), ["session_id"], [F.desc("ts"), F.col("event_id")])
    return x.select("session_id", *[F.array_join(c, "|").alias(c) for c in ("topics", "tasks", "entities")])


# --- graph ----------------------------------------------------------------------------------------


def _mentions(spark, d):
    s = t.summaries(spark, d)
    return s.select("session_id", F.col("event_id").alias("idx"), F.explode(F.array_distinct("entities")).alias("entity"))


_MEN = "m AS (SELECT session_id, event_id AS idx, unnest(list_distinct(entities)) AS entity FROM summaries)"


@query(f"~ {_MEN} SELECT a.entity AS a, b.entity AS b, count(*) AS n, count(DISTINCT a.session_id) AS sessions FROM m a JOIN m b ON a.session_id = b.session_id AND a.idx = b.idx AND a.entity < b.entity GROUP BY 1, 2", "summaries")
def e2_cooccurrence(spark, d):
    return graph.cooccurrence(_mentions(spark, d), ["session_id", "idx"])


@query(f"~ {_MEN}, e AS (SELECT DISTINCT CASE WHEN a.entity = 'git' THEN b.entity ELSE a.entity END AS entity FROM m a JOIN m b ON a.session_id = b.session_id AND a.idx = b.idx AND a.entity < b.entity WHERE a.entity = 'git' OR b.entity = 'git' UNION SELECT 'git') SELECT entity, session_id, max(idx) AS last_idx FROM m WHERE entity IN (SELECT entity FROM e) GROUP BY 1, 2", "summaries")
def e3_related(spark, d):
    m = _mentions(spark, d)
    return graph.related(m, graph.cooccurrence(m, ["session_id", "idx"]), "git")


@query(f"~ {_MEN} SELECT entity, count(DISTINCT session_id) AS sessions, count(*) AS mentions FROM m GROUP BY 1 HAVING count(DISTINCT session_id) >= 2", "summaries")
def e4_cross_session(spark, d):
    return graph.cross_session(_mentions(spark, d))


@query(None)
def e5_dependency_chain(spark, d):
    m = _mentions(spark, d)
    l, r = m.select("session_id", "idx", F.col("entity").alias("a")), m.select("session_id", "idx", F.col("entity").alias("b"))
    edges = l.join(r, ["session_id", "idx"]).filter("a < b").select("session_id", "a", "b").distinct()
    start = m.groupBy("session_id").agg(F.min_by("entity", F.struct("idx", "entity")).alias("entity"))
    return graph.dependency_chain(edges, start)


_HALVES = "o AS (SELECT * FROM memories WHERE id % 3 <> 0), n AS (SELECT id, session_id, content, CASE WHEN id % 5 = 0 THEN score + 0.1 ELSE score END AS score FROM memories WHERE id % 4 <> 0 OR id % 3 = 0)"
_KEYED = "a AS (SELECT session_id, lower(trim(substr(content, 1, 40))) AS key, max(score) AS a FROM o GROUP BY 1, 2), b AS (SELECT session_id, lower(trim(substr(content, 1, 40))) AS key, max(score) AS b FROM n GROUP BY 1, 2), x AS (SELECT session_id, key, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' WHEN abs(a - b) > 0.01 THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL OUTER JOIN b USING (session_id, key))"


def _diff(spark, d):
    m = t.memories(spark, d)
    new = m.filter("id % 4 <> 0 or id % 3 = 0").withColumn("score", F.when(F.col("id") % 5 == 0, F.col("score") + 0.1).otherwise(F.col("score")))
    return graph.snapshot_diff(m.filter("id % 3 <> 0"), new, ["session_id"])


@query(f"~ {_HALVES}, {_KEYED} SELECT session_id, key, change FROM x", "memories")
def e1_snapshot_diff(spark, d):
    return _diff(spark, d)


@query(f"~ {_HALVES}, {_KEYED} SELECT session_id, count_if(change = 'added') AS added, count_if(change = 'deleted') AS deleted, count_if(change = 'modified') AS modified, count_if(change = 'unchanged') AS unchanged, round(count_if(change = 'unchanged') / count(*)::DOUBLE, 6) AS stability FROM x GROUP BY 1", "memories")
def f12_stability(spark, d):
    return graph.stability(_diff(spark, d), ["session_id"])


@query("""~ x AS (SELECT theme, event_id, (event_id % 10) / 10.0::DOUBLE AS c, n_messages FROM summaries)
SELECT lower(trim(theme)) AS key, max(c) AS c, min(event_id) AS first_seq, arg_max(n_messages, event_id) AS n_messages FROM x GROUP BY 1""", "summaries")
def e13_digest_merge(spark, d):
    x = t.summaries(spark, d).select("theme", "event_id", (F.pmod("event_id", F.lit(10)) / 10.0).alias("c"), "n_messages")
    return graph.upsert(x.filter("event_id % 8 = 0"), x.filter("event_id % 8 <> 0"), "theme", "event_id", "c", ["n_messages"])


@query("""WITH g AS (SELECT event_type AS task, user_id AS key, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, least(0.95::DOUBLE, n / CAST(sum(n) OVER (PARTITION BY task) AS DOUBLE)) AS confidence, row_number() OVER (PARTITION BY task ORDER BY n DESC, key) AS rank FROM g) SELECT task, key, n, round(confidence, 9) AS confidence, rank FROM r WHERE rank <= 5""")
def f21_predict_frequent(spark, d):
    x = t.load(spark, d, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("key"))
    return graph.frequent(x, "task", "key", 5).withColumn("confidence", F.round("confidence", 9))


# --- signals --------------------------------------------------------------------------------------

_DOM = "CASE " + " ".join(f"WHEN regexp_matches(source, '{p}') THEN '{n}'" for n, p in signals.DOMAINS) + " ELSE 'unknown' END"


@query(f"SELECT source, {_DOM} AS domain, CASE WHEN {_DOM} = 'unknown' THEN 0.3::DOUBLE ELSE 0.9::DOUBLE END AS confidence, count(*) AS n FROM signals GROUP BY 1", "signals")
def j17_domains(spark, d):
    g = t.signals(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("x", signals.domain(F.col("source")))
    return g.select("source", "x.domain", "x.confidence", "n")


@query(f"SELECT session_id, bool_or(dm = 'governance') AND bool_or(dm = 'ci') AS compliance_check, bool_or(dm = 'memory') AND bool_or(dm = 'session') AS inject_history, bool_or(dm = 'cross-domain') AND bool_or(dm = 'memory') AS correlate, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS tokens FROM (SELECT *, {_DOM} AS dm FROM signals) GROUP BY 1", "signals")
def j18_fusion(spark, d):
    return signals.fusion(t.signals(spark, d), ["session_id"])


@query(f"SELECT session_id, {_DOM} AS domain, round(avg(conf), 6) AS weight, count(*) AS n FROM signals GROUP BY 1, 2", "signals")
def f16_domain_weights(spark, d):
    return signals.domain_weights(t.signals(spark, d), ["session_id"])


_HINT_SOURCES = ("governance", "rl", "ci", "drift", "other")
_HINTS = f"""h AS (SELECT user_id AS session_id, event_id AS idx, {t._pick(_HINT_SOURCES, 'event_id')} AS source, event_type || ' on ' || {t._pick(t.TOPICS, 'event_id')} AS block FROM events),
hr AS (SELECT *, CASE source WHEN 'governance' THEN 'authority' WHEN 'rl' THEN 'exemplar' WHEN 'ci' THEN 'constraint' WHEN 'drift' THEN 'rubric' ELSE 'metadata' END AS role FROM h),
hp AS (SELECT *, CASE role WHEN 'authority' THEN 1 WHEN 'constraint' THEN 2 WHEN 'rubric' THEN 3 WHEN 'exemplar' THEN 4 ELSE 5 END AS priority FROM hr)"""


def _hints(spark, d):
    e = t.load(spark, d, "events")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.pmod("event_id", F.lit(len(words))) + 1).cast("int"))
    x = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("idx"), pick(_HINT_SOURCES).alias("source"), F.concat("event_type", F.lit(" on "), pick(t.TOPICS)).alias("block"))
    return x.withColumn("role", signals.role(F.col("source"))).withColumn("priority", signals.priority(F.col("role")))


@query(f"WITH {_HINTS} SELECT session_id, string_agg(block, chr(10) || chr(10) ORDER BY priority, idx) AS text FROM hp GROUP BY 1")
def j19_role_order(spark, d):
    return signals.assemble(_hints(spark, d), ["session_id"])


@query(f"WITH {_HINTS} SELECT session_id, " + ", ".join(f"count_if(role = '{r}') AS {r}" for r in signals.ROLE_PRIORITY) + ", count(*) AS total FROM hp GROUP BY 1")
def f15_role_breakdown(spark, d):
    return signals.role_breakdown(_hints(spark, d), ["session_id"])


@query(f"""WITH {_HINTS}, w AS (SELECT *, list_filter(regexp_split_to_array(lower(block), '\\s+'), lambda x: x <> 'on') AS t FROM hp),
j AS (SELECT a.session_id, a.idx AS a_idx, b.idx AS b_idx, list_filter(a.t, lambda x: list_contains(b.t, x))[1] AS topic, CASE WHEN a.priority < b.priority THEN a.source ELSE b.source END AS high_source, CASE WHEN a.priority < b.priority THEN b.source ELSE a.source END AS low_source, CASE WHEN a.priority < b.priority THEN a.role ELSE b.role END AS resolved FROM w a JOIN w b ON a.session_id = b.session_id AND a.idx < b.idx AND a.priority <> b.priority)
SELECT * FROM j WHERE topic IS NOT NULL""")
def e7_role_conflicts(spark, d):
    return signals.conflicts(_hints(spark, d), ["session_id"])


@query(f"SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(m AS VARCHAR) || 'm ago' WHEN m < 1440 THEN CAST(CAST(floor(m / 60.0) AS BIGINT) AS VARCHAR) || 'h ago' ELSE CAST(CAST(floor(m / 1440.0) AS BIGINT) AS VARCHAR) || 'd ago' END AS since FROM (SELECT id, CAST(floor(({NOW} - \"at\") / 60000.0) AS BIGINT) AS m FROM signals)", "signals")
def k10_relative_time(spark, d):
    return t.signals(spark, d).select("id", signals.relative_time(F.col("at"), F.lit(NOW)).alias("since"))


# --- windows over time ----------------------------------------------------------------------------


@query("SELECT epoch_ms(date_trunc('hour', ts)) AS hour_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def l8_hourly_windows(spark, d):
    e = t.load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.unix_millis("window.start").alias("hour_ms"), "event_type", "n", "total")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, CAST(floor(epoch_us(min(ts)) / 1000) AS BIGINT) AS start_ms, count(*) AS n FROM g GROUP BY user_id, s""")
def l8_session_windows(spark, d):
    e = t.load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_millis("session_window.start").alias("start_ms"), "n")


# --- the main plans -------------------------------------------------------------------------------


@query(f"""~ s AS (SELECT session_id, idx AS id, content, least(1.0::DOUBLE, floor((({_IMP}) / 100.0::DOUBLE + (idx % 7) / 20.0::DOUBLE) * 100 + 0.5) / 100) AS score, {TOK} AS tokens FROM messages),
g AS (SELECT *, {_THRESH.format(m="avg(score) OVER (PARTITION BY session_id)", s="stddev_pop(score) OVER (PARTITION BY session_id)")} AS threshold FROM s),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM g WHERE score >= threshold)
SELECT session_id, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens, max(threshold) AS threshold, '[Memory ' || rpad(substr(CAST(session_id AS VARCHAR), 1, 8), 8, '0') || ']' || chr(10) || string_agg('- ' || substr(content, 1, 120), chr(10) ORDER BY score DESC, id) AS block FROM r WHERE running <= 400 GROUP BY session_id""", "messages")
def k1_budgeted_recall(spark, d):
    return assemble.recall_blocks(assemble.message_scores(t.messages(spark, d)))


@query(None)
def k2_compaction_summary(spark, d):
    return assemble.compact(t.messages(spark, d))[1]


@query(f"SELECT session_id, count(*) - 4 AS removed FROM messages GROUP BY 1 HAVING count(*) > 4", "messages")
def k2_removed_counts(spark, d):
    return assemble.compact(t.messages(spark, d))[1].select("session_id", "removed")
