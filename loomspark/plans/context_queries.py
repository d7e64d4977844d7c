"""Queries of the full context assembly and of media references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import drift, refine
from ..sources import tables as t
from . import context
from .queries import _CX, _HINTS, _PT, ORACLE_SQL, TOKENS, _hints, _turns, query

BUDGET = 400
_LIT = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _assembly_inputs(spark, d):
    m = t.messages(spark, d)
    turns = m.filter("role = 'user'").select("session_id", F.floor(F.col("idx") / 2).alias("turn"), F.col("content").alias("query"))
    turns = turns.groupBy("session_id", "turn").agg(F.max("query").alias("query"))
    score = F.pmod(F.col("id") * 37 + F.col("turn") * 11, F.lit(100)) / 100.0
    hits = turns.select("session_id", "turn").join(t.memories(spark, d).select("session_id", "id", "content"), "session_id").select("session_id", "turn", "id", F.substring("content", 1, 200).alias("content"), score.alias("score"))
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id")))
    s = t.summaries(spark, d).withColumn("_r", newest).filter("_r <= 3").groupBy("session_id")
    history = s.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "theme"))), lambda r: F.concat(F.lit("- "), r["theme"])), "\n").alias("text"))
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("idx")))
    outside = _hints(spark, d).withColumn("seq", newest).filter("seq <= 3").select("session_id", "seq", "source", "block")
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))
    cards = t.signals(spark, d).filter("source = 'ci_pipeline'").withColumn("seq", newest).select("session_id", "seq", F.concat(F.lit("[card "), F.col("id").cast("string"), F.lit("] "), F.col("content")).alias("card"))
    failing = turns.filter(F.col("query").rlike("error|fails")).select("session_id", "turn")
    scores = drift.drift(_turns(spark, d), warm_up=2)
    return turns, hits, history, failing.join(cards, "session_id"), outside, scores, drift.alerts(scores, run=1)


_STRATEGY = " ".join(f"WHEN how = '{n}' THEN '[Strategy: {n}] ' || {_LIT(x)}" for n, x in context.STRATEGY_TEXTS.items())
_REASON = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.REASONING.items())
_ACTIONS = " ".join(f"WHEN '{k}' THEN {_LIT(v)}" for k, v in context.DRIFT_ACTIONS.items())
_SAFE = "content"
for _p, _r in tx.SANITIZE:
    _SAFE = f"regexp_replace({_SAFE}, '{_p}', '{_r}', 'g')"
#: All blocks of all turns in SQL, from the tables alone; ``sc`` are the drift scores.
_BLOCKS = f"""tu AS MATERIALIZED (SELECT session_id, idx // 2 AS turn, max(content) AS query FROM messages WHERE role = 'user' GROUP BY 1, 2),
hi AS MATERIALIZED (SELECT session_id, turn, id, substring(content, 1, 200) AS content, ((id * 37 + turn * 11) % 100) / 100.0::DOUBLE AS score FROM tu JOIN memories USING (session_id)),
fo AS MATERIALIZED (SELECT tu.*, EXISTS (SELECT 1 FROM hi WHERE hi.session_id = tu.session_id AND hi.turn = tu.turn) AS warm FROM tu),
se AS MATERIALIZED (SELECT * FROM (SELECT session_id, turn, id, content, score, {TOKENS.format('content')} AS tokens, sum({TOKENS.format('content')}) OVER (PARTITION BY session_id, turn ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM hi WHERE score >= 0.3) WHERE run <= {BUDGET}),
hs AS (SELECT session_id, string_agg('- ' || theme, chr(10) ORDER BY r) AS content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM summaries) WHERE r <= 3 GROUP BY 1),
ca AS (SELECT * FROM (SELECT *, sum(CAST(ceil(length(card) / 4.0) AS BIGINT)) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS seq, '[card ' || id || '] ' || content AS card FROM signals WHERE source = 'ci_pipeline')) WHERE run <= {context.CARD_TOKENS}),
ep AS MATERIALIZED (SELECT session_id, turn, score, last_value(CASE WHEN sudden THEN turn END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch, first_value(CASE WHEN sudden THEN turn END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following FROM sc),
wa AS (SELECT *, row_number() OVER (PARTITION BY session_id, following ORDER BY turn DESC) AS back FROM ep WHERE score > 0.6 AND following IS NOT NULL),
dr AS (SELECT e.session_id, e.turn, string_agg('[Drift ' || upper(lv) || '] Score: ' || printf('%.2f', w.score) || ' — ' || CASE lv {_ACTIONS} END, chr(10) ORDER BY back DESC) AS content FROM ep e JOIN (SELECT *, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS lv FROM wa WHERE back <= 2) w ON e.session_id = w.session_id AND e.epoch = w.following GROUP BY 1, 2),
st AS (SELECT session_id, turn, CASE task {_REASON} ELSE CASE WHEN complexity >= 0.7 THEN 'graph-of-thoughts' WHEN complexity >= 0.5 THEN 'tree-of-thoughts' ELSE 'chain-of-thought' END END AS how FROM (SELECT session_id, turn, CASE {_PT} ELSE 'quick-answer' END AS task, {_CX} AS complexity FROM (SELECT session_id, turn, query AS content FROM fo WHERE warm))),
me AS (SELECT session_id, turn, u, r, regexp_matches(u, '(?i)\\.(png|jpg|jpeg|gif|webp|svg|bmp)(\\?\\S*)?$') AS img FROM (SELECT session_id, turn, regexp_replace(unnest(urls), '[.,;)\\]}}>"'']+$', '') AS u, unnest(range(len(urls))) AS r FROM (SELECT session_id, turn, regexp_extract_all(query, 'https?://\\S+') AS urls FROM fo WHERE warm))),
bl AS MATERIALIZED (
  SELECT session_id, turn, warm AS stable, CASE WHEN warm THEN 0 ELSE 9 END AS pr, 0 AS place, 0 AS rank, 'resume' AS source, CASE WHEN warm THEN '[Session History — hash:' || rpad(substring(CAST(session_id AS VARCHAR), 1, 8), 8, '0') || ']' || chr(10) || {_SAFE} ELSE {_LIT(context.HISTORY_INTRO)} || content || {_LIT(context.HISTORY_END)} END AS block FROM fo JOIN hs USING (session_id)
  UNION ALL SELECT session_id, turn, warm, CASE WHEN warm THEN 0 ELSE 5 END, CASE WHEN warm THEN 1 ELSE -1 END, 0, 'error-card', string_agg(card, chr(10) ORDER BY seq) FROM fo JOIN ca USING (session_id) WHERE regexp_matches(query, 'error|fails') GROUP BY 1, 2, 3, 4, 5
  UNION ALL SELECT session_id, turn, true, 0, 2, 0, 'memory', '[Context] Relevant information:' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY score DESC, id) FROM se GROUP BY 1, 2
  UNION ALL SELECT session_id, turn, false, priority, 3, seq, source, block FROM fo JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS seq FROM hp) USING (session_id) WHERE seq <= 3
  UNION ALL SELECT session_id, turn, false, 3, 4, 0, 'drift', '[Drift Monitor]' || chr(10) || content FROM dr JOIN fo USING (session_id, turn) WHERE warm
  UNION ALL SELECT session_id, turn, false, 5, 5, 0, 'prompt-strategy', CASE {_STRATEGY} END FROM st WHERE how <> 'direct' AND how IN ('chain-of-thought', 'tree-of-thoughts', 'graph-of-thoughts')
  UNION ALL SELECT session_id, turn, false, 5, 6, r, 'multimodal', '[Image URL: ' || split_part(u, '/', -1) || ']' FROM me WHERE img)"""
_SCORES = ORACLE_SQL["g2_drift_scores"]
_HEAD = f"~sc AS MATERIALIZED ({_SCORES}), {_HINTS}, {_BLOCKS}"
_TABLES = ("messages", "memories", "summaries", "signals")


@query(_HEAD + " SELECT session_id, turn, source, stable, block FROM bl", *_TABLES)
def k17_context_blocks(spark, d):
    return context.blocks(context.gather(*_assembly_inputs(spark, d), budget=BUDGET))


@query(
    _HEAD
    + f""", ag AS MATERIALIZED (SELECT session_id, turn, coalesce(list(block ORDER BY place) FILTER (stable), []) AS head, coalesce(list(block ORDER BY pr, place, rank) FILTER (NOT stable), []) AS tail, string_agg(source, ',' ORDER BY NOT stable, pr, place, rank) AS sources FROM bl GROUP BY 1, 2),
su AS (SELECT session_id, turn, CAST(sum(tokens) AS BIGINT) AS tokens FROM se GROUP BY 1, 2),
al AS (SELECT session_id, turn, coalesce(head, []) AS head, coalesce(tail, []) AS tail, coalesce(sources, '') AS sources, coalesce(tokens, 0) AS tokens, coalesce(sc.rolling, 0.0) AS drift, lag(coalesce(head, [])) OVER (PARTITION BY session_id ORDER BY turn) AS before FROM tu LEFT JOIN ag USING (session_id, turn) LEFT JOIN su USING (session_id, turn) LEFT JOIN sc USING (session_id, turn)),
ke AS (SELECT *, CASE WHEN before IS NULL THEN 0 ELSE len(list_filter(range(1, len(head) + 1), lambda i: head[1:i] = before[1:i] AND len(before) >= i)) END AS kept_blocks FROM al)
SELECT session_id, turn, len(head) AS n_stable, len(tail) AS n_dynamic, sources, tokens, kept_blocks, length(array_to_string(head[1:kept_blocks], chr(10) || chr(10))) AS kept_chars,
  array_to_string(head, chr(10) || chr(10)) AS prefix, array_to_string(tail, chr(10) || chr(10)) AS suffix, array_to_string(list_concat(head, tail), chr(10) || chr(10)) AS text, drift, drift >= {context.COMPACT_DRIFT} AS auto_compact,
  CASE WHEN tokens > {context.WARN_SHARE * BUDGET} AND sum(CAST(tokens > {context.WARN_SHARE * BUDGET} AS INTEGER)) OVER w = 1 THEN '[Token Budget Warning: ' || tokens || '/{BUDGET} tokens used (' || CAST(floor(tokens * 100 / {BUDGET}.0 + 0.5) AS BIGINT) || '%) — consider compaction]' END AS warning,
  CASE WHEN drift >= {context.SESSION_DRIFT} AND sum(CAST(drift >= {context.SESSION_DRIFT} AS INTEGER)) OVER w = 1 THEN {_LIT(context.AUTO_SESSION)} END AS suggestion
FROM ke WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
    *_TABLES,
)
def k1_assemble(spark, d):
    return context.assemble(context.gather(*_assembly_inputs(spark, d), budget=BUDGET), BUDGET)


_MARKS = ("", " ![a chart](img/c.svg)", " data:image/png;base64,AAAA", " https://example.com/talk.mp3?t=10.", " (https://example.com/v.MP4)", " https://example.com/page")
_MEDIA = f"SELECT session_id, idx, content || {t._pick(_MARKS, 'session_id + idx')} AS content FROM messages"
_ENDS = {k: p.replace("(?i)", "").replace("{0,200}", "*") for k, p in tx.MEDIA_URLS.items()}
_KIND = " ".join(f"WHEN regexp_matches(u, '(?i){p}') THEN '{k}'" for k, p in _ENDS.items())


@query(
    rf"""~me AS ({_MEDIA}), ur AS (SELECT session_id, idx, unnest(list_transform(regexp_extract_all(content, '(?i)\bhttps?://\S+'), lambda x: regexp_replace(x, '[.,;)\]}}>"'']+$', ''))) AS u FROM me),
ki AS (SELECT *, CASE {_KIND} END AS kind FROM ur)
SELECT session_id, idx, kind, u AS url, CASE kind WHEN 'image' THEN '[Image URL: ' WHEN 'audio' THEN '[Audio: ' ELSE '[Video: ' END || split_part(u, '/', -1) || ']' AS description FROM ki WHERE kind IS NOT NULL
UNION ALL SELECT session_id, idx, 'image', NULL, '[Image: PNG format, base64 encoded]' FROM me WHERE contains(content, 'data:image/png;base64,')
UNION ALL SELECT session_id, idx, 'image', u, '[Image: ' || split_part(u, '/', -1) || ']' FROM (SELECT session_id, idx, regexp_extract(content, '!\[[^\]]*\]\(([^)]*)\)', 1) AS u FROM me) WHERE u <> ''""",
    "messages",
)
def i29_media_references(spark, d):
    m = t.messages(spark, d)
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.pmod(F.col("session_id") + F.col("idx"), F.lit(len(_MARKS))) + 1).cast("int"))
    return m.select("session_id", "idx", F.explode(tx.media_references(F.concat("content", mark))).alias("m")).select("session_id", "idx", "m.kind", "m.url", "m.description")


_UNFINISHED = ("TODO: undefined TODO", "fine as it is", "work in progress, NULL and nullable", "to be continued...", "FIXME null WIP")


def _first(text: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{new}')"


_REFINED = "text"
for _p in refine.INCOMPLETE:
    _REFINED = _first(_REFINED, _p)
_REFINED = f"regexp_replace(regexp_replace({_REFINED}, '(?i)\\bundefined\\b', 'specified', 'g'), '(?i)\\bnull\\b', 'none', 'g')"


@query(f"~ x AS (SELECT session_id, idx, content || ' ' || {t._pick(_UNFINISHED, 'session_id + idx')} AS text FROM messages) SELECT session_id, idx, CASE WHEN {_REFINED} = text THEN text || chr(10) || chr(10) || '[Refined based on: unclear]' ELSE {_REFINED} END AS refined FROM x", "messages")
def j13_refined(spark, d):
    mark = F.element_at(F.array(*map(F.lit, _UNFINISHED)), (F.pmod(F.col("session_id") + F.col("idx"), F.lit(len(_UNFINISHED))) + 1).cast("int"))
    return t.messages(spark, d).select("session_id", "idx", refine.refine(F.concat("content", F.lit(" "), mark), F.lit("unclear")).alias("refined"))


@query(None)
def i27_relation_triples(spark, d):
    m = t.messages(spark, d).select("session_id", "idx", F.explode(refine.relations(F.col("content"))).alias("r"))
    return m.select("session_id", "idx", "r.subject", "r.predicate", "r.object")
