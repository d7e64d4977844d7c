"""Queries of compaction to a token target."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import tables as t
from . import compaction
from .queries import _IMP, TOK, TOKENS, _any, query

#: Sessions of the tables are short: two messages stay, and one is too few to remove.
MIN_KEEP, TOO_FEW = 2, 1


def _inputs(spark, d):
    m = t.messages(spark, d).withColumn("derived", F.col("role") == "system")
    windows = m.select("session_id").distinct().select("session_id", (F.pmod("session_id", F.lit(4)) * 300 + 200).alias("window"))
    return m, windows


def _compacted(spark, d, strategy):
    return compaction.compact_to(*_inputs(spark, d), strategy, min_keep=MIN_KEEP, too_few=TOO_FEW)


_SEEN = lambda names: "[" + ", ".join("'" + n + "'" for n in names) + "]"
_DECIDED = _any("s", tx.DECISION)
_ENTITIES = " UNION ALL ".join(f"SELECT session_id, idx, {i} AS p, unnest(m) AS e, unnest(range(len(m))) AS j FROM (SELECT session_id, idx, regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}') AS m FROM src)" for i, p in enumerate(tx.ENTITY))
#: Verdicts of both strategies; the strategy gives ``kp`` (session_id, idx, kept) and ``su`` (session_id, summary).
_SOURCE = f"""RECURSIVE {t.SQL["messages"]}, al AS MATERIALIZED (SELECT session_id, idx, role, content, role = 'system' AS derived, {TOK} AS tokens FROM messages),
ses AS MATERIALIZED (SELECT session_id, count(*) FILTER (NOT derived) AS n, count(*) FILTER (derived) AS n_derived, coalesce(sum(tokens) FILTER (NOT derived), 0) AS before, coalesce(sum(tokens) FILTER (derived), 0) AS dtok, CAST(floor((session_id % 4 * 300 + 200) * 0.75::DOUBLE) AS BIGINT) AS target FROM al GROUP BY 1),
src AS MATERIALIZED (SELECT al.*, target, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS place FROM al JOIN ses USING (session_id) WHERE NOT derived AND before > target),
"""
_RECENT = f"""ru AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY idx DESC ROWS UNBOUNDED PRECEDING) AS run FROM src),
fr AS (SELECT session_id, least(count(*), greatest({MIN_KEEP}, max(CASE WHEN run > target THEN place END) + 1)) AS start FROM ru GROUP BY 1),
kp AS MATERIALIZED (SELECT session_id, idx, place >= start AS kept FROM src JOIN fr USING (session_id)),
old AS MATERIALIZED (SELECT src.* FROM src JOIN kp USING (session_id, idx) WHERE NOT kept),
tp AS (SELECT session_id, k, i, min(idx) AS fst FROM old, (SELECT unnest({_SEEN(compaction.RECENT_TOPICS)}) AS k, unnest(range({len(compaction.RECENT_TOPICS)})) AS i) WHERE contains(lower(content), lower(k)) GROUP BY 1, 2, 3),
tl AS (SELECT session_id, string_agg(k, ', ' ORDER BY fst, i) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY fst, i) AS r FROM tp) WHERE r <= 15 GROUP BY 1),
rq AS (SELECT session_id, string_agg('"' || substring(content, 1, 100) || '"', '; ' ORDER BY idx) AS asked FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS r FROM old WHERE role = 'user' AND content <> '') WHERE r <= 5 GROUP BY 1),
su AS (SELECT session_id, '[Compacted History — ' || count(*) || ' earlier messages summarized]' || chr(10) || 'Topics: ' || coalesce(max(topics), 'general discussion') || coalesce(chr(10) || 'Key requests: ' || max(asked), '') || chr(10) || chr(10) || 'Continue with the current task using the remaining recent context below.' AS summary FROM old LEFT JOIN tl USING (session_id) LEFT JOIN rq USING (session_id) GROUP BY 1)"""
_SEMANTIC = f"""wd AS MATERIALIZED (SELECT session_id, idx, place, content, tokens, target, CASE WHEN length(content) >= 5 THEN list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: length(w) > 3)) END AS w FROM src),
du AS (SELECT a.session_id, a.idx, bool_or(len(list_intersect(a.w, b.w)) / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0)::DOUBLE > 0.7) AS dup FROM wd a JOIN wd b ON a.session_id = b.session_id AND b.place BETWEEN a.place - 10 AND a.place - 1 GROUP BY 1, 2),
sc AS MATERIALIZED (SELECT wd.*, CASE WHEN length(content) < 5 THEN 0 ELSE ({_IMP}) - CASE WHEN coalesce(dup, false) THEN 20 ELSE 0 END END AS score, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) <= {MIN_KEEP} AS fresh FROM wd LEFT JOIN du USING (session_id, idx)),
od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, idx) AS r FROM sc WHERE NOT fresh),
fl AS (SELECT session_id, CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS idx, false AS kept, CAST(sum(tokens) AS BIGINT) AS used FROM sc WHERE fresh GROUP BY 1
 UNION ALL SELECT fl.session_id, od.r, od.idx, used + tokens <= target, CAST(CASE WHEN used + tokens <= target THEN used + tokens ELSE used END AS BIGINT) FROM fl JOIN od ON od.session_id = fl.session_id AND od.r = fl.r + 1),
kp AS MATERIALIZED (SELECT session_id, idx, kept FROM fl WHERE r > 0 UNION ALL SELECT session_id, idx, true FROM sc WHERE fresh),
tp AS (SELECT session_id, k, i, min(idx) AS fst FROM src, (SELECT unnest({_SEEN(tx.TOPICS)}) AS k, unnest(range({len(tx.TOPICS)})) AS i) WHERE contains(lower(content), lower(k)) GROUP BY 1, 2, 3),
tl AS (SELECT session_id, string_agg(k, ',' ORDER BY fst, i) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY fst, i) AS r FROM tp) WHERE r <= 15 GROUP BY 1),
se AS (SELECT session_id, idx, unnest(p) AS s, unnest(range(len(p))) AS i FROM (SELECT session_id, idx, regexp_split_to_array(content, '[.!?\\n]+') AS p FROM src)),
de AS (SELECT session_id, string_agg('"' || substring(trim(s), 1, 150) || '"', ';' ORDER BY idx, i) AS decided FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx, i) AS r FROM se WHERE {_DECIDED} AND length(trim(s)) > 10) WHERE r <= 5 GROUP BY 1),
en AS (SELECT session_id, lower(e) AS e, min((idx, p, j)) AS fst FROM ({_ENTITIES}) GROUP BY 1, 2),
el AS (SELECT session_id, string_agg(e, ',' ORDER BY fst) AS named FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY fst) AS r FROM en) WHERE r <= 8 GROUP BY 1),
su AS (SELECT session_id, '[Compacted History - ' || count(*) FILTER (NOT kept) || ' msgs] | Topics: ' || coalesce(max(topics), 'general discussion') || coalesce(' | decisions: ' || max(decided), '') || coalesce(' | entities: ' || max(named), '') AS summary FROM kp LEFT JOIN tl USING (session_id) LEFT JOIN de USING (session_id) LEFT JOIN el USING (session_id) GROUP BY 1)"""
_VERDICT = f""",
ag AS (SELECT session_id, count(*) FILTER (NOT kept) AS gone, coalesce(sum(tokens) FILTER (kept), 0) AS ktok FROM src JOIN kp USING (session_id, idx) GROUP BY 1),
vd AS (SELECT session_id, n, n_derived, target, coalesce(gone > {TOO_FEW}, false) AS compacted, gone, before, dtok, ktok, summary FROM ses LEFT JOIN ag USING (session_id) LEFT JOIN su USING (session_id)),
ve AS MATERIALIZED (SELECT session_id, n, n_derived, target, compacted,
 CASE WHEN n = 0 THEN 'no messages to compact' WHEN gone IS NULL THEN 'already under target (' || before || ' <= ' || target || ')' WHEN NOT compacted THEN 'too few messages to remove (' || gone || ')' END AS reason,
 CASE WHEN compacted THEN gone ELSE 0 END AS removed, CAST(before AS BIGINT) AS tokens_before, CAST(CASE WHEN compacted THEN ktok + {TOKENS.format("summary")} + dtok ELSE before END AS BIGINT) AS tokens_after, CASE WHEN compacted THEN summary ELSE '' END AS summary FROM vd)
"""


@query(f"WITH {_SOURCE}{_RECENT}{_VERDICT}SELECT * FROM ve")
def k2_compact_recent(spark, d):
    return _compacted(spark, d, "recent").sessions


@query(f"WITH {_SOURCE}{_SEMANTIC}{_VERDICT}SELECT * FROM ve")
def k2_compact_semantic(spark, d):
    return _compacted(spark, d, "semantic").sessions


@query(f"""WITH {_SOURCE}{_SEMANTIC}{_VERDICT}SELECT session_id, 1 AS part, NULL::BIGINT AS idx, 'user' AS role, summary AS content FROM ve WHERE compacted
UNION ALL SELECT session_id, CASE WHEN derived THEN 0 ELSE 2 END, idx, role, content FROM al JOIN ve USING (session_id) LEFT JOIN kp USING (session_id, idx) WHERE derived OR NOT compacted OR kept""")
def k2_compacted_messages(spark, d):
    return _compacted(spark, d, "semantic").messages
