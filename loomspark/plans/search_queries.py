"""Queries of the stored search index: the same rows as a scan, filtered search, and fusion with vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lineage import scratch
from ..operators.search_index import SearchIndex, fuse, nearest
from ..sources import tables as t
from .queries import query

_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _bm25(k: int, where: str = "true", name: str = "r") -> str:
    """CTEs of the k best items of each query; filters take items away, the counts stay those of all."""
    return f"""i AS (SELECT doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
t AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM i) GROUP BY 1, 2), s AS (SELECT id, CAST(sum(tf) AS DOUBLE) AS len FROM t GROUP BY 1),
c AS (SELECT count(*) AS n, avg(len) AS a FROM s), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format("text")}) AS term FROM benchmark),
h AS (SELECT q.query_id, t.id, round(sum(ln(1 + (c.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * t.tf * 2.2::DOUBLE / (t.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * s.len / c.a))), 6) AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN s ON s.id = t.id, c WHERE t.id IN (SELECT doc_id FROM documents WHERE {where}) GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h) WHERE rank <= {k})"""


def _index(spark, d, *attrs: str) -> SearchIndex:
    m = t.load(spark, d, "documents")
    items = m.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("kind"), F.pmod(F.col("doc_id") * 7, F.lit(400)).alias("age_hours"))
    return SearchIndex(spark, scratch(spark, "index"), attrs).build(items)


def _queries(spark, d):
    return t.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {_bm25(5)} SELECT query_id, id, round(score, 4) AS score, rank FROM r")
def a4_index_search(spark, d):
    return _index(spark, d).search(_queries(spark, d), k=5).withColumn("score", F.round("score", 4))


_WHERE = "lang IN ('en', 'de') AND doc_id * 7 % 400 <= 250"


@query(f"WITH {_bm25(5, _WHERE)} SELECT query_id, id, round(score, 4) AS score, rank FROM r")
def a4_filtered_search(spark, d):
    index = _index(spark, d, "kind", "age_hours")
    return index.search(_queries(spark, d), k=5, where=lambda e: e["kind"].isin("en", "de") & (e["age_hours"] <= 250)).withColumn("score", F.round("score", 4))


@query(
    f"""WITH {_bm25(10, name="lex")},
v AS (SELECT vec_id AS id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS size FROM embeddings),
n AS (SELECT a.id AS query_id, b.id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (a.size * b.size), 6) AS score FROM v a, v b WHERE a.id IN (SELECT item_id FROM benchmark) AND a.size > 0 AND b.size > 0),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM n) WHERE rank <= 10),
u AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM lex UNION ALL SELECT query_id, id, rank FROM vec) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u) WHERE rank <= 5"""
)
def a4_hybrid_search(spark, d):
    q, e = _queries(spark, d), t.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = nearest(e.withColumnRenamed("id", "query_id").join(q.select("query_id").distinct(), "query_id", "left_semi"), e, k=10)
    return fuse([_index(spark, d).search(q, k=10), near], k=5)
