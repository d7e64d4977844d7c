"""Queries of whole dependency chains and of digest rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import digest, digest_text, graph
from ..sources import tables as t
from .queries import query

#: Tokens of a digest; small, so that capacity is met by many sessions.
CAPACITY = 120
_ENTITIES = "list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^a-z]+'), lambda w: length(w) >= 7)"


def _named(spark, d) -> DataFrame:
    """Words of seven letters and more, as the entities that a message names."""
    words = F.filter(F.split(F.lower(F.coalesce("content", F.lit(""))), "[^a-z]+"), lambda w: F.length(w) >= 7)
    return t.messages(spark, d).select("session_id", "idx", F.explode(F.array_distinct(words)).alias("entity"))


@query(
    f"""WITH RECURSIVE {t.SQL["messages"]}, m AS MATERIALIZED (SELECT DISTINCT session_id, idx, unnest({_ENTITIES}) AS entity FROM messages),
fi AS (SELECT session_id, entity, min(idx) AS at0 FROM m GROUP BY 1, 2),
e AS MATERIALIZED (SELECT DISTINCT a.session_id, a.entity AS a, b.entity AS b FROM m a JOIN m b USING (session_id, idx) WHERE a.entity < b.entity),
both_ AS MATERIALIZED (SELECT session_id, a, b FROM e UNION ALL SELECT session_id, b, a FROM e),
w AS (SELECT session_id, 0 AS depth, [arg_min(entity, {{'i': at0, 'e': entity}})] AS new, [arg_min(entity, {{'i': at0, 'e': entity}})] AS seen FROM fi GROUP BY 1
 UNION ALL SELECT w.session_id, w.depth + 1, list(DISTINCT b), list_concat(any_value(w.seen), list(DISTINCT b)) FROM w JOIN both_ x ON x.session_id = w.session_id AND list_contains(w.new, x.a) AND NOT list_contains(w.seen, x.b) GROUP BY w.session_id, w.depth),
r AS (SELECT session_id, unnest(new) AS entity, depth FROM w),
h AS (SELECT e.session_id, count(*) AS hits FROM e JOIN r ON r.session_id = e.session_id AND r.entity = e.a GROUP BY 1)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY depth NULLS LAST, at0, entity) AS place, entity, depth,
 round(CASE WHEN count(*) OVER (PARTITION BY session_id) < 2 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, coalesce(hits, 0) / (count(*) OVER (PARTITION BY session_id))::DOUBLE) END, 6) AS strength
FROM fi LEFT JOIN r USING (session_id, entity) LEFT JOIN h USING (session_id)"""
)
def e5_whole_chains(spark, d):
    return graph.dependency_chains(_named(spark, d), ["session_id", "idx"])


def _entries(messages: DataFrame, round_: int) -> DataFrame:
    """Digest entries of messages: views and claims with their sources."""
    s = digest.sentences(messages)
    of = lambda x, section, head, tail, note, kind: x.select(
        F.col("session_id").cast("string").alias("session_id"), F.lit(section).alias("section"), (F.col("idx") * 1000 + F.col("pos")).cast("long").alias("seq"), head.alias("head"), tail.cast("string").alias("tail"), note.cast("string").alias("note"),
        F.concat(F.lit("m"), F.col("idx").cast("string")).alias("msg_id"), F.substring("sentence", 1, digest_text.SNIPPET_CHARS).alias("snippet"), F.col("confidence").cast("double").alias("confidence"), F.lit(round_).cast("long").alias("round"), kind.cast("string").alias("kind"), F.lit(None).cast("long").alias("n"),
    )
    null, text = F.lit(None), F.col("sentence")
    confirmed = digest.confirmed(s)
    pits = digest.pitfalls(s).withColumn("confidence", F.lit(0.75))
    found = digest.claims(s, ["session_id"], ["idx"])
    kind = F.when(digest.any_of(text, digest.REJECTED), "rejected").when(digest.like(text, digest.PENDING), "pending").when(digest.like(text, digest.NEGATIVE), "pitfall").when(digest.any_of(text, digest.CONFIRMED), "fact").otherwise("other")
    parts = [of(confirmed, "confirmed", text, null, null, null), of(pits, "pitfalls", F.col("symbol"), text, F.nullif(F.col("workaround"), F.lit("")), null), of(found, "claim", F.substring("sentence", 1, 120), F.col("span"), null, kind)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(None)
def i21_digest_rounds(spark, d):
    """Two rounds: the first two turns' digest as text, then the others merged with what is read back from it."""
    m = t.messages(spark, d)
    first = digest_text.render(digest_text.truncate(_entries(m.filter("idx < 2"), 1), CAPACITY))
    return digest_text.next_round(first, _entries(m.filter("idx >= 2"), 2), CAPACITY)
