"""Entity graphs, diffs, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, stash


def cooccurrence(mentions: DataFrame, unit: list[str], entity: str = "entity", session: str = "session_id") -> DataFrame:
    """(a, b, n, sessions) of unordered pairs that one message names; messages name a few entities, so pairs stay few."""
    x = mentions.select(*unit, entity).distinct()
    l, r = x.withColumnRenamed(entity, "a"), x.withColumnRenamed(entity, "b")
    return l.join(r, unit).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(session).alias("sessions"))


def related(mentions: DataFrame, edges: DataFrame, entity: str) -> DataFrame:
    """Mentions of an entity and of those that occur with it, one for each entity and session, the last."""
    near = edges.filter((F.col("a") == entity) | (F.col("b") == entity)).select(F.when(F.col("a") == entity, F.col("b")).otherwise(F.col("a")).alias("entity"))
    wanted = near.union(mentions.sparkSession.createDataFrame([(entity,)], "entity string")).distinct()
    return mentions.join(wanted, "entity", "left_semi").groupBy("entity", "session_id").agg(F.max("idx").alias("last_idx"))


def cross_session(mentions: DataFrame, entity: str = "entity", least: int = 2) -> DataFrame:
    """Entities that several sessions name."""
    return mentions.groupBy(entity).agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("mentions")).filter(F.col("sessions") >= least)


def dependency_chain(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """E5: (session_id, entity, depth): entities reached from each session's first one along session-local edges (session_id, a, b), by depth.

    Frontiers are followed to the fixed point, or ``most`` steps if given; each round
    joins the frontier alone and leaves out what has been visited.
    """
    both = cut(edges.select(F.col("session_id").alias("_s"), F.col("a").alias("_a"), F.col("b").alias("_b")).union(edges.select("session_id", "b", "a")).distinct())
    reached = start.select("session_id", "entity", F.lit(0).alias("depth"))
    frontier, d = reached, 0
    while most is None or d < most:
        d += 1
        step = frontier.join(both, (F.col("session_id") == F.col("_s")) & (F.col("entity") == F.col("_a"))).select("session_id", F.col("_b").alias("entity")).distinct()
        new = cut(step.join(reached, ["session_id", "entity"], "left_anti").withColumn("depth", F.lit(d)))
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        if d % 20 == 0:  # a long chain must not make a long plan
            reached = cut(reached)
        frontier = new
    return reached


#: Mentions beyond which a session is dealt out by entity and by message while it is walked; smaller ones stay together.
WIDE = 500_000
#: Rows up to which a list is sent to all tasks instead of shuffled with what it selects from.
SENT = 200_000
#: Mentions that a task walks at a time, most (but for wider sessions), so that it sorts them in memory.
SHARE = 1_000_000
#: Steps of the first walk and of later ones, most.
STEPS, MOST_STEPS = 2, 8


def _of(df: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose keys are among a few."""
    return df.join(F.broadcast(few) if few.count() <= SENT else few, by, "left_semi")


def _rows(mentions: DataFrame, seeds: DataFrame, unit: list[str], order: str) -> DataFrame:
    """Mentions without depth, and the seeds (session_id, entity, depth) as rows without a message."""
    keep = list(dict.fromkeys([*unit, order]))
    null = lambda c: F.lit(None).cast(mentions.schema[c].dataType).alias(c)
    start = seeds.select(*["session_id" if c == "session_id" else null(c) for c in keep], "entity", "depth")
    return mentions.select(*keep, "entity", F.lit(None).cast("int").alias("depth")).unionByName(start)


def _walk(x: DataFrame, unit: list[str], order: str, steps: int) -> DataFrame:
    """(session_id, place, entity, depth, strength, _n, _pairs, _near, _go): so many steps on from the rows that have a depth.

    A step takes depths from entities to the messages that name them and back, so no
    pair is made. ``_go``: the session has messages that the next step would reach.
    ``_pairs`` is twice the number of pairs of which one is named by a single message;
    others may be met again, and an entity has ``_near`` - 1 different ones at least.
    The strength is null where that doesn't tell it.
    """
    x = x.groupBy(*unit, "entity").agg(F.min(order).alias("_at"), F.min("depth").alias("depth"))
    of_message, of_entity, of_session = Window.partitionBy(*unit), Window.partitionBy("session_id", "entity"), Window.partitionBy("session_id")
    real = F.lit(True)  # a missing key joins nothing; the seeds have no message
    for c in unit:
        real = real & F.col(c).isNotNull()
    x = x.withColumns({"depth": F.min("depth").over(of_entity), "_in": F.count(F.when(real, 1)).over(of_entity)})
    shared = F.col("_in") > 1
    for k in range(steps):
        sizes = {} if k else {"_size": F.count(F.lit(1)).over(of_message), "_shared": F.count(F.when(shared, 1)).over(of_message)}
        x = x.withColumns({"_d": F.when(real, F.min("depth").over(of_message)), **sizes})
        x = x.withColumn("depth", F.coalesce("depth", F.min(F.col("_d") + 1).over(of_entity)))
    pairs = F.col("_size") - 1 - F.when(shared, F.col("_shared") - 1).otherwise(0)
    g = x.groupBy("session_id", "entity").agg(
        F.min("_at").alias("_at"), F.min("depth").alias("depth"), F.sum(F.when(real, pairs)).alias("_pairs"), F.max(F.when(real & shared, F.col("_shared"))).alias("_near"),
        F.max(real & F.col("_d").isNull() & F.col("depth").isNotNull()).alias("_go"),
    )
    reached = lambda c: F.coalesce(F.sum(F.when(F.col("depth").isNotNull(), c)).over(of_session), F.lit(0))
    g = g.withColumns({
        "place": F.row_number().over(of_session.orderBy(F.asc_nulls_last("depth"), F.asc_nulls_last("_at"), "entity")), "_n": F.count(F.lit(1)).over(of_session), "_go": F.max("_go").over(of_session),
        "_pairs": reached(F.col("_pairs")), "_more": reached(F.col("_near") - 1),
    })
    n = 2 * F.col("_n")
    strength = F.when(F.col("_n") < 2, 0.0).when(F.col("_pairs") + F.col("_more") >= n, 1.0).when(F.col("_more") == 0, F.col("_pairs") / n)
    return g.filter(~F.col("_go") | F.col("depth").isNotNull()).select("session_id", "place", "entity", "depth", F.round(strength, 6).alias("strength"), "_n", "_pairs", "_near", "_go")


def _shared_pairs(mentions: DataFrame, shared: DataFrame, unit: list[str]) -> DataFrame:
    """(session_id, _hits): the different pairs of a session's shared entities; messages that name the same ones are taken once."""
    x = _of(mentions.dropna(subset=unit), shared, ["session_id", "entity"])
    names = x.groupBy(*unit).agg(F.sort_array(F.collect_set("entity")).alias("names")).filter(F.size("names") > 1).select("session_id", "names").distinct()
    a = names.select("session_id", "names", F.posexplode("names").alias("_i", "a"))
    pairs = a.select("session_id", "a", F.explode(F.slice("names", F.col("_i") + 2, F.size("names"))).alias("b")).distinct()
    return pairs.groupBy("session_id").agg(F.count(F.lit(1)).alias("_hits"))


def dependency_chains(mentions: DataFrame, unit: list[str], order: str = "idx") -> DataFrame:
    """E5: (session_id, place, entity, depth, strength): the whole chain of each session.

    First what co-occurrence reaches from the session's first entity, by depth and
    first mention; then the session's other entities (depth null). The strength is the
    number of pairs among what was reached to the length of the chain, 1 at most, and 0
    for a session of one entity. A walk meets each pair once, so pairs are its hits.

    Pairs are made for no walk, and counted one by one only where sizes of messages
    don't tell the strength. Mentions are shuffled by session once; sessions that need
    more steps go on by themselves.
    """
    spark, keep = mentions.sparkSession, list(dict.fromkeys([*unit, order, "entity"]))
    m = stash(mentions.select(*keep), "mentions")
    first = F.min_by("entity", F.struct(F.col(order).isNull().alias("_none"), F.col(order).alias("_at"), "entity"))
    sessions = stash(m.groupBy("session_id").agg(first.alias("entity"), F.count(F.lit(1)).alias("_m")), "sessions")
    wide = sessions.filter(F.col("_m") > WIDE).select("session_id")
    some_wide = not wide.isEmpty()
    seeds = sessions.filter("session_id IS NOT NULL").select("session_id", "entity", F.lit(0).alias("depth"))
    named = lambda x: x.agg(F.coalesce(F.sum("_m"), F.lit(0))).first()[0]
    base, left, steps, ended = m, m, STEPS, []
    n_base = n = named(sessions)
    while True:
        x = _rows(left, seeds, unit, order)
        parts = [x.join(F.broadcast(wide), "session_id", "left_anti"), x.join(F.broadcast(wide), "session_id", "left_semi")] if some_wide else [x]
        shares = n // SHARE + 1
        alike = parts[0].repartition(shares, "session_id") if shares > spark.sparkContext.defaultParallelism else parts[0].repartition("session_id")
        walked = _walk(alike, unit, order, steps)
        walked = stash(walked.unionByName(_walk(parts[1], unit, order, steps)) if some_wide else walked, "chains")
        ended.append(walked.filter(~F.col("_go")))
        seeds = walked.filter("_go").select("session_id", "entity", "depth")
        going = seeds.select("session_id").distinct()
        n = named(_of(sessions, going, ["session_id"]))
        if not n:
            break
        left = _of(base, going, ["session_id"])
        if 2 * n <= n_base:  # the others' mentions need not be read again
            base, n_base = stash(left, "mentions"), n
            left = base
        steps = min(2 * steps, MOST_STEPS)
    chain = ended[0]
    for x in ended[1:]:
        chain = chain.unionByName(x)
    out = ["session_id", "place", "entity", "depth", "strength"]
    unsure = chain.filter("strength IS NULL")
    if unsure.isEmpty():
        return chain.select(*out)
    hits = _shared_pairs(m, unsure.filter("depth IS NOT NULL AND _near > 1").select("session_id", "entity"), unit)
    strength = F.least(F.lit(1.0), (F.col("_pairs") + 2 * F.coalesce("_hits", F.lit(0))) / (2 * F.col("_n")))
    unsure = unsure.join(hits, "session_id", "left").withColumn("strength", F.round(strength, 6))
    return chain.filter("strength IS NOT NULL").select(*out).unionByName(unsure.select(*out))


def snapshot_diff(old: DataFrame, new: DataFrame, by: list[str], content: str = "content", score: str = "score") -> DataFrame:
    """(by..., key, change) by a full outer join on the first 40 characters, trimmed and lower-cased."""
    key = F.lower(F.trim(F.substring(content, 1, 40)))
    side = lambda df, s: df.select(*by, key.alias("key"), F.col(score).alias(s)).groupBy(*by, "key").agg(F.max(s).alias(s))
    x = side(old, "a").join(side(new, "b"), [*by, "key"], "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.abs(F.col("a") - F.col("b")) > 0.01, "modified").otherwise("unchanged")
    return x.select(*by, "key", change.alias("change"))


def stability(diff: DataFrame, by: list[str]) -> DataFrame:
    """counts of changes and the share of unchanged keys."""
    n = F.count(F.lit(1))
    return diff.groupBy(*by).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "deleted", "modified", "unchanged")], F.round(F.count_if(F.col("change") == "unchanged") / n, 6).alias("stability"))


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str, confidence: str, rest: list[str]) -> DataFrame:
    """Merged by normalized key: the newer row's fields, the larger confidence, the older place."""
    x = old.unionByName(new).withColumn("_k", F.lower(F.trim(key)))
    return x.groupBy("_k").agg(F.max(confidence).alias(confidence), F.max_by(F.struct(*rest), seq).alias("_r"), F.min(seq).alias("first_seq")).select(F.col("_k").alias("key"), confidence, "first_seq", *[F.col(f"_r.{c}").alias(c) for c in rest])


def frequent(history: DataFrame, task: str, key: str, k: int) -> DataFrame:
    """The most frequent keys of each task and their confidence, 0.95 at most."""
    g = history.groupBy(task, key).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(task)
    g = g.withColumn("confidence", F.least(F.lit(0.95), F.col("n") / F.sum("n").over(w))).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), key)))
    return g.filter(F.col("rank") <= k)


def union_predictions(parts: list[DataFrame], by: list[str], key: str = "key", k: int = 10) -> DataFrame:
    """H1: predictions (by..., key, confidence) of several sources: of a key's the first source's counts, then the k most confident."""
    out = None
    for rank, p in enumerate(parts):
        x = p.select(*by, key, "confidence", F.lit(rank).alias("_s"))
        out = x if out is None else out.unionByName(x)
    g = out.groupBy(*by, key).agg(F.min_by("confidence", "_s").alias("confidence"), F.min("_s").alias("source"))
    w = Window.partitionBy(*by).orderBy(F.desc("confidence"), key)
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
