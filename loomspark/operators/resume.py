"""Session resume: buckets, consolidation, freshness, coverage, redundancy, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard

DAY = 86_400_000
STOP = "the a an is are was were to of in for on with at by from as that this it be has have do does did will would can could should may might not no yes but or and if so about".split()


def latest_per_session(df: DataFrame, session: str = "session_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last row of each session; of equal times the first."""
    w = Window.partitionBy(session).orderBy(F.desc(ts), tie)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def time_buckets(df: DataFrame, now: int, by: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds ``bucket``: the three newest are recent, the rest this_week (7 days) or older (30 days); what is older still goes."""
    w = Window.partitionBy(*by).orderBy(F.desc(ts), tie)
    age = (F.lit(now) - F.col(ts)) / DAY
    bucket = F.when(F.row_number().over(w) <= 3, "recent").when(age <= 7, "this_week").when(age <= 30, "older")
    return df.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull())


def greedy_distinct(points: Column, threshold: float = 0.7, most: int | None = None) -> Column:
    """an array of texts without those like an earlier kept one (Jaccard of words of more than two letters)."""
    words = lambda p: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(p), r"[^\w\s]", " "), r"\s+"), lambda w: F.char_length(w) > 2))
    zero = F.expr("cast(array() as array<string>)")
    out = F.aggregate(points, zero, lambda kept, p: F.when(F.exists(kept, lambda k: jaccard(words(k), words(p)) > threshold), kept).otherwise(F.concat(kept, F.array(p))))
    return F.slice(out, 1, most) if most else out


def daily_merge(df: DataFrame, by: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """F8: by day (UTC): themes joined, near-equal points dropped (ten at most), tasks and entities distinct, messages summed."""
    day = F.floor(F.col(ts) / DAY)
    g = df.withColumn("day", day).groupBy(*by, "day").agg(F.array_sort(F.collect_list(F.struct(ts, tie, "theme", "key_points", "tasks", "entities"))).alias("rows"), F.min(ts).alias("ts"), F.sum("n_messages").alias("n_messages"))
    flat = lambda c: F.flatten(F.transform("rows", lambda r: r[c]))
    return g.select(*by, "day", F.array_join(F.transform("rows", lambda r: r["theme"]), "; ").alias("theme"), greedy_distinct(flat("key_points"), most=10).alias("key_points"), F.array_distinct(flat("tasks")).alias("tasks"), F.array_distinct(flat("entities")).alias("entities"), "ts", "n_messages")


def top_words(df: DataFrame, by: list[str], text: str, n: int) -> DataFrame:
    """(by..., word, n, rank): the most frequent words, of equals the first in order."""
    x = df.select(*by, F.explode(F.split(F.lower(text), r"\s+")).alias("word")).filter((F.col("word") != "") & ~F.col("word").isin(STOP))
    x = x.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= n)


def freshness(df: DataFrame, by: list[str], now: int, ts: str = "ts", hours: float = 24.0, digits: int | None = 6) -> DataFrame:
    """Mean of exp(-age / hours), rounded unless ``digits`` is None; a missing or future time counts 1."""
    age = (F.lit(now) - F.col(ts)) / 3_600_000
    mean = F.avg(F.when(F.col(ts).isNull() | (age < 0), 1.0).otherwise(F.exp(-age / hours)))
    return df.groupBy(*by).agg((mean if digits is None else F.round(mean, digits)).alias("freshness"))


def timeline(df: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """Span of each group in whole days, or hours if under a day."""
    span = F.max(ts) - F.min(ts)
    g = df.groupBy(*by).agg(span.alias("span"))
    return g.select(*by, F.when(F.col("span") >= DAY, F.concat(F.floor(F.col("span") / DAY + 0.5).cast("string"), F.lit(" days"))).otherwise(F.concat(F.floor(F.col("span") / 3_600_000 + 0.5).cast("string"), F.lit(" hours"))).alias("timeline"))


def coverage(query: Column, context: Column, stop: list[str] = STOP) -> Column:
    """Share of the query's keywords that the context holds; 1 without keywords."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(query), r"[^\w\s]", " "), r"\s+"), lambda w: (F.char_length(w) >= 2) & ~w.isin(stop)))
    hit = F.filter(words, lambda w: F.contains(F.lower(context), w))
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(hit) / F.size(words))


def adjacent_similarity(df: DataFrame, by: list[str], order: list[Column], points: str = "key_points") -> DataFrame:
    """Adds ``similarity`` of a row's points and the next row's; both empty 1, none next null."""
    low = lambda c: F.array_distinct(F.transform(c, F.lower))
    nxt = F.lead(points).over(Window.partitionBy(*by).orderBy(*order))
    a, b = low(F.col(points)), low(nxt)
    return df.withColumn("similarity", F.when(nxt.isNull(), None).when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(jaccard(a, b)))


def duplicate_lines(text: Column) -> Column:
    """H3: lines that equal an earlier one, without regard to case and outer blanks."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


def open_items(files: Column, ids: Column) -> Column:
    """H2: distinct files and ids, without those that are the end of a longer one."""
    items = F.array_distinct(F.concat(files, ids))
    return F.filter(items, lambda x: ~F.exists(items, lambda y: (y != x) & F.endswith(y, F.concat(F.lit("/"), x))))


def context_quality(cov: Column, redundancy: Column, fresh: Column) -> Column:
    """Struct of the weighted score and its grade."""
    s = F.round(0.4 * cov + 0.35 * redundancy + 0.25 * fresh, 6)
    return F.struct(s.alias("score"), F.when(s >= 0.7, "good").when(s >= 0.4, "acceptable").otherwise("poor").alias("grade"))


def expansion_k(k: Column, round_: Column) -> Column:
    """How many hits the expansion rounds ask for: twice, then three times."""
    return F.when(round_ <= 0, k).when(round_ == 1, k * 2).otherwise(k * 3)


def checkpoint_record(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """K8: (by..., topics, tasks, entities) of a session's newest rows: three themes, five tasks, five entities."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumn("_r", F.row_number().over(w))
    g = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", "theme", "tasks", "entities"))).alias("rows"))
    flat = lambda c: F.array_distinct(F.flatten(F.transform("rows", lambda r: r[c])))
    return g.select(*by, F.slice(F.array_distinct(F.transform("rows", lambda r: r["theme"])), 1, 3).alias("topics"), F.slice(flat("tasks"), 1, 5).alias("tasks"), F.slice(flat("entities"), 1, 5).alias("entities"))


def history_block(df: DataFrame, by: list[str], now: int, max_age_hours: int = 72, most: int = 5) -> DataFrame:
    """K4, K6: the text block of the newest summaries of each group within the age, newest first."""
    x = df.filter((F.lit(now) - F.col("ts")) <= max_age_hours * 3_600_000)
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), "event_id")
    x = x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    line = F.concat(F.lit("- "), F.col("theme"), F.lit(" ("), F.col("n_messages").cast("string"), F.lit(" messages)"))
    g = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("line")))).alias("l"))
    return g.select(*by, F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("block"), F.size("l").cast("long").alias("entries"))
