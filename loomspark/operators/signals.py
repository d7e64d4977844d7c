"""Signals, roles and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
ROLE_PRIORITY = {"authority": 1, "constraint": 2, "rubric": 3, "exemplar": 4, "metadata": 5}
ROLES = {"governance": "authority", "constitution": "authority", "rl": "exemplar", "ci": "constraint", "crossdomain": "constraint", "drift": "rubric"}
DOMAINS = (("memory", r"(?i)memory|mem_"), ("governance", r"(?i)governance|gov_|policy|rule"), ("ci", r"(?i)ci_|pipeline|deploy|workflow"), ("cross-domain", r"(?i)cross_domain|pillar"), ("session", r"(?i)session|conversation"))
# ------------------------------------------------------------------------------


def domain(source: Column) -> Column:
    """Struct of domain and confidence; the first pattern that matches."""
    out = F.lit("unknown")
    for name, p in reversed(DOMAINS):
        out = F.when(source.rlike(p), name).otherwise(out)
    return F.struct(out.alias("domain"), F.when(out == "unknown", 0.3).otherwise(0.9).alias("confidence"))


def fusion(signals: DataFrame, by: list[str]) -> DataFrame:
    """For each group, whether each pair of domains asks for a recommendation, and the tokens of all contents."""
    x = signals.withColumn("_d", domain(F.col("source"))["domain"])
    has = lambda d: F.bool_or(F.col("_d") == d)
    g = x.groupBy(*by).agg(has("governance").alias("g"), has("ci").alias("c"), has("memory").alias("m"), has("session").alias("s"), has("cross-domain").alias("x"), F.sum(F.ceil(F.char_length("content") / 4)).alias("tokens"))
    return g.select(*by, (F.col("g") & F.col("c")).alias("compliance_check"), (F.col("m") & F.col("s")).alias("inject_history"), (F.col("x") & F.col("m")).alias("correlate"), "tokens")


def role(source: Column, overrides: dict[str, str] | None = None) -> Column:
    """The role of a source; unknown ones are metadata."""
    out = F.lit("metadata")
    for s, r in (ROLES | (overrides or {})).items():
        out = F.when(source == s, r).otherwise(out)
    return out


def priority(role_: Column) -> Column:
    out = F.lit(5)
    for r, p in ROLE_PRIORITY.items():
        out = F.when(role_ == r, p).otherwise(out)
    return out


def assemble(hints: DataFrame, by: list[str], block: str = "block", idx: str = "idx") -> DataFrame:
    """The blocks of each group by priority, then place, joined by a blank line; empty ones are left out."""
    g = hints.filter(F.col(block) != "").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("priority", idx, block))).alias("l"))
    return g.select(*by, F.array_join(F.transform("l", lambda r: r[block]), "\n\n").alias("text"))


def topics(text: Column, stop: tuple[str, ...] = ("the", "and", "for", "with", "that", "this", "are", "was", "is", "to", "of", "in", "on", "a", "an")) -> Column:
    """Distinct words of letters and digits, two characters at least."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: (F.char_length(w) >= 2) & ~w.isin(*stop)))


def conflicts(hints: DataFrame, by: list[str], block: str = "block", idx: str = "idx") -> DataFrame:
    """Pairs of blocks of different priority with a common topic: the first of the earlier block; the higher priority wins."""
    x = hints.withColumn("t", topics(F.col(block)))
    a = x.select(*by, *[F.col(c).alias(f"a_{c}") for c in (idx, "role", "priority", "source", "t")])
    b = x.select(*by, *[F.col(c).alias(f"b_{c}") for c in (idx, "role", "priority", "source", "t")])
    j = a.join(b, by).filter((F.col(f"a_{idx}") < F.col(f"b_{idx}")) & (F.col("a_priority") != F.col("b_priority")))
    j = j.withColumn("topic", F.get(F.array_intersect("a_t", "b_t"), F.lit(0))).filter(F.col("topic").isNotNull())
    high = F.col("a_priority") < F.col("b_priority")
    pick = lambda c, h: F.when(h, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    return j.select(*by, f"a_{idx}", f"b_{idx}", "topic", pick("source", high).alias("high_source"), pick("source", ~high).alias("low_source"), pick("role", high).alias("resolved"))


def role_breakdown(hints: DataFrame, by: list[str]) -> DataFrame:
    """rows of each role, zeros included."""
    return hints.groupBy(*by).agg(*[F.count_if(F.col("role") == r).alias(r) for r in ROLE_PRIORITY], F.count(F.lit(1)).alias("total"))


def ci_first(signals: DataFrame, by: list[str], failed: Column, at: str = "at", tie: str = "id", limit: int = 5) -> DataFrame:
    """Failures first, then the newest."""
    w = Window.partitionBy(*by).orderBy(F.when(failed, 0).otherwise(1), F.desc(at), tie)
    return signals.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def cross_domain(signals: DataFrame, by: list[str], pillar: str, now: int, hours: int = 6, limit: int = 3) -> DataFrame:
    """Other pillars' signals within the hours, by correlation."""
    x = signals.filter((F.lower("source") != pillar.lower()) & (F.col("at") >= now - hours * 3_600_000) & (F.col("at") <= now))
    w = Window.partitionBy(*by).orderBy(F.desc("conf"), "id")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def domain_weights(signals: DataFrame, by: list[str], default: float = 1.0) -> DataFrame:
    """F16: mean confidence of each domain times its default weight."""
    return signals.withColumn("domain", domain(F.col("source"))["domain"]).groupBy(*by, "domain").agg(F.round(F.avg("conf") * default, 6).alias("weight"), F.count(F.lit(1)).alias("n"))


def relative_time(at: Column, now: Column) -> Column:
    """How long ago, in minutes, hours or days."""
    m = F.floor((now - at) / 60_000)
    return F.when(m < 1, "just now").when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit("d ago")))
