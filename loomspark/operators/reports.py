"""Reports: compaction quality, strategy feedback, health, drift, predictions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import budget
from ..functions.text import ACTION_WORDS, STATE_WORDS, has_words
from . import fold

OUTCOMES = ("pass", "rejected", "degraded", "notMeasured")


def compaction_quality(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(samples, proactive rate, missing state and action in percent, outcomes, violation rate, window) of records (at, trigger, summary, consistency)."""
    n = F.count(F.lit(1))
    pct = lambda c: F.floor(F.count_if(c) * 10000 / n + 0.5) / 100
    return records.groupBy(*(by or [])).agg(
        n.alias("samples"), F.round(F.count_if(F.col("trigger") == "auto") / n, 6).alias("proactive_rate"), pct(~has_words(F.col("summary"), STATE_WORDS)).alias("missing_state_pct"), pct(~has_words(F.col("summary"), ACTION_WORDS)).alias("missing_action_pct"),
        *[F.count_if(F.col("consistency") == o).alias(o) for o in OUTCOMES], F.round(F.count_if(F.col("consistency").isin("rejected", "degraded")) / n, 6).alias("violation_rate"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )


def waste(after: Column, target: Column, before: Column, threshold: Column) -> Column:
    """struct of the miss of the target, as a share of it, and the tokens over the threshold when it fired."""
    return F.struct((F.abs(after - target) / target).alias("delta_rate"), (before - threshold).alias("trigger_gap"))


def strategy_feedback(rewards: DataFrame, by: str = "strategy") -> DataFrame:
    """uses, wins and mean reward of each strategy, and the exploration rate after all uses."""
    g = rewards.groupBy(by).agg(F.count(F.lit(1)).alias("uses"), F.count_if(F.col("reward") > 0.5).alias("wins"), F.round(F.avg("reward"), 6).alias("mean_reward"))
    total = F.sum("uses").over(Window.partitionBy(F.lit(0)))
    return g.withColumn("epsilon", F.round(F.greatest(F.lit(0.02), 0.15 * F.pow(F.lit(0.95), total)), 6))


def health(checks: dict[str, bool]) -> tuple[str, float]:
    """status and share of the checks that hold."""
    score = sum(checks.values()) / len(checks) if checks else 0.0
    return ("healthy" if score >= 0.8 else "degraded" if score >= 0.5 else "unhealthy"), score


def health_status(passed, total):
    """F19 as columns: struct of status and share."""
    share = F.when(total > 0, passed / total).otherwise(0.0)
    return F.struct(F.when(share >= 0.8, "healthy").when(share >= 0.5, "degraded").otherwise("unhealthy").alias("status"), share.alias("share"))


def drift_report(scores: DataFrame, session: str = "session_id", limit: float = 0.6) -> DataFrame:
    """Turns, drifted turns, mean and largest score of each session."""
    return scores.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("score") > limit).alias("drifted"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("peak"))


def ema(df: DataFrame, by: list[str], order: str, value: str, rate: float = 0.3) -> DataFrame:
    """(by..., last): exponential mean over the rows in order, beginning with the first; a fold over one short array for each group."""
    x = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value].cast("double")).alias("v"))
    return x.select(*by, F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), F.get("v", F.lit(0)), lambda a, v: a + rate * (v - a)).alias("last"))


def allocate(turns: DataFrame, by: list[str], order: str, total: str, task: str, drift: str, rate: float = 0.3, least_base: int = 1000, least_buffer: int = 400) -> DataFrame:
    """C11: (by..., order, base, cross, ci, buffer) of every turn: the task's profile, shifted by quality, and moved from the last turn's share by ``rate``.

    Each allocation depends on the last one: an ordered fold, linear in the turns of a group.
    """
    share = lambda i: budget.lookup(F.col(task), {k: float(v[i]) for k, v in budget.PROFILES.items()}, float(budget.PROFILES["unknown"][i]))
    shifted = budget.budget_shift(share(0), share(3), share(1), share(2), budget.quality_adjustment(1.0 - F.col(drift)))
    x = turns.select(*by, order, F.col(total).cast("double").alias("_t"), shifted["base"].cast("double").alias("_pct"), share(1).alias("_cross"), share(2).alias("_ci"))
    x = fold.ordered_fold(x, by, [order, "_t", "_pct"], ["_t", "_pct"], lambda: fold.Share(rate, float(least_base)), {"base": ("long", pa.int64())})
    cross, ci = (budget.round_half(F.col("_t") * F.col(c) / 100).cast("long") for c in ("_cross", "_ci"))
    out = x.select(*by, order, "_t", "base", cross.alias("cross"), ci.alias("ci"))
    return out.withColumn("buffer", F.greatest(F.lit(least_buffer), F.col("_t") - F.col("base") - F.col("cross") - F.col("ci")).cast("long")).drop("_t")


def cooccurring(history: DataFrame, task: str, unit: str, key: str, k: int = 5) -> DataFrame:
    """Keys that occur in one unit with the ten first keys of a task but are none of them; confidence 0.7 at most."""
    ten = history.groupBy(task, key).agg(F.min(unit).alias("_f")).withColumn("_r", F.row_number().over(Window.partitionBy(task).orderBy("_f", key))).filter("_r <= 10").select(task, F.col(key).alias("own"))
    pairs = history.select(F.col(unit), F.col(key).alias("own")).distinct().join(history.select(F.col(unit), F.col(key).alias("other")).distinct(), unit).filter("own <> other").groupBy("own", "other").agg(F.count(F.lit(1)).alias("c"))
    x = ten.join(pairs, "own").join(ten.withColumnRenamed("own", "other"), [task, "other"], "left_anti").groupBy(task, F.col("other").alias("key")).agg(F.sum("c").alias("n"))
    w = Window.partitionBy(task)
    x = x.withColumn("confidence", F.least(F.lit(0.7), F.col("n") / F.max("n").over(w))).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "key")))
    return x.filter(F.col("rank") <= k)


def sequence_next(history: DataFrame, by: str, order: str, unit: str, key: str, k: int = 5, recent: int = 10, last: int = 3) -> DataFrame:
    """What each ``by`` may need next: keys that share a unit with its ``last`` latest keys and are none of its ``recent`` ones; confidence 0.5 at most.

    A key that is twice among the latest counts twice. Pairs are counted once for all,
    and only those of keys that someone used last are fetched. Null keys and rows of nobody predict nothing.
    """
    x = history.filter(F.col(key).isNotNull())
    latest = x.filter(F.col(by).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), F.desc(key)))).filter(F.col("_r") <= recent)
    used = latest.select(by, F.col(key).alias("other")).distinct()
    asked = latest.filter(F.col("_r") <= last).groupBy(by, F.col(key).alias("own")).agg(F.count(F.lit(1)).alias("_times"))
    held = x.select(F.col(unit).alias("_unit"), F.col(key).alias("other")).distinct()
    own = held.withColumnRenamed("other", "own").join(asked.select("own").distinct(), "own", "left_semi")
    pairs = own.join(held, "_unit").filter("own <> other").groupBy("own", "other").agg(F.count(F.lit(1)).alias("_c"))
    g = asked.join(pairs, "own").join(used, [by, "other"], "left_anti").groupBy(by, F.col("other").alias("key")).agg(F.sum(F.col("_c") * F.col("_times")).alias("n"))
    w = Window.partitionBy(by)
    g = g.withColumn("confidence", F.least(F.lit(0.5), F.col("n") / F.max("n").over(w))).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "key")))
    return g.filter(F.col("rank") <= k)


def markdown(rows: list[dict], title: str = "") -> str:
    """A table of a few collected rows as Markdown."""
    if not rows:
        return title
    keys = list(rows[0])
    lines = ["| " + " | ".join(keys) + " |", "|" + "|".join("---" for _ in keys) + "|"] + ["| " + " | ".join("" if r[k] is None else str(r[k]) for k in keys) + " |" for r in rows]
    return "\n".join(([f"## {title}", ""] if title else []) + lines)
