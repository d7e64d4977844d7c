"""Budget arithmetic (C7-C20), strategy scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: percentages base / cross / ci / buffer of each task type ---
PROFILES = {"coding": (60, 5, 10, 25), "reasoning": (50, 15, 15, 20), "writing": (55, 10, 10, 25), "conversation": (70, 5, 5, 20), "unknown": (55, 10, 10, 25)}
#: Largest contexts by task.
TASK_LIMITS = {"simple_lookup": 10000, "multi_lookup": 5000, "summarization": 3000, "complex_reasoning": 2000}
COMPLEXITY_FACTORS = {"simple_lookup": 1.0, "multi_lookup": 0.8, "summarization": 0.7, "complex_reasoning": 0.6}
#: Stable-prefix ratio and preloaded items of each strategy.
STRATEGIES = {"static-prefix": (0.4, 20), "dynamic-load": (0.2, 10), "hybrid": (0.3, 15)}
#: mode, tokens, top k, memory, governance, ci, cross-domain
INJECTION = {
    "coding": ("aggressive", 4000, 15, True, True, False, False), "review": ("balanced", 3000, 10, True, True, True, True),
    "debugging": ("contextual", 5000, 20, True, False, True, False), "planning": ("aggressive", 4000, 12, True, True, False, True),
    "question": ("minimal", 1500, 5, True, False, False, False), "conversation": ("balanced", 2000, 8, True, False, False, False),
    "unknown": ("balanced", 2500, 10, True, False, False, False),
}
ASSEMBLY = {"coding": "procedural_execution", "review": "compositional_reasoning", "debugging": "factual_recall", "planning": "compositional_reasoning", "question": "factual_recall", "conversation": "balanced", "unknown": "balanced"}
# ------------------------------------------------------------------------------


def lookup(key: Column, values: dict, default) -> Column:
    """A small fixed table as an expression."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def round_half(x: Column) -> Column:
    return F.floor(x + 0.5)


def token_budget(total: Column, consumed: Column) -> Column:
    """Struct of reserve (8 %), remaining and utilization (1 for no budget)."""
    reserve = F.floor(total * 0.08)
    return F.struct(reserve.alias("reserve"), F.greatest(F.lit(0), total - consumed - reserve).alias("remaining"), F.when(total == 0, 1.0).otherwise(consumed / total).alias("utilization"))


def static_split(total: Column, pct=(60, 10, 10, 20), least_base: int = 1000, most_cross: int = 2000, most_ci: int = 2000) -> Column:
    """Struct of base, cross, ci and buffer; percentages must sum to 100."""
    if abs(sum(pct) - 100) > 0.1:
        raise ValueError(f"percentages must sum to 100: {pct}")
    base, cross, ci = (F.floor(total * p / 100) for p in pct[:3])
    low = (base < least_base) & (total >= least_base)
    cross = F.when(low, F.least(F.lit(most_cross), total - least_base - ci - F.floor(total * pct[3] / 100))).otherwise(cross)
    base = F.when(low, least_base).otherwise(base)
    cross, ci = F.least(cross, F.lit(most_cross)), F.least(ci, F.lit(most_ci))
    return F.struct(base.alias("base"), cross.alias("cross"), ci.alias("ci"), (total - base - cross - ci).alias("buffer"))


def quality_adjustment(quality: Column, threshold: float = 0.5) -> Column:
    """Percent points to move from base to buffer; negative moves back."""
    gap = threshold - quality
    return F.when(gap > 0, F.least(F.lit(15.0), gap * 20)).otherwise(-F.least(F.lit(10.0), -gap * 10))


def budget_shift(base: Column, buffer: Column, cross: Column, ci: Column, shift: Column) -> Column:
    """Struct of base and buffer; clamped, and the buffer takes what is left of 100."""
    b = F.greatest(F.lit(10.0), F.least(F.lit(80.0), base - shift))
    rest = 100.0 - round_half(b) - cross - ci
    return F.struct(round_half(b).alias("base"), F.greatest(F.lit(5.0), F.least(F.lit(40.0), rest)).alias("buffer"))


def drift_level(drift: Column) -> Column:
    """C15."""
    return F.when(drift >= 0.7, "high").when(drift >= 0.5, "medium").when(drift >= 0.3, "low").otherwise("stable")


def model_split(total: Column, strategy: Column) -> Column:
    """Struct of effective, stable, preload, dynamic and reserve."""
    ratio, items = lookup(strategy, {k: v[0] for k, v in STRATEGIES.items()}, 0.3), lookup(strategy, {k: v[1] for k, v in STRATEGIES.items()}, 15)
    eff = F.floor(total * 0.9)
    stable = F.floor(eff * ratio)
    return F.struct(eff.alias("effective"), stable.alias("stable"), F.least(F.floor(stable / 2), items * 500).alias("preload"), (eff - stable).alias("dynamic"), (total - eff).alias("reserve"))


def mecw(most: Column, ratio: Column, task: Column) -> Column:
    """C17."""
    return F.floor(most * ratio * lookup(task, COMPLEXITY_FACTORS, 0.6)).cast("long")


def context_check(task: Column, tokens: Column) -> Column:
    """Struct of within, ratio and warning."""
    most = lookup(task, TASK_LIMITS, 10000)
    return F.struct((tokens <= most).alias("within"), (tokens / most).alias("ratio"), (tokens / most >= 0.8).alias("warning"))


def compression_target(tokens: Column, threshold: Column, effective: Column) -> Column:
    """C19."""
    return F.when(tokens > threshold, F.floor(effective * 0.7) / tokens).when(tokens > threshold * 0.85, 0.85).otherwise(1.0)


def injection_tokens(task: Column, budget: Column, urgent: Column) -> Column:
    """Tokens for a task, at most the budget; half as much again if urgent, at most 8000."""
    t = F.least(lookup(task, {k: v[1] for k, v in INJECTION.items()}, 2500), budget)
    return F.when(urgent, F.least(t * 1.5, F.lit(8000.0))).otherwise(t.cast("double"))


def recall_scores(drift: Column, budget: Column, weight: Column) -> dict[str, Column]:
    """The four recall strategies' scores, without exploration."""
    b, one = budget / 80000, F.lit(1.0)
    return {
        "aggressive_recall": F.least(one, b * 0.5 + (1 - drift) * 0.3 + weight * 0.2), "selective_recall": F.least(one, b * 0.3 + drift * 0.3 + weight * 0.3 + 0.1),
        "minimal_context": F.least(one, (1 - b) * 0.5 + drift * 0.3 + weight * 0.2), "drift_adaptive": F.least(one, drift * 0.4 + b * 0.3 + weight * 0.3),
    }


def recall_strategy(drift: Column, budget: Column, weight: Column) -> Column:
    """The best strategy; of equals the later."""
    scores = recall_scores(drift, budget, weight)
    best, out = F.greatest(*scores.values()), F.lit(None).cast("string")
    for name, s in scores.items():
        out = F.when(s == best, name).otherwise(out)
    return out


def completeness_action(score: Column) -> Column:
    """What to do about a context's completeness."""
    return F.when(score.isNull() | (score >= 0.4), "use").when(score >= 0.2, "expand").otherwise("max_expand")


def remaining(budget: Column, used: Column) -> Column:
    """What is left of a category's budget."""
    return F.greatest(F.lit(0), budget - used)


def can_fit(budget: Column, used: Column, asked: Column) -> Column:
    """C10."""
    return used + asked <= budget


def incremental_adjust(task: Column, quality: Column) -> Column:
    """C14: struct of base and buffer percent of a task after the shift that its quality asks for."""
    p = [lookup(task, {k: v[i] for k, v in PROFILES.items()}, PROFILES["unknown"][i]) for i in range(4)]
    return budget_shift(p[0], p[3], p[1], p[2], quality_adjustment(quality))


def should_compress(tokens: Column, threshold: Column) -> Column:
    """C20."""
    return tokens >= threshold


def usage_ratio(tokens: Column, most: Column) -> Column:
    """C20: 0 for no window."""
    return F.when(most == 0, 0.0).otherwise(tokens / most)


def assembly_strategy(task: Column) -> Column:
    """How history is put together for a task."""
    return lookup(task, ASSEMBLY, "balanced")
