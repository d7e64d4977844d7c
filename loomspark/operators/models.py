"""Model profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- fixed values: id, name, provider, largest context, effective ratio, strategy, compression threshold ---
PROFILES = (
    ("minimax-m2.5", "MiniMax M2.5", "MiniMax", 204800, 0.85, "dynamic-load", 153600),
    ("minimax-m3", "MiniMax M3", "MiniMax", 1000000, 0.9, "dynamic-load", 800000),
    ("kimi-k1.5", "Kimi k1.5", "Kimi", 128000, 0.8, "dynamic-load", 96000),
    ("kimi-k2", "Kimi k2", "Kimi", 262144, 0.8, "dynamic-load", 210000),
    ("deepseek-v3", "DeepSeek V3", "DeepSeek", 128000, 0.9, "static-prefix", 100000),
    ("deepseek-r1", "DeepSeek R1", "DeepSeek", 128000, 0.85, "static-prefix", 100000),
    ("deepseek-v4-flash", "DeepSeek V4 Flash", "DeepSeek", 1000000, 0.9, "static-prefix", 800000),
    ("deepseek-v4-pro", "DeepSeek V4 Pro", "DeepSeek", 1000000, 0.9, "static-prefix", 800000),
    ("qwen-3", "Qwen 3", "Qwen", 128000, 0.85, "static-prefix", 100000),
    ("qwen-3.5", "Qwen 3.5", "Qwen", 1000000, 0.85, "static-prefix", 800000),
    ("qwen-3.6", "Qwen 3.6", "Qwen", 1000000, 0.85, "static-prefix", 800000),
    ("qwen-3.7", "Qwen 3.7", "Qwen", 1000000, 0.85, "static-prefix", 800000),
    ("qwen-3.8", "Qwen 3.8", "Qwen", 1000000, 0.85, "static-prefix", 800000),
    ("glm-5", "GLM 5", "GLM", 200000, 0.85, "static-prefix", 150000),
    ("glm-5.1", "GLM 5.1", "GLM", 200000, 0.85, "static-prefix", 150000),
    ("glm-5.2", "GLM 5.2", "GLM", 1000000, 0.9, "static-prefix", 800000),
    ("mistral-large-2", "Mistral Large 2", "Mistral", 128000, 0.9, "static-prefix", 100000),
    ("gpt-4o", "GPT-4o", "OpenAI", 128000, 0.85, "static-prefix", 100000),
    ("gpt-4.5", "GPT-4.5", "OpenAI", 128000, 0.85, "static-prefix", 100000),
    ("gpt-5", "GPT-5", "OpenAI", 256000, 0.85, "static-prefix", 200000),
    ("gpt-5.5", "GPT-5.5", "OpenAI", 256000, 0.85, "static-prefix", 200000),
    ("gpt-5.6", "GPT-5.6", "OpenAI", 512000, 0.85, "static-prefix", 400000),
    ("o1", "OpenAI o1", "OpenAI", 200000, 0.7, "dynamic-load", 150000),
    ("o2", "OpenAI o2", "OpenAI", 200000, 0.7, "dynamic-load", 150000),
    ("o3", "OpenAI o3", "OpenAI", 256000, 0.7, "dynamic-load", 200000),
    ("claude-3.5-sonnet", "Claude 3.5 Sonnet", "Claude", 200000, 0.9, "static-prefix", 160000),
    ("claude-3.7-sonnet", "Claude 3.7 Sonnet", "Claude", 200000, 0.9, "static-prefix", 160000),
    ("claude-opus-4", "Claude Opus 4", "Claude", 1000000, 0.9, "static-prefix", 800000),
    ("claude-4.6", "Claude 4.6", "Claude", 1000000, 0.9, "static-prefix", 800000),
    ("claude-5", "Claude 5", "Claude", 1000000, 0.9, "static-prefix", 800000),
    ("gemini-2.0-flash", "Gemini 2.0 Flash", "Gemini", 128000, 0.85, "static-prefix", 100000),
    ("gemini-2.5-pro", "Gemini 2.5 Pro", "Gemini", 1048576, 0.85, "static-prefix", 800000),
    ("gemini-3", "Gemini 3", "Gemini", 256000, 0.85, "static-prefix", 200000),
    ("gemini-3.5", "Gemini 3.5", "Gemini", 512000, 0.85, "static-prefix", 400000),
    ("gemini-1.5-pro", "Gemini 1.5 Pro", "Gemini", 1024000, 0.9, "static-prefix", 800000),
)
# ------------------------------------------------------------------------------------------------------------
SCHEMA = "id string, name string, provider string, max_tokens long, ratio double, strategy string, threshold long"
DEFAULTS = ("default", "Default", "unknown", 128000, 0.8, "hybrid", 96000)


def profiles(spark: SparkSession, rows=PROFILES) -> DataFrame:
    """The built-in profiles, with their place in the registry."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, " + SCHEMA)


def resolve(asked: DataFrame, registry: DataFrame, name: str = "asked") -> DataFrame:
    """For each asked name the profile with that id, else that id or name without case, else the first that holds it.

    The registry is a list of profiles, so every distinct name meets each of them; it is sent to all where it is small.
    """
    low = F.lower(F.col(name))
    tier = F.when(F.col("id") == F.col(name), 0).when((F.lower("id") == low) | (F.lower("name") == low), 1).when(F.contains(F.lower("id"), low) | F.contains(F.lower("name"), low), 2)
    names = asked.select(name).distinct()
    x = names.join(F.broadcast(registry) if registry.count() <= 10_000 else registry, F.lit(True)).withColumn("tier", tier).filter("tier is not null")
    best = x.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy("tier", "pos"))).filter("_r = 1").drop("_r", "pos")
    return asked.join(best, name, "left")


def hint(resolved: DataFrame) -> DataFrame:
    """The profile's values, or the hybrid defaults where there is none."""
    d = dict(zip(("id", "name", "provider", "max_tokens", "ratio", "strategy", "threshold"), DEFAULTS))
    return resolved.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in d.items() if c not in ("id", "name")})


def window_warnings(window: Column, profile: Column, reserve: Column) -> Column:
    """What is odd about a window."""
    return F.filter(F.array(F.when(window != profile, "window differs from profile"), F.when(reserve == 0, "no reserve")), lambda x: x.isNotNull())


def export_config(registry: DataFrame) -> DataFrame:
    """Window, threshold and auto trigger of each profile."""
    return registry.select("id", "max_tokens", F.floor(F.col("max_tokens") * F.col("ratio")).cast("long").alias("effective"), "threshold", F.floor(F.col("max_tokens") * 0.75).cast("long").alias("auto_trigger"))
