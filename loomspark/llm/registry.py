"""Queries of the training-data operators over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .oracles import codes_sql, containment_sql, repair_sql


def op1_mix_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op2_toxicity_deobfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text"), labels.filter(~_held_out()).select("doc_id", "toxic"))
    return out.select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def op3_suffix_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup

    return dedup(load(spark, sf_dir, "documents"), keep_text=False)


def op4_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl"]
    return judge(load(spark, sf_dir, "documents")).select(*cols)


def op5_minhash_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import find

    return find(load(spark, sf_dir, "documents"), shingle=4)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge

    return judge(load(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import find

    return find(load(spark, sf_dir, "embeddings"))


def op8_shard_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shuffle

    docs = load(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle(rows, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find

    return find(load(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_and_check

    return encode_and_check(load(spark, sf_dir, "documents"))


def op11_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compress

    return compress(load(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_prefix_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .containment import find

    return find(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repair_damaged

    return repair_damaged(load(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_mix_sainte_lague": op1_mix_sainte_lague,
    "op2_toxicity_deobfuscated": op2_toxicity_deobfuscated,
    "op3_suffix_cover": op3_suffix_cover,
    "op4_quality_perplexity": op4_quality_perplexity,
    "op5_minhash_chosen_path": op5_minhash_chosen_path,
    "op6_url_rules": op6_url_rules,
    "op7_cross_polytope": op7_cross_polytope,
    "op8_shard_hypergeometric": op8_shard_hypergeometric,
    "op9_secret_spans": op9_secret_spans,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_annular_codes": op11_annular_codes,
    "op12_prefix_containment": op12_prefix_containment,
    "op13_conversation_repair": op13_conversation_repair,
}


def _op6_sql() -> str:
    from .url_rules import HOST_RULES, PATTERN_RULES

    hosts = sorted(HOST_RULES, key=lambda r: -len(r.name))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in hosts]
    rule = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, hosts))
    verdict = " ".join(f"WHEN {f} THEN '{r.action}'" for f, r in zip(fits, hosts))
    patterns = " ".join(f"WHEN regexp_matches(low, '{r.pattern}') THEN '{r.action}'" for r in PATTERN_RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH p AS (
      SELECT page_id, {lower.format("url")} AS low,
        {lower.format("coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '')")} AS host,
        coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
      FROM pages)
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} {patterns} ELSE 'allow' END AS verdict FROM p"""


ORACLE_SQL = {
    "op6_url_rules": _op6_sql(),
    "op11_annular_codes": codes_sql(),
    "op12_prefix_containment": containment_sql(),
    "op13_conversation_repair": repair_sql(),
}
