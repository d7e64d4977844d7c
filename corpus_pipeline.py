"""The corpus pipeline: quality rules, near-dedup, secret redaction, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last keep the
columns of documents; the last gives the token ids of each document of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import mixing, neardup, pieces, quality, secrets
from loomspark.llm.common import load, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids up to this number are broadcast to pick out documents; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is among ``ids``; null ids match null."""
    ids = stash(ids.select(F.col("doc_id").alias("_id")).distinct(), "kept-ids")
    n = ids.count()
    return docs.select(*COLUMNS).join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the perplexity bands reject go."""
    return _only(docs, quality.judge(docs).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    return _only(docs, neardup.find(docs, shingle=5, percent=80).filter("kept"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secrets.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it: whole epochs, and once more if the mix takes half of it or more besides.

    Documents that the mix takes nothing of go; that is what the weights ask for.
    """
    taken = mixing.mix(docs)
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    counts = stash(taken.groupBy(F.col("doc_id").alias("_id")).agg(F.max(times).alias("_times")).filter("_times > 0"), "mix-times")
    n = counts.count()
    out = docs.select(*COLUMNS).join(F.broadcast(counts) if n <= BROADCAST_IDS else counts, F.col("doc_id").eqNullSafe(F.col("_id")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*COLUMNS)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document of the mix."""
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing to target weights", mixture),
    ("sentencepiece", sentencepiece_ids),
]

#: The stages hold a language model, set similarity and a tokenizer, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on documents."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, f"stage-{k}")
    return docs
