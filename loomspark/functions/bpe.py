"""Byte-pair token counts with a public vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_KNOWN: dict[int, object] = {}


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def counter(spark: SparkSession, path: str = RANKS):
    """A function from a text column to its number of tokens; the ranks (a fixed file) are broadcast."""
    ranks = spark.sparkContext.broadcast(read_ranks(path))

    def run(texts: pd.Series) -> pd.Series:
        import tiktoken

        if id(ranks) not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[id(ranks)] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        e = _KNOWN[id(ranks)]
        return texts.map(lambda t: 0 if t is None else len(e.encode_ordinary(t)))

    return F.pandas_udf(run, "long")


def count_distinct_texts(df: DataFrame, text: str = "content", out: str = "tokens", path: str = RANKS, count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Counts each different text once, by ``count`` or in byte pairs, and joins the counts back."""
    count = count or counter(df.sparkSession, path)
    texts = df.select(F.col(text).alias("_t")).distinct().withColumn(out, count(F.col("_t")))
    return df.join(texts, F.col(text).eqNullSafe(F.col("_t")), "left").drop("_t")
