"""Suffix dedup of long texts in pieces, and with more buckets than any fixed number."""

import hashlib
import random
import tracemalloc
from collections import defaultdict

import pytest

from loomspark.llm import suffixes

from .test_llm import prose, removed


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    shared = [prose(rng, 200).encode() for _ in range(4)]
    out = [b" ".join(rng.choice(shared)[rng.randint(0, 300) : rng.randint(400, 1200)] if rng.random() < 0.5 else prose(rng, rng.randint(1, 90)).encode() for _ in range(rng.randint(1, 9))) for _ in range(40)]
    return out + [b"z" * 2000, b"z" * 99, b"", b"ab" * 400, out[0], b"x" + out[1], out[2][7:]]


@pytest.mark.parametrize(("piece", "bucket_bytes", "crowd"), [(1, 1000, 1000), (37, 1, 1000), (150, 1, 3), (10**6, 1, 1000)])
def test_pieces_and_buckets_change_nothing(spark, texts, piece, bucket_bytes, crowd):
    df = spark.createDataFrame(list(enumerate(map(bytearray, texts))), "rid long, raw binary").repartition(5)
    by = defaultdict(list)
    for r in suffixes.repeated_runs(df, bucket_bytes=bucket_bytes, crowd=crowd, piece=piece).collect():
        by[r["rid"]].append((r["p"], r["n"]))
    assert sum(map(len, texts)) > 65536  # with a byte for a bucket, more than the number that once was the most
    for i, (n_bytes, n, k, sha) in removed(list(enumerate(texts)), 100).items():
        left, n_got, k_got, _ = suffixes.cut(texts[i], by[i], 100)
        assert (n_got, k_got, hashlib.sha256(left).hexdigest()) == (n, k, sha), i


def test_pieces_hold_every_window_once():
    for n in (0, 1, 99, 100, 101, 149, 150, 151, 1000):
        text = bytes(i % 251 for i in range(n))
        windows = [at + i for at, part in suffixes.text_pieces(text, 50, 100) for i in range(len(part) - 99)]
        assert windows == list(range(max(0, n - 99)))
        assert all(text[at : at + len(part)] == part for at, part in suffixes.text_pieces(text, 50, 100))


def test_memory_of_a_long_text_is_that_of_a_piece():
    text = random.Random(2).randbytes(16_000_000)
    tracemalloc.start()
    for _, part in suffixes.text_pieces(text, suffixes.BLOCK // 2, 100):
        suffixes.cover([part], 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 250_000_000
