"""Rows that share a key, implied tokens, large draws, guess costs by enumeration, and what planted secrets give."""

import itertools
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import common, mixing, neardup, registry, secrets, sharding, url_rules

from ..conftest import SF
from .test_llm import prose

# --- near-duplicates -----------------------------------------------------------------------------


def test_rows_that_share_a_key_link_by_each_of_their_texts(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    for rows in itertools.permutations([(1, a), (1, b), (2, a + " zz"), (3, b + " yy")]):
        got = neardup.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1}
        break
    got = neardup.find(spark.createDataFrame([(3, b + " yy"), (1, b), (2, a + " zz"), (1, a), (4, prose(rng, 60))], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_blocks_hold_every_text_of_a_key(spark):
    rng = random.Random(5)
    a, b = prose(rng, 80), prose(rng, 80)
    near = lambda t, k: " ".join(t.split()[:79] + [f"w{k}"])
    rows = [(k, near(a, k)) for k in range(40)] + [(k, near(b, k)) for k in range(39, 80)]
    got = neardup.find(spark.createDataFrame(rows, "doc_id long, text string"), leaf=4, depth=1, chunk=16).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == len(rows)


# --- urls ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", url_rules.PATTERN_RULES, ids=lambda r: r.tokens[0])
def test_tokens_are_implied_by_the_pattern(rule):
    @settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(rule.pattern, re.ASCII)))
    def check(url):
        assert set(rule.tokens) <= set(re.split("[^a-z0-9]+", url.lower()))

    check()


def test_a_token_that_may_go_on_is_none(spark):
    urls = ["https://a.org/wp-login.php5"] + [f"https://b{i}.org/wp/login" for i in range(9)] + [None, "x" * 100_000, "https://a.org/wp-login.php5"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(df).collect()}
    assert got[0] == got[12] == "block" and set(got.values()) == {"block", "allow"} and len(got) == len(urls)


# --- shards --------------------------------------------------------------------------------------


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(1)
    x = [sharding._hypergeometric(rng, 50, 70, 30) for _ in range(20_000)]
    assert np.mean(x) == pytest.approx(12.5, abs=0.06) and np.var(x) == pytest.approx(30 * 50 / 120 * 70 / 120 * 90 / 119, rel=0.05)
    m = sharding.communication_matrix([3 * 10**9, 5 * 10**9, 0, 7], 4, 2)
    assert m.sum(axis=1).tolist() == [3 * 10**9, 5 * 10**9, 0, 7] and max(m.sum(axis=0)) - min(m.sum(axis=0)) <= 1
    assert sharding._hypergeometric(rng, 5, 0, 3) == 3 and sharding._hypergeometric(rng, 0, 5, 3) == 0 and sharding._hypergeometric(rng, 5, 5, 10) == 5


def test_shuffle_leaves_columns_of_any_name(spark):
    names = ["h", "p", "k", "r", "ends", "piece", "before", "row", "_h", "a.b", "shard"]
    df = spark.createDataFrame([(i, *[i * 10 + j for j in range(len(names))]) for i in range(50)], ", ".join(f"`{c}` long" for c in ["id", *names]))
    got = sharding.shuffle(df, ["id"], shards=3).collect()
    assert sorted((r["id"], *[r[c] for c in names[:-1]]) for r in got) == [(i, *[i * 10 + j for j in range(len(names) - 1)]) for i in range(50)]
    assert Counter(r["shard"] for r in got) == {0: 17, 1: 17, 2: 16}


def test_shard_query_columns(spark):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.op8_shard_hypergeometric(spark, SF).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None) and 0 <= r["shard"] < 40


# --- mixing --------------------------------------------------------------------------------------


def test_taken_is_whole_epochs_and_a_front_of_each_shard(docs):
    rows = mixing.mix(docs).collect()
    for r in rows:
        assert r["taken"] == 3 * r["size"] if r["capped"] else 0 <= r["taken"] <= 3 * r["size"]
    shards = {}
    for r in rows:
        if not r["capped"]:
            shards.setdefault((r["source"], r["shard"]), []).append(r)
    for own in shards.values():
        taken, size = sum(r["taken"] for r in own), sum(r["size"] for r in own)
        epochs = taken // size if size else 0
        assert all(epochs * r["size"] <= r["taken"] <= (epochs + 1) * r["size"] for r in own)
        assert sum(epochs * r["size"] < r["taken"] < (epochs + 1) * r["size"] for r in own) <= 1


# --- secrets -------------------------------------------------------------------------------------


def least_cost(value, ranks):
    """The least cost over all segmentations, listed one by one."""
    def one(s):
        low, out = s.lower(), []
        plain = low.translate(secrets._PLAIN)
        if len(s) == 1:
            out.append(math.log10(len(secrets.JOINTS)) if s in secrets.JOINTS else secrets._brute(s))
        for t, extra in ((low, 0), (plain, math.log10(2))):
            if len(s) > 1 and t in ranks.rank:
                out.append(math.log10(ranks.rank[t] + 1) + extra + (math.log10(2) if s != low else 0))
        if secrets.DATE.fullmatch(s):
            out.append(math.log10(365 * 120))
        if len(s) >= 3 and all((a, b) in secrets._NEXT for a, b in zip(low, low[1:])):
            out.append(math.log10(94 * len(s)))
        for k in range(1, min(8, len(s) // 2) + 1):
            if len(s) % k == 0 and s == s[:k] * (len(s) // k):
                out.append(least_cost(s[:k], ranks) + math.log10(len(s) // k))
        return min(out, default=math.inf)

    best = math.inf
    for cuts in itertools.product((0, 1), repeat=max(0, len(value) - 1)):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(value)]
        best = min(best, sum(one(value[a:b]) for a, b in zip(at, at[1:])))
    return best if value else 0.0


def test_guess_cost_is_the_least_of_all_segmentations():
    rng = random.Random(4)
    ranks = secrets.Ranks(["pass", "ab", "word", "cat", "a1"])
    for _ in range(150):
        v = "".join(rng.choice(["ab", "a", "b", "1", "@", "cat", "QWE", "qwe", ".", "pass", "9", "P"]) for _ in range(rng.randint(0, 5)))[:9]
        assert secrets.guess_cost(v, ranks) == pytest.approx(least_cost(v, ranks))
    assert secrets.guess_cost("2024-01-05", ranks) == pytest.approx(math.log10(365 * 120))


def test_long_repeats_and_runs_stay_cheap():
    for v in ("x" * 400, "x" * 5000, "ab" * 900, "qwertyuiop" * 30, "passpass" * 20):
        assert secrets.guess_cost(v) < 10


def planted(rng, n):
    """Values behind contexts that the base patterns don't see, secrets and others."""
    strong = lambda: "".join(rng.choice(string.ascii_letters + string.digits + "!#$%*+?@^~") for _ in range(rng.randint(12, 24)))
    weak = ["changeme", "password123", "your-secret-here", "process.env.TOKEN", "getToken(user)", "readFromEnvironment", "http://localhost:8080", "xxxxxxxxxxxx", "example", "2024-01-05", "qwertyuiop", "none", "os.environ", "config.get(", "test1234", "redacted", "user.password"]
    lead = ["pwd: ", "passphrase = ", "bearer: ", "private_key =\t", "credentials => ", "db_pwd:  ", "login: ", "signature := "]
    return [(f"some prose {rng.choice(lead)}{v} and more", yes) for _ in range(n) for v, yes in ((strong(), True), (rng.choice(weak), False))]


def test_recall_and_precision_on_planted_secrets(spark):
    cases = planted(random.Random(11), 300)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_guess"] for r in secrets.find(df).collect()}
    hit = sum(got[i] > 0 for i, (_, yes) in enumerate(cases) if yes)
    false = sum(got[i] > 0 for i, (_, yes) in enumerate(cases) if not yes)
    assert hit >= 0.99 * 300 and false <= 0.02 * 300


def test_corpus_words_are_all_counted(spark):
    texts = ["the cat, The (dog) x9 the", None, "", "cat é dog the a1b zebra"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    assert secrets.corpus_words(df, 3, least=10) == [] and secrets.corpus_words(df, 3, least=1) == ["the", "cat", "dog"]


# --- shared pieces -------------------------------------------------------------------------------


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Session)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 90)), [None, "b", "a", "Z"][i % 4]) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_stages_on_no_rows_and_extra_columns(spark):
    import corpus_pipeline as cp

    for rows in ([], [(1, "a few words", "en", "s", 11, "x", 3), (None, None, None, None, None, None, None)]):
        x = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, shard long")
        for k, (_, stage) in enumerate(cp.STAGES):
            y = stage(spark, x, SF)
            assert y.count() <= max(1, 3 * len(rows))
            if k < 4:
                assert y.columns == list(cp.COLUMNS)
                x = y.withColumn("size", F.lit("x")).withColumn("shard", F.lit(3))
