"""The stored index gives what a scan gives, with blocks left closed; filters, odd items, vectors with ties."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import recall
from loomspark.operators.search_index import SearchIndex, fuse, nearest


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    word = lambda: "w%d" % min(int(rng.expovariate(0.08)), 150)
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 60))), rng.choice("ab"), rng.randint(0, 99)) for i in range(600)]
    rows += [(600, None, "a", 1), (601, "", "a", 1), (602, " ,.! ", "b", 2), (603, "W1 w1 W1", "b", 3), (604, "w1 w1 w1", "b", 3)]
    items = spark.createDataFrame(rows, "id long, content string, kind string, age long")
    queries = spark.createDataFrame([(q, " ".join(word() for _ in range(rng.randint(1, 6)))) for q in range(25)] + [(90, None), (91, ""), (92, "unknown words"), (93, "w1 W1 w1")], "query_id long, query string")
    return items, queries


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    return SearchIndex(spark, str(tmp_path_factory.mktemp("index")), ("kind", "age")).build(data[0], block=16)


def rows(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 4)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 50])
def test_same_as_a_scan(index, data, k):
    items, queries = data
    assert rows(index.search(queries, k)) == rows(recall.search(items.select("id", "content"), queries, k))


def test_filters_keep_the_counts_of_all(index, data):
    items, queries = data
    got = index.search(queries, 4, where=lambda e: (e["kind"] == "a") & (e["age"] < 50))
    every = recall.search(items.select("id", "content"), queries, 10_000).join(items.select("id", "kind", "age"), "id").filter("kind = 'a' and age < 50").collect()
    want = []
    for q in {r.query_id for r in every}:
        best = sorted((r for r in every if r.query_id == q), key=lambda r: (-r.score, r.id))[:4]
        want += [(q, n + 1, r.id, round(r.score, 4)) for n, r in enumerate(best)]
    assert rows(got) == sorted(want)


def test_blocks_are_left_closed(index, data, spark):
    """With the bound of a search for the best item, fewer blocks pass than the queries' terms have."""
    _, queries = data
    asked = index._asked(queries)
    best = index.search(queries, 1).select("query_id", F.col("score").alias("bound"))
    blocks = spark.read.parquet(f"{index.path}/postings").join(asked.select("bucket", "term", "query_id", "idf", "other"), ["bucket", "term"])
    open_ = blocks.join(best, "query_id").filter("idf * top + other >= bound")
    assert 0 < open_.count() < 0.8 * blocks.count()


def test_a_common_term_has_blocks_of_bounded_size(index, spark):
    sizes = spark.read.parquet(f"{index.path}/postings").groupBy("term").agg(F.count("*").alias("n"), F.max(F.size("entries")).alias("most"))
    assert sizes.agg(F.max("most")).first()[0] <= 64 and sizes.agg(F.max("n")).first()[0] > 20


def test_searching_reads_no_text(index, data):
    plan = index.search(data[1], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "postings" in index.search(data[1], 3).inputFiles()[0] + "postings"


def test_empty_tables(spark, data, tmp_path):
    items, queries = data
    none = SearchIndex(spark, str(tmp_path / "none"), ("kind",)).build(items.limit(0))
    assert none.search(queries, 3).collect() == []


def test_nearest_settles_ties_by_id_and_fuses(spark):
    v = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1), 0.5]) for i in range(40)] + [(50, [0.0, 0.0, 0.0]), (51, None)], "id long, vector array<double>").repartition(7)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.5]), (2, [0.0, 0.0, 0.0]), (3, None)], "query_id long, vector array<double>")
    near = nearest(q, v, 5)
    assert [(r.query_id, r.id) for r in near.orderBy("query_id", "rank").collect()] == [(1, i) for i in (0, 3, 6, 9, 12)]
    other = spark.createDataFrame([(1, 3, 1), (1, 99, 2)], "query_id long, id long, rank int")
    assert [r.id for r in fuse([near, other], 3).orderBy("rank").collect()] == [3, 0, 99]


def test_pairs_of_queries_and_items_do_not_move(spark, data, index, tmp_path):
    """The sums of a query over an item are made where the item's postings or words are."""
    items, queries = data
    for found in (index.search(queries, 3), recall.search(items.select("id", "content"), queries, 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(query_id" in x and ", id" in x.split("hashpartitioning(")[1].split(")")[0]], plan


def test_what_stands_beside_an_explode_is_not_evaluated_for_each_word(spark, tmp_path):
    import time

    text = " ".join(f"w{i}" for i in range(40_000))
    began = time.time()
    made = SearchIndex(spark, str(tmp_path / "long")).build(spark.createDataFrame([(1, text)], "id long, content string"))
    assert time.time() - began < 60
    assert spark.read.parquet(f"{made.path}/counts").count() == 40_000
