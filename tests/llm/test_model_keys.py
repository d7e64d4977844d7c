"""N-grams of one hash: another hash is taken."""

from loomspark.llm import quality, toxicity


def test_ngrams_never_share_an_entry(spark, monkeypatch):
    model = spark.createDataFrame([("zh", "\u4e00a", -1.0, -0.5), ("zh", "\u4e00b", -9.0, -0.25)], "lang string, gram string, lp double, bow double")
    mixed = quality._mixed
    salts = []

    def of(model_rows, order, salt=0):
        salts.append(salt)
        return own(model_rows, order, salt)

    own = quality.hash_arrays
    monkeypatch.setattr(quality, "hash_arrays", of)
    twice = model.union(model.limit(0))
    got = quality.hash_arrays(twice, 4)
    assert len(got.keys) == 2 and salts == [0] and mixed is quality._mixed
    assert got.entry("zh", "\u4e00a") == (-1.0, -0.5) and got.entry("zh", "\u4e00b") == (-9.0, -0.25) and got.entry("zh", "absent") == (None, None)
    other = own(model, 4, salt=3)
    assert other.keys.tolist() != got.keys.tolist() and other.entry("zh", "\u4e00a") == (-1.0, -0.5)
    restorer = toxicity.Restorer(quality.hash_arrays(model.selectExpr("'' AS lang", "gram", "lp", "bow"), 4))
    assert [restorer._entry(g) for g in ("\u4e00a", "\u4e00b", "absent")] == [(-1.0, -0.5), (-9.0, -0.25), (None, None)]
