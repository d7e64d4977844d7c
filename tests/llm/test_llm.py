"""The training-data operators: odd rows, empty tables, and brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import mixing, neardup, pieces, quality, registry, secrets, sharding, suffixes, toxicity, url_rules, vectors
from loomspark.llm.components import components

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = prose(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [base, base, near, base + " tail of a few more words", None, "", " \t\n ", "one", "one", "x" * 5000, prose(rng, 30_000), "é中\U0001f600 ▁ a  b\n\n", "A\u00a0b\x85c", "same line\nsame line\n\nsame line"]
    texts += [prose(rng, rng.randint(3, 300)) for _ in range(40)]
    out = [(i, t, [None, "en", "de"][i % 3], [None, "b", "a", "Z"][i % 4], 0, 7, 9, "x") for i, t in enumerate(texts)]
    return out + [out[0], (None, "null key", "en", "a", 0, 7, 9, "x"), (3, "other text under a used key", "en", "a", 0, 7, 9, "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (mixing.mix(none), quality.judge(none), neardup.find(none), suffixes.dedup(none), secrets.find(none), secrets.redacted(none), pieces.encode_and_check(none), pieces.encode(none), toxicity.score(none, labels),
               sharding.shuffle(none.select("doc_id", "text"), ["doc_id", "text"]), url_rules.judge(spark.createDataFrame([], "page_id long, url string")), vectors.find(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert df.collect() == []


def test_release_deletes_what_was_written(spark):
    from loomspark.llm import common

    x = common.stash(spark.range(5), "test")
    assert x.count() == 5
    path = common._WRITTEN[-1].removeprefix("file://")
    import os

    assert os.path.isdir(path) and common.release(spark) > 0 and not os.path.isdir(path)


# --- 1 mixing ------------------------------------------------------------------------------------


def sainte_lague(weights, seats):
    got = {k: 0 for k in weights}
    for _ in range(seats):
        k = min((k for k in weights if weights[k] > 0), key=lambda k: (-weights[k] / (2 * got[k] + 1), k))
        got[k] += 1
    return got


def test_apportion_is_highest_quotients(spark):
    rng = random.Random(3)
    parties = {g: {f"p{i:02d}": rng.choice([0, 1, 5, 7, rng.randint(1, 1000)]) for i in range(rng.randint(1, 12))} for g in "abcdef"}
    seats = {g: n for g, n in zip(parties, (0, 1, 3, 17, 100, 999))}
    df = spark.createDataFrame([(g, p, w, seats[g]) for g, ps in parties.items() for p, w in ps.items()], "g string, p string, w long, n int")
    got = {(r["g"], r["p"]): r["seats"] for r in mixing.apportion(df, ["g"], "w", F.col("n"), ["p"], "seats").collect()}
    for g, ps in parties.items():
        want = sainte_lague(ps, seats[g]) if any(ps.values()) else {p: 0 for p in ps}
        assert {p: got[g, p] for p in ps} == want


def water_fill(sizes, weights, most=3):
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else rest * weights[s] / sum(weights[x] for x in free) for s in sizes}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_are_reshared(spark):
    sizes = {"a": 10, "b": 0, "c": 500, "d": 3, "e": 900, None: 40}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    df = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight int")
    want = water_fill(sizes, weights)
    for r in mixing.source_targets(df).collect():
        assert r["target"] == pytest.approx(want[r["source"]])


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    by = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"], r["target"]] += r["taken"]
    total = sum(r["size"] for r in got)
    for (_, target), taken in by.items():
        assert abs(taken - target) <= max(2, total / 65536 + 1)
    again = mixing.mix(docs.repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


# --- 2 toxicity ----------------------------------------------------------------------------------


def test_restores_disguised_words(spark):
    clean = ["the idiot went to the market and a stupid clown was there", "pathetic loser and stupid idiot", "a moron came with the clown"] * 30
    text = spark.createDataFrame([("", t) for t in clean], "lang string, text string")
    r = toxicity.Restorer(quality.hash_arrays(quality.kneser_ney(quality.count_ngrams(text, 4, across=False), 4), 4))
    for seen, want in (("1d10t", "idiot"), ("id!ot", "idiot"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"), ("$tup1d", "stupid"), ("Clown,", "clown"), ("market", "market"), ("!!!", "")):
        assert r.plain(seen) == want
    assert toxicity.document_words("go i d i o t now")[0] >= {"idiot"} and toxicity.document_words("is a i d i o t")[0] >= {"idiot"}
    for seen in ("idi" + 70 * "o" + "t", "i" + 40 * "--" + "diot", "iddiot", "stuupid", "i--d--i--o--t", "id-iot", "st_up_id", "1d!0+", "i d i o t"):
        assert r.plain(seen) in ("idiot", "stupid")
    assert "idiot" in r.words("go,idiot") and "idiot" in r.words("the/1diot") and r.words("2019-01-02") == ["2019-01-02"]


def spellings(word, last="", after=""):
    """Every reading of a lattice with its cost, by enumeration."""
    r = toxicity.Restorer.choices
    own = type("C", (), {"costs": (1.0, 0.7, 0.4, 6.0)})
    out = [("", 0.0)]
    for i, c in enumerate(word):
        out = [(s + x, cost + more) for s, cost in out for x, more in r(own, c, word[i - 1] if i else "")]
    return out


def test_decoding_is_the_best_of_all_readings(spark):
    text = spark.createDataFrame([("", "the idiot went to a market with the stupid clown and sat down there")], "lang string, text string")
    r = toxicity.Restorer(quality.hash_arrays(quality.kneser_ney(quality.count_ngrams(text, 4, across=False), 4), 4))

    def total(s):
        out = 0.0
        for w in s.split():
            padded = "   " + w + " "
            out += sum(r.logp(padded[i - 3 : i], padded[i]) for i in range(3, len(padded)))
        return out

    rng = random.Random(12)
    for _ in range(60):
        seen = "".join(rng.choice("idot1!0.- st@e") for _ in range(rng.randint(1, 7))).strip()
        want = max(total(s) - cost for s, cost in spellings(seen))
        got = r.restore(seen)
        assert max(total(s) - cost for s, cost in spellings(seen) if " ".join(s.split()) == got) == pytest.approx(want)


def test_quick_test_passes_over_no_feature():
    none = np.empty(0, dtype=np.float32)
    r, rng = toxicity.Restorer(quality.Model(np.empty(0, dtype=np.uint64), none, none, 4, 0)), random.Random(1)
    wanted = frozenset(toxicity.features("idiot") + toxicity.features("stupid") + ["=ab"])
    first, passed = toxicity._First(wanted), 0
    for _ in range(5000):
        w = "".join(rng.choice("idot1!0.-s@eab  _$|*,") for _ in range(rng.randint(1, 9))).strip()
        if w and first.nothing(w):
            passed += 1
            assert not wanted.intersection(f for p in r.words(w) for f in toxicity.features(p))
    assert passed > 100


def test_scores_held_out_and_leaves_labels_alone(spark):
    rng = random.Random(4)
    data = []
    for i in range(600):
        words, y = prose(rng, 60).split(), i % 6 == 0
        if y:
            for w in rng.sample(["idjot", "scumbag", "trashy"], 2):
                words.insert(rng.randrange(60), w)
        data.append((i, " ".join(words), int(y)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, ""), (901, None), (None, "idjot scumbag"), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5] + [(3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 604
    held = [(r["predicted"], data[r["doc_id"]][2]) for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


# --- 3 suffixes ----------------------------------------------------------------------------------


def removed(pairs, length):
    seen, out = set(), {}
    for key, raw in pairs:
        cover = bytearray(len(raw))
        fresh = []
        for p in range(len(raw) - length + 1):
            g = raw[p : p + length]
            if g in seen:
                cover[p : p + length] = b"\1" * length
            seen.add(g)
        out[key] = (len(raw), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(c for c, f in zip(raw, cover) if not f)).hexdigest())
    return out


def test_dedup_is_brute_force(spark):
    rng = random.Random(6)
    shared = [prose(rng, 60) for _ in range(6)]
    texts = [" ".join(rng.choice(shared)[rng.randint(0, 80) : rng.randint(150, 400)] if rng.random() < 0.5 else prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    texts += ["z" * 1000, "z" * 99, "z" * 100, "ab" * 300, "", None, "é" * 200, texts[0], texts[3] + "!", "line of a page\n" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    want = removed([(i, (t or "").encode()) for i, t in enumerate(texts)], 100)
    for crowd in (1000, 3):
        runs = suffixes.repeated_runs(df.select(F.col("doc_id").alias("rid"), F.coalesce("text", F.lit("")).cast("binary").alias("raw")), crowd=crowd).collect()
        by = defaultdict(list)
        for r in runs:
            by[r["rid"]].append((r["p"], r["n"]))
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            left, n, k, _ = suffixes.cut(raw, by[i], 100)
            assert (len(raw), n, k, hashlib.sha256(left).hexdigest()) == want[i]


def test_dedup_with_repeated_keys(docs, rows):
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    got = suffixes.dedup(docs).collect()
    assert len(got) == len(rows)
    want = removed([(k, k[1].encode()) for k in order if k[0] != 3], 100)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 3:
            text = next(x[1] or "" for x in rows if x[0] == r["doc_id"])
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], text]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


# --- 4 quality -----------------------------------------------------------------------------------


def test_base_counts():
    text = "a b c a b c\n# x\n\n# x\n \n \u00a0\n\u00a0"
    words, chars, symbols, dup, repeat = quality.base_counts(text)
    assert (len(words), chars, symbols, dup, repeat) == (12, 12, 2, 1, 6)
    assert quality.base_counts(None)[1:] == (0, 0, 0, 0) and quality.base_counts("a a a a")[4] == 4


def kneser_ney(texts, order):
    """p(last symbol | context) by the book, for all n-grams."""
    tables = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        s = " " * (order - 1) + " ".join(t.split()) + " "
        for i in range(order - 1, len(s)):
            tables[order][s[i - order + 1 : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        for g in tables[k + 1]:
            tables[k][g[1:]] += 1
    def disc(k):
        n = [sum(v == i for v in tables[k].values()) for i in range(1, 5)]
        y = n[0] / max(1, n[0] + 2 * n[1])
        return [max(0.1, min(i - 0.1, i - (i + 1) * y * n[i] / max(1, n[i - 1]))) for i in (1, 2, 3)]
    d = {k: disc(k) for k in tables}
    def p(g):
        k = len(g)
        low = p(g[1:]) if k > 1 else 1 / 65536
        same = {x: v for x, v in tables[k].items() if x[:-1] == g[:-1]}
        if not same:
            return low
        total = sum(same.values())
        off = {x: d[k][min(v, 3) - 1] for x, v in same.items()}
        return (max(0, same.get(g, 0) - off.get(g, 0)) + sum(off.values()) * low) / total
    return lambda t: sum(np.log(p(s[i - order + 1 : i + 1])) for s in [" " * (order - 1) + " ".join(t.split()) + " "] for i in range(order - 1, len(s)))


PROSE = ["the then than that hat at a that the cat sat on the mat", "banana  bandana\n😀x the mat sat", "\tthe cat"]


def test_language_model_is_kneser_ney(spark):
    df = spark.createDataFrame([("", t) for t in PROSE], "lang string, text string")
    model = quality.hash_arrays(quality.kneser_ney(quality.count_ngrams(df, 5), 5), 5)
    log_p = kneser_ney(PROSE, 5)
    for t in (*PROSE, "that cat zzz", "😀x thatch", "mat the on"):
        assert model.text_log_probability("", t) == pytest.approx(log_p(t), rel=1e-4)


def test_counts_are_exact_in_any_script(spark):
    rng = random.Random(2)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(9000)) + " end", "short 一丁 😀", "a b  c\n" * 50, None, "", " "]
    df = spark.createDataFrame([("en", t) for t in texts] + [(None, "a b")], "lang string, text string").repartition(3)
    for order in (3, 5, 6):
        want = Counter()
        for t in texts:
            s = " " * (order - 1) + " ".join((t or "").split()) + " "
            want.update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s) if (t or "").split() else 0))
        got = quality.count_ngrams(df, order).collect()
        assert {r["gram"]: r["n"] for r in got if r["lang"] == "en"} == want and sum(r["n"] for r in got if r["lang"] == "") == 4 and len(got) == len({(r["lang"], r["gram"]) for r in got})


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    text = "".join(random.Random(3).choice("ab  c\n") for _ in range(5000))
    def grams(limit):
        monkeypatch.setattr(quality, "_LONG", limit)
        out = Counter()
        for part in quality._pieces(text, 5):
            codes, at, _ = quality.symbols([part], 5)
            out.update(tuple(codes[a - 4 : a + 1].tolist()) for a in at.tolist())
        return out
    assert grams(700) == grams(13) == grams(10**6)
    text = "one" + " " * 50 + "two"  # white space that fills whole parts keeps what is before it
    assert grams(700) == grams(7)


def test_order_of_words_counts(spark):
    rng = random.Random(7)
    words = [prose(rng, 1) for _ in range(30)]
    follow = {w: rng.sample(words, 2) for w in words}
    def text():
        w = rng.choice(words)
        out = [w]
        for _ in range(150):
            w = rng.choice(follow[w])
            out.append(w)
        return out
    texts = [text() for _ in range(60)]
    df = spark.createDataFrame([("en", " ".join(t)) for t in texts], "lang string, text string")
    model = quality.hash_arrays(quality.kneser_ney(quality.count_ngrams(df, 5), 5), 5)
    for t in texts[:10]:
        assert model.text_log_probability("en", " ".join(rng.sample(t, len(t)))) < model.text_log_probability("en", " ".join(t))


def test_a_model_larger_than_the_broadcast_is_joined(docs):
    columns = lambda df: sorted((str(r["doc_id"]), r["n_words"], r["kept"], round(r["log_ppl"] or 0, 6), round(r["low"] or 0, 3)) for r in df.collect())
    whole = columns(quality.judge(docs))
    assert columns(quality.judge(docs, broadcast_entries=300)) == whole and columns(quality.judge(docs, broadcast_entries=0)) == whole


def test_other_languages_leave_verdicts_alone(spark, docs):
    other = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.md5((F.col("id") * 31 + i).cast("string")) for i in range(60)]).alias("text"), F.lit("xx").alias("lang"))
    mine = docs.select("doc_id", "text", "lang")
    key = lambda df: Counter((r["doc_id"], r["lang"], r["kept"], r["log_ppl"]) for r in df.collect() if r["lang"] != "xx")
    assert key(quality.judge(mine)) == key(quality.judge(mine.union(other)))


def test_quality_rows(docs, rows):
    got = quality.judge(docs).collect()
    want = Counter()
    for r in rows:
        words, lines, three = WORD.findall(r[1] or ""), Counter(), Counter()
        dup = sum(1 for line in (r[1] or "").split("\n") if WORD.search(line) and (lines.update([line]) or lines[line] > 1))
        three.update(zip(words, words[1:], words[2:]))
        inside = {i + j for i, x in enumerate(zip(words, words[1:], words[2:])) if three[x] > 1 for j in range(3)}
        want[r[0], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in r[1] or ""), dup, len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"]) and any(r["kept"] for r in got)
    assert all(r["kept"] == (r["low"] <= r["log_ppl"] <= r["high"]) for r in got if not r["base_failed"])


# --- 5 near-duplicates ---------------------------------------------------------------------------


def classes(pairs, nodes):
    own = {n: n for n in nodes}
    def root(x):
        while own[x] != x:
            x = own[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        own[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    nodes = {x for p in pairs for x in p}
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == classes(pairs, nodes)


def variants(rng, n, words=80, edits=6):
    base = prose(rng, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(9)
    line = prose(rng, 12)
    texts = variants(rng, 120) + variants(rng, 4) + [line + " " + prose(rng, 8) for _ in range(80)] + ["A b c", "a B c", "a b", "", None, "a b c d e", "A B C D E"]
    sets = {i: neardup.shingle_set(t, 4) for i, t in enumerate(texts)}
    want = classes([(a, b) for a, b in itertools.combinations(sets, 2) if neardup.linked(sets[a], sets[b], 80)], sets)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = neardup.find(df, shingle=4, leaf=6, chunk=30).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(docs, rows):
    got = neardup.find(docs).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1)} == {0} and all(r["kept"] for r in got if r["doc_id"] in (4, 5, 6, None))


# --- 6 urls --------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://www.example.com/en/x?y", "HTTP://A.EXAMPLE.COM/en/", "https://x.com", "https://x.com/", None, "", "no scheme", "a://b.net/es/z#f", "http://spam-farm.org/a", "http://notspam-farm.org/a", "http://casino.org?x://y.com/", "http://my-casino.org/", "http://x.org/payday-loan/", "http://x.org/paydays/"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("x.com", "", None, "allow") and got[3][2] == "com/" and got[4] == got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("b.net", "/es/z", "net/es/", "block")
    assert [got[i][3] for i in (8, 9, 10, 11, 12, 13)] == ["block", "allow", "block", "block", "block", "allow"]


def test_long_rule_lists_join(spark, monkeypatch):
    urls = spark.createDataFrame([(i, f"http://{h}.org/{p}") for i, (h, p) in enumerate(itertools.product(("spam-farm", "casino", "fine"), ("a", "wp-login.php")))] + [(99, None)], "page_id long, url string")
    short = {r["page_id"]: r["r"] for r in url_rules.pattern_verdict(urls, out="r").collect()}
    monkeypatch.setattr(url_rules, "IN_ROW", 0)
    assert {r["page_id"]: r["r"] for r in url_rules.pattern_verdict(urls, out="r").collect()} == short


def test_url_query_is_its_sql(spark, tmp_path):
    registry.op6_url_rules(spark, SF).write.parquet(str(tmp_path / "o"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    sql, out, cols = registry.ORACLE_SQL["op6_url_rules"], f"'{tmp_path}/o/*.parquet'", "page_id, host, path, rule, verdict"
    assert c.execute(f"select {cols} from ({sql}) except all select {cols} from {out}").fetchall() == []
    assert c.execute(f"select {cols} from {out} except all select {cols} from ({sql})").fetchall() == []


# --- 7 vectors -----------------------------------------------------------------------------------


def test_vector_links_are_brute_force(spark):
    rng = np.random.default_rng(2)
    v = [rng.normal(size=32) for _ in range(150)]
    v += [v[0] + rng.normal(size=32) * s for s in np.linspace(0.02, 0.14, 60)] + [v[5], v[5], 2 * v[5]]
    rows = [(i, [float(x) for x in np.float32(x)]) for i, x in enumerate(v)]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] + [1.0] * 31), (904, []), (905, [1.0] * 8), (906, [1.0] * 8)]
    x = {i: np.array(r) / np.linalg.norm(r) for i, r in rows if i < 900 or i > 904}
    pairs = [(a, b) for a, b in itertools.combinations(x, 2) if len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.9]
    own, n = classes(pairs, [i for i, _ in rows]), Counter(i for p in pairs for i in p)
    got = vectors.find(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), chunk=16).collect()
    found, there = sum(r["n_links"] for r in got), 2 * len(pairs)
    assert 0.99 * there <= found <= there and len(got) == len(rows)
    assert all(r["n_links"] <= n[r["vec_id"]] for r in got)
    assert sum(r["component_id"] == own[r["vec_id"]] for r in got) >= 0.99 * len(rows)


def test_hadamard_is_orthogonal():
    h = vectors.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, 16 * np.eye(16))


# --- 8 shards ------------------------------------------------------------------------------------


def test_matrix_is_hypergeometric():
    counts = [5, 0, 100, 37]
    m = sharding.communication_matrix(counts, 7, 1)
    assert m.sum(axis=1).tolist() == counts and max(m.sum(axis=0)) - min(m.sum(axis=0)) <= 1
    mean = np.mean([sharding.communication_matrix([10, 30], 4, s)[0] for s in range(2000)], axis=0)
    assert np.allclose(mean, 2.5, atol=0.12)
    rng, left = np.random.default_rng(0), np.array([50, 30, 20])
    assert np.allclose(np.mean([sharding._draw(rng, left, 10) for _ in range(2000)], axis=0), [5, 3, 2], atol=0.15)


def test_shuffle(docs, rows):
    df = docs.select("doc_id", "text", "size")
    got = sharding.shuffle(df, ["doc_id", "text"], shards=6, rows_per_partition=5).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shuffle(df.repartition(3), ["doc_id", "text"], shards=6, rows_per_partition=5).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


# --- 9 secrets -----------------------------------------------------------------------------------


def base_spans(text):
    out = []
    for k, (kind, pattern, flags) in enumerate((("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0), ("hex", r"[0-9a-f]+", 0))):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_base_spans_stay(spark):
    texts = ["token = 'abc'", "Token: abcdef api_key=token=123456", "é\U0001f600 password=\"x1y2z3w4\" AKIA" + "A" * 16, "a" * 24, "a" * 23, "AKIA123", None, "", "pAsSwD:0123456789abcdef0123456789", "toKen=abcdefg", "secret\n=abcdefg"]
    got = {r["doc_id"]: r for r in secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        base = ",".join(s for s in got[i]["spans"].split(",") if s and not s.startswith("guess"))
        assert base == base_spans(t) and got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_guess_costs():
    for weak in ("", "password123", "changeme", "qwertyuiop", "2024-01-05", "aaaaaaaaaaaa", "P@ssw0rd", "abcabcabcabc"):
        assert secrets.guess_cost(weak) < 8
    for strong in ("x9$Kd!2mQz", "24be64439e3ecd11", "Tr0ub4dor&3xQ"):
        assert secrets.guess_cost(strong) > 12
    assert [k for *_, k in secrets.scan("pwd: x9$Kd!2mQz7")] == ["guess"] and secrets.scan("pwd: password123") == []


def test_redaction():
    t = 'my password="x1y2z3w4v5" and AKIA' + "B" * 16 + "."
    assert secrets.redact(t, secrets.scan(t)) == 'my [secret]" and [secret].' and secrets.redact(None, []) is None


# --- 10 pieces -----------------------------------------------------------------------------------

TOY = [("<unk>", 0.0, "s"), ("▁a", -1.0, "n"), ("▁", -3.0, "n"), ("a", -4.0, "n"), ("ab", -2.0, "n"), ("b", -4.0, "n"), ("abc", -9.0, "n"), ("▁▁", -2.0, "n"), ("c", -3.0, "n")] + [(f"<0x{i:02X}>", -20.0, "b") for i in range(256)]


def brute_path(codec, s):
    best = [(0.0, ())]
    for i in range(1, len(s) + 1):
        c = s[i - 1]
        opts = [(best[i - 1][0] + codec.penalty * len(c.encode()), best[i - 1][1] + tuple(codec.byte_id[b] for b in c.encode()))]
        for k, (p, score, kind) in enumerate(TOY):
            p = p.replace("▁", " ")
            if kind == "n" and s[:i].endswith(p):
                opts.append((best[i - len(p)][0] + score, best[i - len(p)][1] + (k,)))
        best.append(max(opts, key=lambda o: o[0]))
    return best[-1]


def test_viterbi_is_brute_force():
    codec, rng = pieces.Codec(TOY), random.Random(5)
    for _ in range(300):
        s = "".join(rng.choice("aabbc  é\n") for _ in range(rng.randint(0, 12)))
        ids = codec.encode(s)
        assert codec.decode(ids) == s
        if s:
            total = sum(TOY[i][1] if TOY[i][2] == "n" else codec.penalty for i in ids)
            assert total == pytest.approx(brute_path(codec, " " + s)[0])


def test_round_trip(docs, rows):
    got = pieces.encode_and_check(docs, keep_ids=True).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], dtype="<i4").tobytes()).hexdigest() for r in got)
    back = pieces.decode(pieces.encode(docs.select("doc_id", "text")).withColumnRenamed("text", "was"))
    assert all(r["text"] == r["was"] for r in back.collect())


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark, docs, rows):
    import corpus_pipeline as cp

    x, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        y = stage(spark, x, SF)
        seen.append(y.collect())
        if k < 4:
            assert y.columns == list(cp.COLUMNS)
        x = spark.createDataFrame(seen[-1], y.schema)
    ids = [{r["doc_id"] for r in s} for s in seen]
    assert ids[1] <= ids[0] and ids[2] == ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    sets = {r["doc_id"]: neardup.shingle_set(r["text"], 5) for r in seen[0]}
    own = classes([(a, b) for a, b in itertools.combinations(sets, 2) if neardup.linked(sets[a], sets[b], 80)], sets)
    assert ids[1] == {i for i in sets if own[i] == i}
    assert all(not base_spans(r["text"]) for r in seen[2])
    codec = pieces.Codec(pieces.read_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in seen[3]}
    assert all(codec.decode(r["ids"]) == texts[r["doc_id"]] for r in seen[4])
    assert len(cp.quality_rules(spark, docs, SF).collect()) <= len(rows)
