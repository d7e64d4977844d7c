"""Vector codes, containment and conversation repair against plain versions, on odd and on given rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomspark.llm import codes, containment, registry, repair

from ..conftest import SF

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MOST = 2**63 - 1


def plain_codes(rows):
    kept = [(i, [math.floor(4096 * x) for x in v], n) for i, v, n in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 8))
    kept = [(i, v + [0] * (8 * width - len(v)), n) for i, v, n in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(book)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for i, v, n in kept:
        found = [near(cut(v, p), b) for p, b in enumerate(books)]
        total[n] = total.get(n, 0) + sum(d for d, _ in found)
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), n))
    return [(i, c, min(e, MOST), min(total[n], MOST), sha) for i, c, e, n in out]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


VECTORS = "vec_id long, embedding array<double>, label int, error string, code string"


def vectors():
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), [rng.choice([0.0, 1.5, -2.25, rng.gauss(0, 1)]) for _ in range(rng.choice([16, 16, 11]))], rng.choice([None, 1, 2])) for _ in range(120)]
    return rows + [rows[0], (3, None, 1), (4, [None, 1.0], 1), (5, [float("inf")], 2), (6, [float("nan")] * 16, 2), (-1, [], None)]


@pytest.mark.parametrize("more", [[], [(50, [1e30] + [0.5] * 15, 2)], [(51, [-1e300] * 16, 2)], [(-9, [1e9] * 16, 2), (-8, [-1e9] * 16, 1)]])
def test_codes_match_the_plain_version(spark, more):
    """Nulls, repeated ids, short and empty vectors, equal distances; components past 64 bits, in codebooks too."""
    rows = vectors() + more
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(5)
    got = codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert order(got) == order(plain_codes(rows))


def test_codes_of_few_and_no_rows(spark):
    one = [(1, [0.5] * 8, None)]
    assert order(codes.compress(spark.createDataFrame([(*one[0], "x", "y")], VECTORS)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == plain_codes(one)
    assert codes.compress(spark.createDataFrame([], VECTORS)).collect() == []


def test_annulus_leaves_entries_out_and_loses_none():
    import numpy as np

    rng = np.random.default_rng(1)
    table = (rng.normal(size=(16, 8)) * rng.integers(1, 2000, (16, 1))).astype(int)
    book = codes.Book(table.tolist(), 2**26)
    x = (rng.normal(size=(500, 8)) * rng.integers(1, 2000, (500, 1))).astype(np.int64)
    index, best = book.nearest(x)
    far = ((x[:, None, :] - table[None]) ** 2).sum(2)
    assert (best == far.min(1)).all() and (index == far.argmin(1)).all()
    assert [book.nearest_wide(v) for v in x[:50].tolist()] == list(zip(index[:50].tolist(), best[:50].tolist()))


def test_digits_add_up_to_any_integer():
    for v in (0, 1, -1, 2**40, -(2**40), 2**63, -(2**200) + 12345, 10**50):
        assert sum(d << (codes.LIMB * k) for k, d in enumerate(codes._limbs(v))) == v


def plain_containment(docs, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: WORD.findall((t or "").translate(low))
    windows = {}
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(k)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0))
    return out


ITEMS = [(1, "Alpha, beta"), (2, "one"), (3, ""), (4, None), (5, " a b c d e f g h i j k l "), (6, "b c d e f g h i j k"), (None, "zeta eta theta"), (5, "x y z"), (7, "a " * 12), (8, "x\u0085 y"), (9, "B c D e f g h i j K l")]
DOCS = [
    (1, "alpha beta"), (2, "Alpha--BETA one ONE"), (None, "zeta eta theta x y z"), (3, None), (4, ""), (5, "q a b c d e f g h i j k l"), (5, "a " * 30), (6, "foo, x\u0085 y,\u0085"), (7, "... "),
    (8, "alpha beta"), (9, "a b c d e f g h i j"), (10, "b c d e f g h i j"), (11, "word " * 30_000 + "a b c d e f g h i j k"), (12, "É1 été x y z"),
]


def test_containment_matches_the_plain_version(spark):
    docs = spark.createDataFrame([(*d, 1, "x") for d in DOCS + DOCS[:3]], "doc_id long, text string, item_id long, words string").repartition(4)
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id long")
    assert order(containment.find(docs, items).collect()) == order(plain_containment(DOCS + DOCS[:3], ITEMS))


def test_containment_by_shuffle_is_the_same(spark, monkeypatch):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(containment, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert order(containment.find(docs, items).collect()) == order(plain_containment(DOCS, ITEMS))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_containment_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert containment.find(docs.limit(0), items).collect() == []
    assert order(containment.find(docs, items.limit(0)).collect()) == order(plain_containment(DOCS, []))


def test_containment_runs_no_python(spark):
    plan = registry.op12_prefix_containment(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def hurt(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(fate, x)
        out += [(c, t, "user" if fate == 4 else r, x)] * {0: 0, 3: 2}.get(fate, 1)
    return out


FOLLOW = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows, faults):
    """(cost, audit, repaired lines) over all edits, without states kept apart by anything but the last initial."""
    best = {"": (0, "", ())}

    def insert():
        for _ in range(3):
            for at, (cost, audit, lines) in list(best.items()):
                for c, name in FULL.items():
                    if (to := FOLLOW.get((at, c))) and (way := (cost + 3, audit + "I", (*lines, name + ":"))) < best.get(to, (math.inf,)):
                        best[to] = way

    for (role, text), fault in zip(rows, faults):
        insert()
        new = {}
        for at, (cost, audit, lines) in best.items():
            ways = [(at, (cost + 4, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = cost + 3 * (fault == "truncated")
                ways += [(to, (more, audit + "K", (*lines, f"{role}:{text}"))) for to in [FOLLOW.get((at, role[:1]))] if to]
                ways += [(to, (more + 3, audit + "R", (*lines, f"{name}:{text}"))) for c, name in FULL.items() for to in [FOLLOW.get((at, c))] if to]
            for to, way in ways:
                new[to] = min(new.get(to, (math.inf,)), way)
        best = new
    insert()
    return min(best[s] for s in ("", "a") if s in best)


def plain_repair(rows, tie):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in hurt(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], tie[r[3]], r[3]))
        turns, seen, faults = [r[1] for r in mine if r[1] is not None], set(), []
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest([r[2:] for r in mine], faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, cost string, at long, kind int"


def test_repair_matches_the_plain_version(spark):
    """Null, empty and odd roles and texts, null and repeated turns, one conversation of thousands of rows, several levels of pieces."""
    rng, rows = random.Random(5), []
    for conv in [None, *range(60)]:
        for i in range(3000 if conv == 7 else rng.choice([1, 2, 3, 5, 9, 20, 70])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([None, i, i, i, i, i, i]), role, rng.choice(["Fine. ", "ok", "Yes!", "", " \n", None, f"word {i}.", f"Why? {i}", f"unended {i}", f"é {i}?\x0b"])))
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).repartition(6)
    texts = spark.createDataFrame([(x,) for x in {r[3] for r in hurt(rows)}], "t string")
    tie = {r[0]: r[1] for r in texts.select("t", F.xxhash64("t")).collect()}
    assert order(repair.repair_damaged(df).collect()) == order(plain_repair(rows, tie))


def test_repair_of_no_rows_and_dropped_rows(spark):
    assert repair.repair_damaged(spark.createDataFrame([], TURNS)).collect() == []
    gone = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out = repair.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", "x", 1, 2)], TURNS)).collect()
    assert [tuple(r) for r in out] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_leaves_good_conversations_alone(spark):
    rows = [(c, t, r, f"Text {c} {t}.") for c in range(5) for t, r in enumerate(["system", "user", "assistant"] if c else ["user", "assistant"] * 200)]
    out = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.cost, r.illegal, r.gaps, set(r.audit) == {"K"}) for r in out} == {(0, 0, 0, True)}
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for c, _, r, x in rows if c == 3).encode()).hexdigest()
    assert next(r for r in out if r.conv_id == 3).repaired_sha256 == sha


@pytest.mark.parametrize("name", ["op11_annular_codes", "op12_prefix_containment", "op13_conversation_repair"])
def test_queries_match_their_sql(spark, tmp_path, name):
    import os

    import duckdb

    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    registry.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    out, sql = f"'{tmp_path}/out/*.parquet'", f"({registry.ORACLE_SQL[name]})"
    cols = ",".join(sorted(x[0] for x in duck.execute(f"describe select * from {out}").fetchall()))
    for a, b in ((sql, out), (out, sql)):
        assert duck.execute(f"select * from (select {cols} from {a} except all select {cols} from {b}) limit 3").fetchall() == []
