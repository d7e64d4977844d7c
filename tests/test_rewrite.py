"""A transcript stays readable whatever step of its rewrite a crash ends; sequence predictions against a plain version."""

import os
import random
import shutil
from collections import Counter

import pytest

from loomspark.operators import reports
from loomspark.sources import files


def lines(spark, *names):
    return [spark.createDataFrame([(i, f'{{"type":"message","id":"{n}"}}') for i, n in enumerate(names)], "seq int, raw string")]


def ids(spark, path):
    return [r["id"] for r in files.read_transcript(spark, path).collect()]


@pytest.mark.parametrize("step", ["writing", "written", "old moved", "old moved, new torn", "new moved"])
def test_a_crash_leaves_a_whole_transcript(spark, tmp_path, step):
    path = str(tmp_path / "t")
    files.write_transcript(lines(spark, "a", "b"), path)
    files.write_transcript(lines(spark, "c"), str(tmp_path / "other"))
    shutil.move(str(tmp_path / "other"), f"{path}.new")
    if step in ("writing", "old moved, new torn"):
        os.remove(f"{path}.new/_SUCCESS")
    if step.startswith("old moved"):
        shutil.move(path, f"{path}.old")
    if step == "new moved":
        shutil.move(path, f"{path}.old")
        shutil.move(f"{path}.new", path)
    want = ["c"] if step in ("old moved", "new moved") else ["a", "b"]
    assert ids(spark, path) == want == ids(spark, path)
    files.write_transcript(lines(spark, "d", "e"), path)
    assert ids(spark, path) == ["d", "e"]
    assert sorted(os.listdir(tmp_path)) == ["t"]


def test_a_move_that_fails_is_told(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.swap(spark, str(tmp_path / "no.new"), str(tmp_path / "no"))
    files.recover(spark, str(tmp_path / "no"))
    assert os.listdir(tmp_path) == []


def test_sequences_are_plain(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(6) or None, i, i // 4, rnd.choice([None, *range(14)])) for i in range(300)]
    got = {}
    df = spark.createDataFrame(rows, "who int, i int, unit int, key int")
    for r in reports.sequence_next(df, "who", "i", "unit", "key", recent=5).collect():
        got.setdefault(r["who"], []).append((r["rank"], r["key"], r["n"], r["confidence"]))
    held = {}
    for _, _, u, k in rows:
        if k is not None:
            held.setdefault(u, set()).add(k)
    pairs = Counter((a, b) for s in held.values() for a in s for b in s if a != b)
    assert None not in got
    for who in {r[0] for r in rows} - {None}:
        keys = [k for w, _, _, k in rows if w == who and k is not None][-5:]
        n = Counter()
        for a in keys[-3:]:
            for b in range(14):
                if b not in keys:
                    n[b] += pairs[a, b]
        best = sorted(((-c, k) for k, c in n.items() if c))[:5]
        assert sorted(got[who]) == [(i + 1, k, -c, min(0.5, c / best[0][0])) for i, (c, k) in enumerate(best)]
    none = reports.sequence_next(df.filter("i < 0"), "who", "i", "unit", "key")
    assert none.count() == 0
