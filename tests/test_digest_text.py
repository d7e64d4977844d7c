"""Digest text: its two forms, reading back, bad lines, merging, cutting, and a whole round against a plain version."""

import json
import math
import random
import re

import pytest

from loomspark.operators import digest_text as dt

KEYS = ["session_id", *dt.COLUMNS]
SCHEMA = "session_id string, " + dt.ENTRY


def entry(section, seq, head, tail=None, note=None, msg="m1", snippet="some snippet", confidence=0.8, round_=1, kind=None, n=None, s="s1"):
    return (s, section, seq, head, tail, note, msg, None if section == "claim" else snippet, confidence, round_, kind, n)


ALL = [
    entry("confirmed", 1, "We use Postgres", note="team"), entry("confirmed", 2, "Cache is on", note="unknown"), entry("confirmed", 3, "x" * 300, snippet="y" * 120),
    entry("rejected", 1, "Redis", "too slow"), entry("rejected", 2, "Files", ""), entry("pitfalls", 1, "Json.read", "fails on empty: input", "use Json.parse"), entry("pitfalls", 2, "load()", "throws"),
    entry("claim", 1, 'quote " and \\ back', "the span\nof it", msg="e1", kind="decision", confidence=0.9, n=4), entry("claim", 2, "中文 claim", "span", msg="e2", kind="other", confidence=None, round_=7), entry("claim", 3, "sure", "span", msg="e3", kind="fact", confidence=1.0),
]


def test_the_form(spark):
    text = dt.render(spark.createDataFrame(ALL, SCHEMA)).first().digest.split("\n")
    assert text[:3] == [dt.PREFIX_V2, "-- 已确认 --", "- We use Postgres (actor: team) [src m1: some snippet]"]
    assert text[3] == "- Cache is on [src m1: some snippet]"
    assert text[4] == "- " + "x" * 160 + "... [src m1: " + "y" * 80 + "...]"
    assert text[5:8] == ["-- 已否决 --", "- Redis: too slow [src m1: some snippet]", "- Files [src m1: some snippet]"]
    assert text[8:11] == ["-- API 契约与坑 --", "- Json.read: fails on empty: input (workaround: use Json.parse) [src m1: some snippet]", "- load(): throws [src m1: some snippet]"]
    assert text[11] == "@claims 3 s1"
    assert json.loads(text[12][7:]) == {"k": "decision", "e": "e1", "r": 1, "c": 0.9, "n": 4, "s": 'quote " and \\ back', "q": "the span\nof it"}
    assert text[13] == '@claim {"k":"other","e":"e2","r":7,"s":"中文 claim","q":"span"}'
    assert '"c":1,' in text[14]
    assert dt.render(spark.createDataFrame(ALL[:1], SCHEMA)).first().digest.startswith(dt.PREFIX_V1)


def test_reading_back(spark):
    texts = dt.render(spark.createDataFrame(ALL, SCHEMA))
    back = sorted(map(tuple, dt.parse(texts).drop("seq").collect()), key=str)
    keep = [c for c in KEYS if c != "seq"]
    want = []
    for e in ALL:
        r = dict(zip(KEYS, e))
        if r["section"] != "claim":
            r |= {"confidence": 0.75, "round": 0, "head": r["head"][:160] + "..." * (len(r["head"]) > 160), "snippet": r["snippet"][:80] + "..." * (len(r["snippet"]) > 80)}
            r["note"] = None if r["note"] == "unknown" else r["note"]
        want.append(tuple(r[c] for c in keep))
    assert back == sorted(want, key=str)
    assert dt.render(dt.parse(dt.render(dt.parse(texts)))).first() == dt.render(dt.parse(texts)).first()


@pytest.mark.parametrize(
    "lines, found",
    [
        (["- no section [src m: s]"], 0), (["-- 已确认 --", "- one [src m: s]", "free text", "- two [src m s]", "-  [src m: s]", "- long [src m: " + "s" * 201 + "]"], 1),
        (['@claim {"k":"fact","e":"a","r":1,"s":"x","q":"y"}', '@claim {"k":"odd","e":"a","r":1,"s":"x","q":"y"}', "@claim {bad", '@claim {"k":"fact","e":5,"r":1,"s":"x","q":"y"}', '@claim {"k":"fact","e":"a","r":"1","s":"x","q":"y"}', '@claim {"k":"fact","e":"a","r":1,"s":"","q":"y"}', "@claim [1]", '@claim {"k":"fact","e":"a","r":1,"s":"x","q":"' + "q" * 513 + '"}'], 1),
        (["-- 已否决 --", "- a: b: c [src m: s]  "], 1), ([], 0),
    ],
)
def test_bad_lines_are_passed_over(spark, lines, found):
    df = spark.createDataFrame([("s1", "\n".join([dt.PREFIX_V2, *lines])), ("s2", "\n".join(["other", *lines])), ("s3", None), ("s4", "")], "session_id string, digest string")
    assert dt.parse(df).count() == found


def plain_merge(old, new):
    out = {}
    for gen, rows in ((0, old), (1, new)):
        for r in sorted(rows, key=lambda r: r["seq"]):
            norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
            text = r["head"] if r["section"] in ("confirmed", "claim") else f"{r['head']}|{r['tail'] or ''}"
            key = (r["section"], f"{r['msg_id']}|{norm(text)}" if r["section"] == "claim" else norm(text))
            before = out.get(key)
            r = dict(r)
            if before and gen and r["section"] != "claim":
                r["confidence"] = max(before["confidence"], r["confidence"])
            out[key] = r
    lists = {}
    for (section, _), r in out.items():
        lists.setdefault(section, []).append(r)
    if "claim" in lists:
        lists["claim"] = lists["claim"][-60:]
    return lists


def tokens(s):
    wide = len(re.findall("[一-鿿㐀-䶿豈-﫿]", s))
    return max(1, math.ceil((wide * 1.5 + (len(s) - wide) * 0.25) * 1.1)) if s else 0


def plain_line(r):
    clip = lambda s, m: s if len(s) <= m else s[:m] + "..."
    src = f" [src {r['msg_id']}: {clip(r['snippet'], 80)}]" if r["section"] != "claim" else ""
    if r["section"] == "confirmed":
        return f"- {clip(r['head'], 160)}" + (f" (actor: {r['note']})" if r["note"] and r["note"] != "unknown" else "") + src
    if r["section"] == "rejected":
        return f"- {clip(r['head'], 160)}" + (f": {clip(r['tail'], 160)}" if r["tail"] else "") + src
    if r["section"] == "pitfalls":
        return f"- {clip(r['head'], 120)}: {clip(r['tail'], 160)}" + (f" (workaround: {clip(r['note'], 80)})" if r["note"] else "") + src
    obj = {"k": r["kind"], "e": r["msg_id"], "r": r["round"], "c": r["confidence"], "n": r["n"], "s": r["head"], "q": r["tail"]}
    return "@claim " + json.dumps({k: v for k, v in obj.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))


def plain_text(lists, s):
    out = []
    for name, title in dt.SECTIONS.items():
        if lists.get(name):
            out += [title, *map(plain_line, lists[name])]
    claims = lists.get("claim") or []
    if claims:
        out += [f"@claims {len(claims)} {s}", *map(plain_line, claims)]
    return "\n".join([dt.PREFIX_V2 if claims else dt.PREFIX_V1, *out]) if out else None


def plain_cut(lists, most, s):
    tiers = {"pitfalls": 1, "confirmed": 2, "rejected": 3}
    while True:
        rows = [(r, tiers[n], 0) for n in ("confirmed", "rejected", "pitfalls") for r in lists.get(n, [])] + [(r, dt.CLAIM_TIERS[r["kind"]], 1) for r in lists.get("claim", [])]
        if not rows:
            return lists
        cost = sum(tokens(plain_line(r)) + 1 for r, _, _ in rows) + (tokens(f"@claims {len(lists['claim'])} {s}") + 1 if lists.get("claim") else 0)
        if cost <= most and tokens(plain_text(lists, s)) <= most:
            return lists
        worst = min(rows, key=lambda x: (x[1], x[2], x[0]["confidence"] or 0, x[0]["round"]))[0]
        lists[worst["section"]] = [r for r in lists[worst["section"]] if r is not worst]


def random_entries(rng, s, n):
    words = lambda k: " ".join(rng.choice(["alpha", "Beta", "缓存", "gate", "x"]) for _ in range(k))
    out = []
    for i in range(n):
        section = rng.choice(["confirmed", "rejected", "pitfalls", "claim"])
        note = {"confirmed": rng.choice([None, "team", "user"]), "pitfalls": rng.choice([None, "do it"])}.get(section)
        tail = {"rejected": rng.choice(["", words(2)]), "pitfalls": words(3), "claim": words(2)}.get(section)
        out.append(entry(section, i, words(rng.randint(1, 3)), tail, note, f"m{rng.randint(1, 4)}", words(2), rng.choice([0.75, 0.8, 0.95]), rng.randint(1, 3), rng.choice(dt.CLAIM_KINDS) if section == "claim" else None, s=s))
    return out


@pytest.mark.parametrize("most", [40, 120, 4096])
def test_a_round_matches_the_plain_version(spark, most):
    rng = random.Random(most)
    old = {f"s{k}": random_entries(rng, f"s{k}", rng.choice([0, 3, 90])) for k in range(8)}
    new = {s: random_entries(rng, s, rng.choice([1, 5, 120])) for s in old}
    make = lambda d: spark.createDataFrame([r for v in d.values() for r in v], SCHEMA).repartition(3)
    got = {r.session_id: r.digest for r in dt.render(dt.truncate(dt.merge(make(old), make(new)), most)).collect()}
    row = lambda r: dict(zip(KEYS, r))
    want = {s: plain_text(plain_cut(plain_merge(map(row, old[s]), map(row, new[s])), most, s), s) for s in old}
    assert got == {s: x for s, x in want.items() if x}


def test_a_round_from_text(spark):
    rng = random.Random(9)
    first = spark.createDataFrame(random_entries(rng, "s1", 30), SCHEMA)
    one = dt.render(first)
    again = dt.next_round(one, first.filter("false"))
    assert again.first().digest == dt.next_round(again, first.filter("false")).first().digest
    assert set(again.first().digest.split("\n")) - set(one.first().digest.split("\n")) <= {x for x in again.first().digest.split("\n") if x.startswith("@claims ")}
    assert dt.next_round(one.filter("false"), first.filter("false")).collect() == []
