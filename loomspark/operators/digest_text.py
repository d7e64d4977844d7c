"""Digest text in full (I20, I21, D16, E13): entries to text and back, merging with the last round's, cutting to capacity.

Entries of all kinds are rows of one table (``ENTRY``): three views (confirmed facts,
rejected approaches, pitfalls) and the claims ledger. Text is made by one aggregation
by session; it is read back without a shuffle, each line under the last section
header before it. Merging is one aggregation by normalized key, cutting one ordered
running sum, so the whole round is a plan over all sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
PREFIX_V1, PREFIX_V2 = "[STRUCTURAL-DIGEST v1]", "[STRUCTURAL-DIGEST v2]"
SECTIONS = {"confirmed": "-- 已确认 --", "rejected": "-- 已否决 --", "pitfalls": "-- API 契约与坑 --"}
CLAIM_KINDS = ("fact", "decision", "pending", "rejected", "pitfall", "other")
ACTORS = ("user", "team", "agent", "unknown")
#: What is cut first: views before claims of the same tier, lower confidence, older rounds.
TIERS = {"pitfalls": 1, "confirmed": 2, "rejected": 3}
CLAIM_TIERS = {"other": 0, "pitfall": 1, "fact": 2, "decision": 2, "rejected": 3, "pending": 3}
MOST_TOKENS, MOST_CLAIMS = 4096, 60
SPAN_CHARS, SNIPPET_CHARS, SNIPPET_SHOWN, ITEM_CHARS, API_CHARS, WORKAROUND_CHARS = 512, 200, 80, 160, 120, 80
REBUILT_CONFIDENCE, REBUILT_ROUND = 0.75, 0
LINE = r"^- (.+?) \[src ([^:]*): ([^\]]*)\]$"
NOTE = r"^(.*?)\s+\((actor|workaround):\s*([^)]+)\)$"
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]"
# ------------------------------------------------------------------------------
#: head, tail and note: claim, -, actor; approach, reason, -; api, pitfall, workaround; claim, span, -. msg_id of a claim is its entry.
ENTRY = "section string, seq long, head string, tail string, note string, msg_id string, snippet string, confidence double, round long, kind string, n long"
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]


def _clip(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def line() -> Column:
    """An entry's line."""
    c = F.col
    source = F.concat(F.lit(" [src "), c("msg_id"), F.lit(": "), _clip(c("snippet"), SNIPPET_SHOWN), F.lit("]"))
    actor = F.when(c("note").isNotNull() & (c("note") != "unknown"), F.concat(F.lit(" (actor: "), c("note"), F.lit(")"))).otherwise("")
    reason = F.when(F.char_length("tail") > 0, F.concat(F.lit(": "), _clip(c("tail"), ITEM_CHARS))).otherwise("")
    around = F.when(F.char_length("note") > 0, F.concat(F.lit(" (workaround: "), _clip(c("note"), WORKAROUND_CHARS), F.lit(")"))).otherwise("")
    item = _clip(c("head"), ITEM_CHARS)
    claim = F.to_json(F.struct(c("kind").alias("k"), c("msg_id").alias("e"), c("round").alias("r"), c("confidence").alias("c"), c("n").alias("n"), c("head").alias("s"), c("tail").alias("q")))
    whole = F.regexp_replace(claim, r'^(\{"k":"[a-z]+","e":"(?:[^"\\]|\\.)*","r":-?\d+,"c":-?\d+)\.0,', "$1,")  # whole numbers have no point
    return (
        F.when(c("section") == "confirmed", F.concat(F.lit("- "), item, actor, source))
        .when(c("section") == "rejected", F.concat(F.lit("- "), item, reason, source))
        .when(c("section") == "pitfalls", F.concat(F.lit("- "), _clip(c("head"), API_CHARS), F.lit(": "), _clip(c("tail"), ITEM_CHARS), around, source))
        .otherwise(F.concat(F.lit("@claim "), whole))
    )


def render(entries: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, digest): the text of each session that has an entry; sections, then claims, each in order of ``seq``."""
    g = entries.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("section", "seq", line().alias("line")))).alias("l"))
    of = lambda s: F.transform(F.filter("l", lambda e: e["section"] == s), lambda e: e["line"])
    under = lambda s: F.when(F.size(of(s)) > 0, F.concat(F.array(F.lit(SECTIONS[s])), of(s))).otherwise(F.array().cast("array<string>"))
    n = F.size(of("claim"))
    head = F.concat(F.lit("@claims "), n.cast("string"), F.lit(" "), F.col(session).cast("string"))
    claims = F.when(n > 0, F.concat(F.array(head), of("claim"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.when(n > 0, PREFIX_V2).otherwise(PREFIX_V1)), *(under(s) for s in SECTIONS), claims)
    return g.select(session, F.array_join(lines, "\n").alias("digest"))


def parse(digests: DataFrame, session: str = "session_id", text: str = "digest") -> DataFrame:
    """(session, ENTRY): the entries of digest texts of both versions; lines that are none are passed over, other texts give nothing.

    Views come back with the confidence and round of rebuilt entries; claims keep theirs.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"\s+$", "")))
    x = digests.filter(F.col(text).startswith(PREFIX_V1) | F.col(text).startswith(PREFIX_V2)).select(session, lines.alias("_lines"))
    name = lambda s: F.coalesce(*(F.when(s == v, k) for k, v in SECTIONS.items()))
    heads = F.filter(F.transform("_lines", lambda s, i: F.struct(i.alias("i"), name(s).alias("name"))), lambda h: h["name"].isNotNull())
    x = x.withColumn("_heads", heads).select(session, "_heads", F.posexplode("_lines").alias("seq", "_line")).filter("seq > 0")
    under = F.filter("_heads", lambda h: h["i"] < F.col("seq"))
    x = x.withColumn("section", F.when(F.col("_line").startswith("@claim "), "claim").otherwise(F.get(under, F.size(under) - 1)["name"]))
    part = lambda i: F.trim(F.regexp_extract("_line", LINE, i))
    views = x.filter((F.col("section") != "claim") & F.col("_line").rlike(LINE)).select(session, "section", "seq", part(1).alias("_body"), part(2).alias("msg_id"), part(3).alias("snippet"))
    views = views.filter((F.col("_body") != "") & (F.char_length("snippet") <= SNIPPET_CHARS))
    body, noted = F.col("_body"), F.col("_body").rlike(NOTE)
    clean = F.when(noted, F.trim(F.regexp_extract(body, NOTE, 1))).otherwise(body)
    value = F.when(noted, F.trim(F.regexp_extract(body, NOTE, 3)))
    at = F.locate(": ", body)
    before = lambda s: F.trim(F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(body))
    behind = lambda s: F.trim(F.substring(s, at + 2, F.char_length(s)))
    kind = F.col("section")
    views = views.select(
        session, "section", F.col("seq").cast("long").alias("seq"),
        F.when(kind == "confirmed", clean).when(kind == "rejected", before(body)).otherwise(before(clean)).alias("head"),
        F.when(kind == "rejected", F.when(at > 0, behind(body)).otherwise("")).when(kind == "pitfalls", F.when(at > 0, behind(clean)).otherwise(clean)).alias("tail"),
        F.when(kind == "confirmed", F.when(value.isin(*ACTORS), value)).when(kind == "pitfalls", value).alias("note"),
        "msg_id", "snippet", F.lit(REBUILT_CONFIDENCE).alias("confidence"), F.lit(REBUILT_ROUND).cast("long").alias("round"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("n"),
    )
    raw = F.try_parse_json(F.substring("_line", 8, 1_000_000_000))
    c = x.filter("section = 'claim'").select(session, "section", F.col("seq").cast("long").alias("seq"), raw.alias("_v"))
    kinds = {f: F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant")) for f in "kercnsq"}
    string = lambda f: F.when(kinds[f] == "STRING", F.try_variant_get("_v", f"$.{f}", "string"))
    number = lambda f: F.when(kinds[f].rlike("BIGINT|DECIMAL|DOUBLE|FLOAT|INT"), F.try_variant_get("_v", f"$.{f}", "double"))
    c = c.select(session, "section", "seq", string("s").alias("head"), string("q").alias("tail"), F.lit(None).cast("string").alias("note"), string("e").alias("msg_id"), F.lit(None).cast("string").alias("snippet"), number("c").alias("confidence"), number("r").cast("long").alias("round"), string("k").alias("kind"), number("n").cast("long").alias("n"))
    full = [F.char_length(f) > 0 for f in ("head", "tail", "msg_id")]
    c = c.filter(F.col("kind").isin(*CLAIM_KINDS) & full[0] & full[1] & full[2] & (F.char_length("tail") <= SPAN_CHARS) & F.col("round").isNotNull())
    return views.unionByName(c)


def merge(old: DataFrame, new: DataFrame, session: str = "session_id") -> DataFrame:
    """Entries of the last rounds and of this one: of one key the newest, with the best confidence of the views, at the first one's place.

    The oldest claims beyond MOST_CLAIMS go.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    text = F.when(F.col("section") == "confirmed", F.col("head")).when(F.col("section") == "claim", F.col("head")).otherwise(F.concat("head", F.lit("|"), F.coalesce("tail", F.lit(""))))
    key = F.when(F.col("section") == "claim", F.concat("msg_id", F.lit("|"), norm(text))).otherwise(norm(text))
    both = old.select(session, *COLUMNS, F.lit(0).alias("_gen")).unionByName(new.select(session, *COLUMNS, F.lit(1).alias("_gen"))).withColumn("_key", key)
    when = F.struct("_gen", "seq")
    kept = [c for c in COLUMNS if c not in ("section", "seq", "confidence")]
    last = F.max_by(F.struct(*kept, "confidence"), when).alias("_last")
    g = both.groupBy(session, "section", "_key").agg(last, F.min(when).alias("_first"), F.max_by(F.when(F.col("_gen") == 0, F.col("confidence")), F.when(F.col("_gen") == 0, F.col("seq"))).alias("_old"), F.max(F.when(F.col("_gen") == 1, F.col("confidence"))).alias("_new"))
    confidence = F.when(F.col("section") == "claim", F.col("_last.confidence")).otherwise(F.greatest("_old", "_new"))
    order = Window.partitionBy(session, "section").orderBy("_first._gen", "_first.seq")
    out = g.withColumn("seq", F.row_number().over(order).cast("long")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(session, "section")))
    out = out.filter((F.col("section") != "claim") | (F.col("seq") > F.col("_n") - MOST_CLAIMS))
    return out.select(session, "section", "seq", *(F.col(f"_last.{c}").alias(c) for c in kept), confidence.alias("confidence")).select(session, *COLUMNS)


def _tokens(cjk: Column, other: Column) -> Column:
    return F.when(cjk + other == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((cjk * 1.5 + other * 0.25) * 1.1)))


def truncate(entries: DataFrame, most: int = MOST_TOKENS, session: str = "session_id") -> DataFrame:
    """The entries that are left when the least ones are cut until lines, and the whole text, cost ``most`` tokens or less."""
    tier = F.lit(2)
    for k, v in TIERS.items():
        tier = F.when(F.col("section") == k, v).otherwise(tier)
    for k, v in CLAIM_TIERS.items():
        tier = F.when((F.col("section") == "claim") & (F.col("kind") == k), v).otherwise(tier)
    ours = lambda s: F.char_length(s) - F.char_length(F.regexp_replace(s, CJK, ""))
    x = entries.withColumns({"_line": line(), "_is": (F.col("section") == "claim").cast("int"), "_tier": tier, "_at": F.when(F.col("section") == "confirmed", 0).when(F.col("section") == "rejected", 1).when(F.col("section") == "pitfalls", 2).otherwise(3)})
    x = x.withColumn("_cjk", ours(F.col("_line"))).withColumn("_other", F.char_length("_line") - F.col("_cjk"))
    best = Window.partitionBy(session).orderBy(F.desc("_tier"), F.desc("_is"), F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc("round"), F.desc("_at"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(best)
    n = total(F.col("_is"))
    head = F.when(n > 0, F.char_length(F.concat(F.lit("@claims "), n.cast("string"), F.lit(" "), F.col(session).cast("string"))))
    cost = total(_tokens(F.col("_cjk"), F.col("_other")) + 1) + F.coalesce(_tokens(F.lit(0), head) + 1, F.lit(0))
    cjk, other, lines = total(F.col("_cjk")), total(F.col("_other") + 1) + len(PREFIX_V1), F.coalesce(head + 1, F.lit(0))
    for name, title in SECTIONS.items():
        wide = sum("㐀" <= c <= "鿿" for c in title)
        seen = F.max((F.col("section") == name).cast("int")).over(best)
        cjk, other = cjk + seen * wide, other + seen * (len(title) - wide + 1)
    x = x.withColumns({"_cost": cost, "_whole": _tokens(cjk, other + lines)})
    return x.filter((F.col("_cost") <= most) & (F.col("_whole") <= most)).select(session, *COLUMNS)


def next_round(old: DataFrame, new: DataFrame, most: int = MOST_TOKENS, session: str = "session_id") -> DataFrame:
    """(session, digest) after a round: the old digests (session, digest) read back, merged with new entries, cut, and written again."""
    return render(truncate(merge(parse(old, session), new, session), most, session), session)
