"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, native.

A window is a run of ``window`` words of an item (an item of fewer words is one
window). It is taken as the set of its shingles of ``shingle`` words (of all its
words, if it has fewer). A document that contains the window contains all of them,
so one shingle of a window, its prefix, is enough to find every place: the rarest
one in the documents, counted over all of them. A window with a shingle that no
document has is out at once.

1. Every document's shingles are joined with the shingles of all windows, by 64-bit
   hash and then word for word (the shingles of windows are broadcast while they are
   few). What remains are ``places``, and for each document a row of its own with its
   number of words: the only scan of the texts.
2. Counts by shingle give each window's prefix.
3. Places of prefix shingles give candidate positions of windows; those that would
   begin before the text or end behind it go (length and positional bounds).
4. A candidate is a hit if the shingles that cover its window word by word (every
   fifth, and the last) are all among the places of the text where they have to be.

Documents of one text share their work: places are kept once for each text (its
SHA-256), so a group of copies costs no more than its own scan. All joins behind the
scan have (text, position) as key; no step gathers more than one text's own hits.

Odd input. Null and empty texts have no words, no hits and no items; an item without
words has no window. Items of one text share windows; each counts. Rows of a
repeated doc_id are judged each by its own text; repeated item_ids count once, null
ones not at all. Empty tables give no rows, or clean ones. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, stash

#: What stands between words: ASCII but letters and digits (texts are in lower case by then).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of at most this many bytes (by the estimate of ``_small``) are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 48_000_000


def words(text: str | Column) -> Column:
    """The words of a text; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    clean = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), rf"\A{GAP}|{GAP}\z", "")
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, GAP))


def _marks(size: int) -> Column:
    """A 64-bit hash for each word of ``_w``: of the shingle of ``size`` words that begins there (the last ones are cut short)."""
    hashes = F.transform(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.xxhash64(*(F.get(F.col("_w"), i + k) for k in range(size))))
    return F.when(F.size("_w") > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _shingles(rows: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """(keep, _w, _n, size, at, mark) of the shingles of ``_w`` of all sizes, and one row of size 0 and mark 0 behind them."""
    marks = F.concat(*(_marks(s) for s in sizes), F.array(F.lit(0).cast("long")))
    out = rows.select(*keep, "_w", F.size("_w").alias("_n"), F.posexplode(marks).alias("_p", "mark"))
    block = F.when(F.col("_n") == 0, len(sizes)).otherwise((F.col("_p") / F.greatest("_n", F.lit(1))).cast("int"))
    size = F.element_at(F.array(*map(F.lit, [*sizes, 0])), block + 1)
    return out.select(*keep, "_w", "_n", size.alias("size"), (F.col("_p") % F.greatest("_n", F.lit(1))).alias("at"), "mark")


def _small(df: DataFrame, *texts: str | Column) -> DataFrame:
    """A written table, to be broadcast if it is small: 80 bytes for a row and the JSON of its ``texts`` twice."""
    weight = F.lit(80)
    for t in texts:
        weight = weight + 2 * F.octet_length(F.to_json(F.array(t)))
    return F.broadcast(df) if (df.agg(F.sum(weight.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def windows(items: DataFrame, key: str, text: str, window: int, shingle: int) -> DataFrame:
    """(window, words, n_words, size, item): each window of each item; ``window`` is the SHA-256 of its words."""
    cut = items.select(F.col(key).cast("string").alias("item"), words(text).alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (window - 1), F.lit(1)))
    each = cut.select("item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, F.lit(window)))).alias("words"))
    each = each.select(F.unhex(F.sha2(F.concat_ws(" ", "words"), 256)).alias("window"), "words", F.size("words").alias("n_words"), "item").distinct()
    return each.withColumn("size", F.least("n_words", F.lit(shingle)))


def find(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5
) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    items = stash(windows(items, item_key, item_text, window, shingle), "item-windows")
    wins = items.select("window", "words", "n_words", "size").dropDuplicates(["window"])
    sizes = sorted(r[0] for r in wins.select("size").distinct().collect())  # as many as a shingle has words at most
    rows = docs.select(F.col(key).alias("_id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("_text"), words(text).alias("_w"))
    if not sizes:
        return _report(rows.select("_id", "_text", F.size("_w").cast("long").alias("n_words")), None, key)

    here = F.slice("_w", F.col("at") + 1, F.col("size"))
    marks = _shingles(wins.select("window", "n_words", F.col("size").alias("_s"), F.col("words").alias("_w")), sizes, "window", "n_words", "_s")
    marks = marks.filter((F.col("size") == F.col("_s")) & (F.col("at") + F.col("size") <= F.col("n_words")))
    marks = marks.select("window", "n_words", "size", F.col("at").alias("offset"), "mark", here.alias("said"))
    marks = stash(marks.withColumn("shingle", F.unhex(F.sha2(F.concat_ws(" ", "said"), 256))), "window-shingles")
    own = marks.limit(1).select(F.lit(0).alias("size"), F.lit(0).cast("long").alias("mark"), F.array().cast("array<string>").alias("said"), F.lit(None).cast("binary").alias("shingle"))
    known = stash(marks.select("size", "mark", "said", "shingle").distinct().unionByName(own), "known-shingles")
    met = _shingles(rows, sizes, "_id", "_text").join(_small(known, "said"), ["size", "mark"]).filter((F.col("size") == 0) | (here == F.col("said")))
    met = stash(met.select("_id", "_text", "_n", "size", "at", "shingle"), "places")
    places = stash(met.filter("size > 0").select("_text", "_n", "at", "shingle").distinct(), "text-places")

    often = stash(places.groupBy("shingle").agg(F.count("*").alias("often")), "shingle-counts")
    rarest = F.min(F.struct("often", "offset", "shingle")).alias("least")
    ranked = marks.join(_small(often), "shingle", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    prefix = ranked.groupBy("window", "n_words", "size").agg(rarest).filter("least.often > 0")
    prefix = _small(stash(prefix.select("window", "n_words", "least.offset", "least.shingle"), "prefixes"))
    near = places.join(prefix, "shingle").select("_text", "_n", (F.col("at") - F.col("offset")).alias("start"), "window", "n_words")
    near = near.filter((F.col("start") >= 0) & (F.col("start") + F.col("n_words") <= F.col("_n"))).drop("_n")
    cover = marks.filter((F.col("offset") % F.col("size") == 0) | (F.col("offset") + F.col("size") == F.col("n_words")))
    cover = _small(stash(cover.select("window", "offset", "shingle", F.count("*").over(Window.partitionBy("window")).alias("_all")), "covers"))
    asked = near.join(cover, "window").select("_text", "start", "window", "n_words", "_all", (F.col("start") + F.col("offset")).alias("at"), "shingle")
    there = asked.join(places.select("_text", "at", "shingle"), ["_text", "at", "shingle"]).groupBy("_text", "start", "window", "n_words", "_all").agg(F.count("*").alias("_found"))
    hits = stash(there.filter("_found = _all").select("_text", "start", "window", "n_words"), "hits")

    spots = hits.select("_text", "start", "n_words").distinct().select("_text", F.explode(F.sequence("start", F.col("start") + F.col("n_words") - 1)).alias("at"))
    n_hit = spots.distinct().groupBy("_text").agg(F.count("*").alias("n_hit"))
    owners = _small(stash(items.filter(F.col("item").isNotNull()).select("window", "item").distinct(), "window-items"), "item")
    named = hits.select("_text", "window").distinct().join(owners, "window").select("_text", "item").distinct()
    named = named.groupBy("_text").agg(F.array_sort(F.collect_list("item")).alias("items"))
    every = met.filter("size = 0").select("_id", "_text", F.col("_n").cast("long").alias("n_words"))
    return _report(every, stash(n_hit.join(named, "_text", "left"), "hit-texts"), key)


def _report(rows: DataFrame, hits: DataFrame | None, key: str) -> DataFrame:
    """One row for each document, with what its text was found to hold."""
    if hits is None:
        rows = rows.withColumns({"n_hit": F.lit(None).cast("long"), "items": F.lit(None).cast("array<string>")})
    else:
        rows = rows.join(_small(hits.withColumnRenamed("_text", "_of"), "items"), F.col("_text") == F.col("_of"), "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        F.col("_id").alias(key), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
