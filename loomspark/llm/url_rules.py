"""URL filters: host rules, and pattern rules found by their rarest literal token.

A pattern rule is a regular expression with the literal tokens that every url it
matches must hold. The index keeps each rule under the one of its tokens that is
rarest among the urls at hand; the tokens of a url fetch candidate rules, and
only those run their expression. Lists of up to ``IN_ROW`` rules are a literal
map inside the projection (no shuffle, no join); longer ones are joined on the
token. Everything is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Most rules that stand in the plan as a literal map; more go through a join.
IN_ROW = 2000
TOKEN_SPLIT = "[^a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    """Fits a host and all its subdomains if the path starts with ``path``; the longest fitting rule wins."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` runs on the lower-cased url; ``tokens`` are whole [a-z0-9]+ tokens that every match implies.

    A token is implied only if the pattern says what stands at both its ends: in
    ``\\.php`` the token may go on (``php5``), so it is none.
    """

    action: str
    pattern: str
    tokens: tuple[str, ...]


HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

#: The default pattern rules, block before allow where both match. Own choices: link farms, pill shops and other unwanted sites.
PATTERN_RULES = (
    PatternRule("block", r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule("block", r"://([^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    PatternRule("block", r"://([^/?#]*[.-])?casino[.-]", ("casino",)),
    PatternRule("block", r"://([^/?#]*[.-])?poker[.-]", ("poker",)),
    PatternRule("block", r"://([^/?#]*[.-])?porn[.-]", ("porn",)),
    PatternRule("block", r"://([^/?#]*[.-])?xxx[.-]", ("xxx",)),
    PatternRule("block", r"[?&]replica=watch(&|$)", ("replica", "watch")),
    PatternRule("block", r"/wp-login\.php", ("wp", "login")),
    PatternRule("block", r"/payday-loans?/", ("payday",)),
    PatternRule("block", r"/torrents?/.*\.torrent$", ("torrent",)),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where it is null or has no ``://``."""
    pattern = "://([^/?#]*)([^?#]*)"
    return lower_ascii(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def longest_host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, else nulls."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, action = F.when(fits, r.name).otherwise(name), F.when(fits, r.action).otherwise(action)
    return name, action


def tokens_of(url: Column) -> Column:
    return F.filter(F.array_distinct(F.split(lower_ascii(F.coalesce(url, F.lit(""))), TOKEN_SPLIT)), lambda t: t != "")


def rarest_tokens(urls: DataFrame, rules, url: str = "url") -> list[str]:
    """The token of each rule that the fewest urls hold; ties go by the token. Reads every url; one row for each token of the rules comes back."""
    own = sorted({t for r in rules for t in r.tokens})
    lit = F.array(*[F.lit(t) for t in own])
    hits = urls.select(F.explode(F.array_intersect(tokens_of(F.col(url)), lit)).alias("t")).groupBy("t").count()
    seen = {r["t"]: r["count"] for r in hits.collect()}  # as many rows as the rules have tokens, at most
    return [min(r.tokens, key=lambda t: (seen.get(t, 0), t)) for r in rules]


def pattern_verdict(urls: DataFrame, rules=PATTERN_RULES, url: str = "url", out: str = "pattern_rule", index: list[str] | None = None) -> DataFrame:
    """Add ``out``: the number of the first rule in the list whose pattern matches, else null."""
    rules = list(rules)
    if not rules:
        return urls.withColumn(out, F.lit(None).cast("int"))
    index = index or rarest_tokens(urls, rules, url)
    if len(rules) > IN_ROW:
        return _joined(urls, rules, url, out, index)
    under: dict[str, list[int]] = {}
    for i, t in enumerate(index):
        under.setdefault(t, []).append(i)
    lookup = F.create_map(*[x for t, ids in under.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in ids]))])
    candidates = F.flatten(F.transform(F.array_intersect(tokens_of(F.col(url)), F.array(*[F.lit(t) for t in under])), lambda t: F.element_at(lookup, t)))
    low = lower_ascii(F.col(url))
    # A branch for each rule, so that its expression is compiled once; only candidates reach theirs.
    def run(i: Column) -> Column:
        met = F.lit(False)
        for k, r in enumerate(rules):
            met = F.when(i == k, low.rlike(r.pattern)).otherwise(met)
        return met

    return urls.withColumn(out, F.array_min(F.filter(candidates, run)))


def _joined(urls: DataFrame, rules, url: str, out: str, index: list[str]) -> DataFrame:
    spark = urls.sparkSession
    table = spark.createDataFrame([(t, i, r.pattern) for i, (t, r) in enumerate(zip(index, rules))], "_t string, _rule int, _pattern string")
    distinct = urls.select(F.col(url).alias("_url")).filter("_url is not null").distinct()
    # The rules come from a list on the driver; their tokens are sent to all up to a size that any executor holds.
    table = F.broadcast(table) if len(rules) <= 100_000 else table
    pairs = distinct.withColumn("_t", F.explode(tokens_of(F.col("_url")))).join(table, "_t")
    hits = pairs.filter(F.expr("translate(_url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') rlike _pattern"))
    best = hits.groupBy("_url").agg(F.min("_rule").alias(out))
    return urls.join(best, urls[url] == best["_url"], "left").drop("_url")


def judge(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to the rows of ``pages``.

    The longest host rule decides (``rule`` is its name); without one, the first
    pattern rule that matches; else ``default``. A null url or one without ``://``
    has an empty host and path, no rule, and the pattern rules' verdict. Every row
    is kept, repeated ones too; columns named like the new ones are replaced.
    """
    pattern_rules = list(pattern_rules)
    host, path = host_and_path(F.col(url))
    x = pages.drop("host", "path", "rule", "verdict", "_pattern_rule")
    x = pattern_verdict(x, pattern_rules, url, "_pattern_rule").withColumns({"host": host, "path": path})
    name, action = longest_host_rule(F.col("host"), F.col("path"), host_rules)
    said = F.lit(default)
    for k, r in enumerate(pattern_rules):
        said = F.when(F.col("_pattern_rule") == k, r.action).otherwise(said)
    return x.withColumns({"rule": name, "verdict": F.coalesce(action, said)}).drop("_pattern_rule")
