"""Text blocks and summaries: three sections, recaps, levels of history, signal blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ACTION_WORDS, STATE_WORDS, decision_sentences, entities, sanitize, session_hash, topics
from .resume import DAY, daily_merge, time_buckets, top_words

# --- fixed values -------------------------------------------------------------
TASK_STARTS = (r"\b(todo|to.?do)\b", r"\b(next|next.?step|next.?action)\b", r"\b(bug|bugs|fix|fixes|fixed)\b", r"\b(need to|needs? to|must|should|have to)\b", r"\b(remaining|left to do|outstanding|pending)\b", r"\b(issue|issues|problem|problems|blocker|blockers)\b")
POINT_STARTS = (r"\b(decided|decision|concluded|agreed|confirmed|finalized|chosen|settled)\b", r"\b(important|critical|key|crucial|significant|notable)\b", r"\b(note|notes|noted|noteworthy)\b", r"\b(learned|learnt|lesson|takeaway|insight)\b", r"\b(summary|overview|recap|key.?point|highlight)\b")
COMPLETED = r"\b(done|completed|complete|resolved|fixed|finished|shipped|closed|merged)\b"
UNRESOLVED = ("open", "unresolved", "pending", "blocked", "failing", "todo")
NONE = "(none recorded)"
FALLBACK = "Next step: resolve unresolved items"
# ------------------------------------------------------------------------------


def pattern_sentences(text: str | None, patterns: tuple[str, ...], most: int = 5, least: int = 15) -> list[str]:
    """The sentences around the patterns' matches, in the patterns' order; distinct, long enough, cut at 120 characters."""
    if not text:
        return []
    ends = [0] + [m.end() for m in re.finditer(r"[.!?\n]", text)] + [len(text)]
    out: dict[str, str] = {}
    for p in patterns:
        for m in re.finditer(p, text, re.IGNORECASE | re.ASCII):
            start = max(e for e in ends if e <= m.start())
            stop = min(e for e in ends if e > m.start())
            s = text[start:stop].strip()
            if len(s) >= least:
                out.setdefault(s.lower(), s if len(s) <= 120 else s[:117] + "...")
    return list(out.values())[:most]


def task_sentences(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pattern_sentences(t, TASK_STARTS))

    return F.pandas_udf(run, "array<string>")(text)


def point_sentences(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pattern_sentences(t, POINT_STARTS))

    return F.pandas_udf(run, "array<string>")(text)


def keyword_sentences(text: str, words: tuple[str, ...], most: int = 2, longest: int = 160) -> list[str]:
    """The first sentences that hold one of the words; long ones are passed over."""
    out = []
    for s in re.split(r"[.!?\n]", text):
        s = s.strip().lstrip("-• ").strip()
        if s and len(s) <= longest and any(w in s.lower() + " " for w in words):
            out.append(s)
            if len(out) == most:
                break
    return out


def sections(text: str | None) -> dict:
    """Workspace state and next action of a text, and whether they agree.

    An action that says it is done while the state is unresolved is rejected once
    and made anew from the state; if it still does, a fixed action stands in.
    """
    state = "; ".join(keyword_sentences(text or "", STATE_WORDS)) or NONE
    action = "; ".join(keyword_sentences(text or "", ACTION_WORDS)) or NONE
    clash = lambda a: bool(re.search(COMPLETED, a.lower())) and any(w in state.lower() for w in UNRESOLVED)
    verdict = "pass"
    if clash(action):
        action, verdict = f"Revisit: {state}", "rejected"
        if clash(action):
            action, verdict = FALLBACK, "degraded"
    return {"state": state, "action": action, "consistency": verdict}


def three_sections(messages: DataFrame, by: list[str], idx: str = "idx") -> DataFrame:
    """(by..., removed, summary, consistency): findings, state and next action of each session's messages."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sections(t) for t in texts], columns=["state", "action", "consistency"])

    text = F.col("content")
    g = messages.groupBy(*by).agg(F.count(F.lit(1)).alias("removed"), F.array_sort(F.collect_list(F.struct(idx, "content", decision_sentences(text).alias("d"), entities(text).alias("e"), topics(text).alias("t")))).alias("l"))
    flat = lambda c, n: F.slice(F.array_distinct(F.flatten(F.transform("l", lambda r: r[c]))), 1, n)
    joined = F.array_join(F.transform("l", lambda r: r["content"]), "\n")
    g = g.withColumn("s", F.pandas_udf(run, "state string, action string, consistency string")(joined))
    t, d, e = flat("t", 5), flat("d", 5), flat("e", 8)
    findings = F.concat_ws("; ", F.when(F.size(t) > 0, F.concat(F.lit("topics: "), F.array_join(t, ","))).otherwise("general discussion"), F.when(F.size(d) > 0, F.concat(F.lit("decisions: "), F.array_join(F.transform(d, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ";"))), F.when(F.size(e) > 0, F.concat(F.lit("entities: "), F.array_join(e, ","))))
    summary = F.concat(F.lit("[Compacted History - "), F.col("removed").cast("string"), F.lit(" msgs] Recorded Findings: "), findings, F.lit(" | Workspace State: "), F.col("s.state"), F.lit(" | Next Action: "), F.col("s.action"))
    return g.select(*by, "removed", summary.alias("summary"), F.col("s.consistency").alias("consistency"))


def monthly_merge(df: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """by month (UTC): the three most frequent theme words, the fifteen most frequent entities, first time, messages summed."""
    x = df.withColumn("month", F.date_format(F.timestamp_millis(ts), "yyyy-MM"))
    words = top_words(x, [*by, "month"], "theme", 3).groupBy(*by, "month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda r: r["word"]), ", ").alias("theme"))
    e = x.select(*by, "month", F.explode("entities").alias("entity")).groupBy(*by, "month", "entity").agg(F.count(F.lit(1)).alias("n"))
    e = e.withColumn("r", F.row_number().over(Window.partitionBy(*by, "month").orderBy(F.desc("n"), "entity"))).filter("r <= 15")
    e = e.groupBy(*by, "month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "entity"))), lambda r: r["entity"]), ", ").alias("entities"))
    g = x.groupBy(*by, "month").agg(F.min(ts).alias("ts"), F.sum("n_messages").alias("n_messages"))
    return g.join(words, [*by, "month"], "left").join(e, [*by, "month"], "left")


def graph_nodes(mentions: DataFrame, entity: str = "entity") -> DataFrame:
    """sessions, mentions and last place of each entity."""
    return mentions.groupBy(entity).agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("mentions"), F.max("idx").alias("last_idx"))


def tracker_stats(mentions: DataFrame, edges: DataFrame, entity: str = "entity") -> DataFrame:
    """one row of entities, sessions, mentions and pairs."""
    return mentions.agg(F.count_distinct(entity).alias("entities"), F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("mentions")).join(edges.agg(F.count(F.lit(1)).alias("pairs")), F.lit(True))


def causality(links: DataFrame, event: str) -> DataFrame:
    """Links whose cause or effect is the event."""
    return links.filter((F.col("cause") == event) | (F.col("effect") == event))


def hierarchy(df: DataFrame, by: list[str], now: int) -> DataFrame:
    """K5: one text for each group: recent summaries, this week's days, and how many older ones."""
    x = time_buckets(df, now, by)
    recent = x.filter("bucket = 'recent'").groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("ts")).alias("k"), "event_id", "theme"))), lambda r: F.concat(F.lit("- "), r["theme"])), "\n").alias("recent"))
    days = daily_merge(x.filter("bucket = 'this_week'"), by).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("day")).alias("k"), "theme"))), lambda r: F.concat(F.lit("- "), r["theme"])), "\n").alias("week"))
    older = x.groupBy(*by).agg(F.count_if(F.col("bucket") == "older").alias("older"))
    g = older.join(recent, by, "left").join(days, by, "left")
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {title}\n"), F.col(c)))
    return g.select(*by, F.concat_ws("\n\n", part("Recent", "recent"), part("This week", "week"), F.when(F.col("older") > 0, F.concat(F.lit("## Older\n"), F.col("older").cast("string"), F.lit(" sessions")))).alias("history"))


def templated(df: DataFrame, by: list[str], order: str, template: str, most: int = 5) -> DataFrame:
    """K6: a session block with its entries by recency, relevance or time, in one of five forms."""
    key = {"recency": [F.desc("ts"), F.col("event_id")], "relevance": [F.desc("n_messages"), F.desc("ts"), F.col("event_id")], "chronological": [F.col("ts"), F.col("event_id")]}[order]
    line = {
        "facts": F.concat(F.lit("* "), F.array_join("entities", ", "), F.lit(": "), F.col("theme")), "timeline": F.concat(F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd"), F.lit(" "), F.col("theme")),
        "procedural": F.concat(F.lit("-> "), F.array_join("tasks", "; ")), "evidence": F.concat(F.lit("> "), F.array_join("key_points", " / ")), "default": F.concat(F.lit("- "), F.col("theme")),
    }[template]
    x = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*key))).filter(F.col("_r") <= most)
    g = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("line")))).alias("l"))
    return g.select(*by, F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("block"))


def recap(doing: Column, following: Column, style: str = "compact", most: int = 200) -> Column:
    """K7: what was done and what is next, in one of three styles."""
    d = F.when(F.char_length(doing) <= most, doing).otherwise(F.concat(F.substring(doing, 1, most - 3), F.lit("...")))
    if style == "compact":
        return F.concat(F.lit("Last: "), d, F.lit(" | Next: "), following)
    if style == "detailed":
        return F.concat(F.lit("## Session Recap\n\n### What We Were Doing\n"), d, F.lit("\n\n### Next Step\n"), following)
    return F.concat(F.lit("**Last Session**\n\n**What we were doing:** "), d, F.lit("\n\n**Next step:** "), following)


def signal_block(signals: DataFrame, by: list[str], title: str, line: Column, order: list[str]) -> DataFrame:
    """A titled block of lines for each group."""
    g = signals.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))
    return g.select(*by, F.concat(F.lit(f"[{title}]\n"), F.array_join(F.transform("l", lambda r: r["line"]), "\n")).alias("block"))


def resume_block(session: Column, block: Column) -> Column:
    """A block under its session's hash, with what changes from turn to turn taken out."""
    return F.concat(F.lit("[Session "), session_hash(session), F.lit("]\n"), sanitize(block))


def error_cards(cards: DataFrame, keys: DataFrame, by: list[str], most_chars: int = 1024) -> DataFrame:
    """The cards (key, card, seq) of each session's status key (by..., key), as one block cut at 256 tokens of four characters."""
    g = keys.join(cards, "key").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "card"))).alias("l"))
    return g.select(*by, F.substring(F.array_join(F.transform("l", lambda r: r["card"]), "\n"), 1, most_chars).alias("block"))


def bootstrap(sessions: DataFrame, checkpoints: DataFrame, history: DataFrame, by: list[str]) -> DataFrame:
    """For each session whether a checkpoint and a history were found, and their texts."""
    c = checkpoints.select(*by, F.to_json(F.struct(*[x for x in checkpoints.columns if x not in by])).alias("checkpoint"))
    h = history.select(*by, F.col("block").alias("history"))
    x = sessions.select(*by).distinct().join(c, by, "left").join(h, by, "left")
    return x.select(*by, F.col("checkpoint").isNotNull().alias("checkpoint_ok"), F.col("history").isNotNull().alias("history_ok"), "checkpoint", "history")
