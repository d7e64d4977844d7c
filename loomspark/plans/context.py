"""K1 in full (with K16, K17): the context of every turn of every session, as blocks, a stable prefix and a changing suffix.

A turn's context is a list of blocks. Stable ones (history, error cards, memories)
come first and in fixed order, so that a model's prompt cache can keep them; the
others (outside signals, drift, strategy, media) follow by the priority of their role.
A turn without any memory hit has no stable part: its cards, signals and history are
all suffix. Every step is a plan over all sessions: each source is brought to one row
of a turn or session, joined to the turns, and laid out there as two arrays of blocks.
What is shared with the turn before is found block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import signals

# --- fixed values -------------------------------------------------------------
STRATEGY_TEXTS = {
    "chain-of-thought": "Let's think step by step. Break down the problem and reason through each step carefully before arriving at a conclusion.",
    "tree-of-thoughts": "Explore multiple solution paths. Consider at least 2-3 alternative approaches, evaluate their trade-offs, then select and execute the best one.",
    "graph-of-thoughts": "Build a network of ideas. Map relationships between concepts, identify dependencies, trace logical connections, and synthesize the most coherent solution.",
}
DRIFT_ACTIONS = {
    "high": "Topic has drifted significantly — consider starting a new session; Compact context to reduce noise from old topics",
    "medium": "Moderate topic drift detected — compact context to refocus; Summarize key points before continuing",
    "low": "Mild topic shift — refresh relevant memories",
}
AUTO_SESSION = "Topic drift detected. Consider starting a new session for better focus and context relevance."
HISTORY_INTRO, HISTORY_END = "[Session History]\nThe following summarizes recent sessions for continuity:\n\n", "\n\nUse this context to maintain continuity across sessions."
LEAST_SCORE, WARN_SHARE, COMPACT_DRIFT, SESSION_DRIFT, CARD_TOKENS = 0.3, 0.75, 0.7, 0.9, 256
# ------------------------------------------------------------------------------
TURN = ["session_id", "turn"]
def allocate(lists: DataFrame, by: list[str], tokens: str, rank: list[str | Column], caps: dict[str, int], total: int, name: str = "list") -> DataFrame:
    """Rows of several ranked lists that fit: each list's longest prefix within its cap, and over the lists in the order of ``caps`` the longest prefix within ``total``.

    Adds ``running`` (tokens up to the row in its list). Lists without a cap don't pass.
    """
    cap, order = F.lit(None).cast("long"), F.lit(None).cast("int")
    for k, (n, most) in enumerate(caps.items()):
        cap, order = F.when(F.col(name) == n, most).otherwise(cap), F.when(F.col(name) == n, k).otherwise(order)
    own = Window.partitionBy(*by, name).orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by).orderBy("_order", *rank).rowsBetween(Window.unboundedPreceding, 0)
    fit = lists.withColumns({"_cap": cap, "_order": order}).withColumn("running", F.sum(tokens).over(own)).filter(F.col("running") <= F.col("_cap"))
    return fit.withColumn("_all", F.sum(tokens).over(every)).filter(F.col("_all") <= total).drop("_cap", "_order", "_all")


def shown_alerts(scores: DataFrame, alerts: DataFrame, most: int = 2) -> DataFrame:
    """(session, turn, rank, level, score): the last alerts of the newest sudden change at or before each scored turn.

    Alerts wait until the score jumps; then those that waited are shown, and stay until it jumps again.
    """
    order = Window.partitionBy("session_id").orderBy("turn")
    jump = F.when(F.col("sudden"), F.col("turn"))
    seen = scores.select("session_id", "turn", F.last(jump, True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_epoch"), F.first(jump, True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_next"))
    waiting = alerts.join(seen.select("session_id", "turn", "_next"), TURN).filter(F.col("_next").isNotNull())
    newest = F.row_number().over(Window.partitionBy("session_id", "_next").orderBy(F.desc("turn")))
    waiting = waiting.withColumn("_back", newest).filter(F.col("_back") <= most).select("session_id", F.col("_next").alias("_epoch"), (-F.col("_back")).alias("rank"), "level", F.col("peak").alias("score"))
    return seen.filter(F.col("_epoch").isNotNull()).select("session_id", "turn", "_epoch").join(waiting, ["session_id", "_epoch"]).drop("_epoch")


def _block(source: str | Column, text: Column, place: int, rank: Column | int = 0, priority: Column | None = None) -> Column:
    """A block of the suffix; ``array_sort`` brings the first priority first, then injection order."""
    name = F.lit(source) if isinstance(source, str) else source
    order = priority if priority is not None else signals.priority(signals.role(name))
    return F.struct(order.cast("int").alias("priority"), F.lit(place).alias("place"), (F.lit(rank) if isinstance(rank, int) else rank).cast("long").alias("rank"), name.alias("source"), text.alias("block"))


def gather(turns: DataFrame, hits: DataFrame, history: DataFrame, cards: DataFrame, outside: DataFrame, scores: DataFrame, alerts: DataFrame, budget: int = 400, style: str = "descriptive") -> DataFrame:
    """(session_id, turn, head, tail, tokens, drift): the blocks of every turn, stable ones in ``head``.

    turns: (session_id, turn, query), one row each. hits: (session_id, turn, id,
    content, score). history: (session_id, text). cards: (session_id, turn, seq, card).
    outside: (session_id, seq, source, block). scores and alerts: as of ``drift``.
    """
    items = hits.select(*TURN, F.lit("memory").alias("list"), F.col("id").alias("tie"), (-F.col("score")).alias("worst"), F.col("content").alias("item"), F.when(F.col("score") >= LEAST_SCORE, tx.heuristic_tokens(F.col("content"))).alias("tokens"))
    shown = cards.select(*TURN, F.lit("card").alias("list"), F.col("seq").alias("tie"), F.lit(0.0).alias("worst"), F.col("card").alias("item"), tx.rough_tokens(F.col("card")).alias("tokens"))
    # Items below the least score cost nothing and are left out below: that a turn had hits at all is what they tell.
    chosen = allocate(items.unionByName(shown).withColumn("_cost", F.coalesce("tokens", F.lit(0))), TURN, "_cost", ["worst", "tie"], {"card": CARD_TOKENS, "memory": budget}, CARD_TOKENS + budget)
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.when((F.col("list") == name) & F.col("tokens").isNotNull(), F.struct("worst", "tie", "item")))), lambda r: r["item"]).alias(f"{name}s")
    spent = F.sum(F.when(F.col("list") == "memory", F.col("tokens"))).alias("tokens")
    lists = chosen.groupBy(*TURN).agg(listed("memory"), listed("card"), spent)
    met = hits.select(*TURN).distinct().withColumn("warm", F.lit(True))

    name = F.col("source")
    signalled = outside.groupBy("session_id").agg(F.collect_list(_block(name, F.col("block"), 0, F.col("seq"))).alias("_outside"))
    actions = F.element_at(F.create_map(*[F.lit(v) for kv in DRIFT_ACTIONS.items() for v in kv]), F.col("level"))
    line = F.concat(F.lit("[Drift "), F.upper("level"), F.lit("] Score: "), F.format_number("score", 2), F.lit(" — "), actions)
    drifted = shown_alerts(scores, alerts).groupBy(*TURN).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"]), "\n").alias("_drift"))
    x = turns.join(met, TURN, "left").join(lists, TURN, "left").join(drifted, TURN, "left").join(scores.select(*TURN, F.col("rolling").alias("drift")), TURN, "left")
    x = x.join(history.select("session_id", F.col("text").alias("_history")), "session_id", "left").join(signalled, "session_id", "left").withColumn("warm", F.coalesce("warm", F.lit(False)))

    how = tx.reasoning(tx.prompt_task(F.col("query")), tx.complexity(F.col("query")))
    said = F.lit(None).cast("string")
    for n, text in STRATEGY_TEXTS.items():
        said = F.when(how == n, f"[Strategy: {n}] {text}").otherwise(said)
    media = F.slice(F.array_sort(F.transform(tx.media_references(F.col("query")), lambda m, i: F.struct(tx.modality_rank(m["kind"]).alias("k"), i.alias("i"), m["description"].alias("text")))), 1, 5)
    cards_text = F.when(F.size("cards") > 0, F.array_join("cards", "\n"))
    memory = F.when(F.size("memorys") > 0, tx.styled(F.col("memorys"), style))
    hashed = F.concat(F.lit("[Session History — hash:"), tx.session_hash(F.col("session_id")), F.lit("]\n"), tx.sanitize(F.col("_history")))
    told = F.concat(F.lit(HISTORY_INTRO), F.col("_history"), F.lit(HISTORY_END))
    filled = lambda blocks: F.filter(blocks, lambda b: F.length(b["block"]) > 0)
    head = [_block("resume", hashed, 0), _block("error-card", cards_text, 1), _block("memory", memory, 2)]
    drift_block = F.concat(F.lit("[Drift Monitor]\n"), F.col("_drift"))
    none = F.array().cast(BLOCKS)
    changing = F.concat(
        F.coalesce("_outside", none), F.array(_block("drift", drift_block, 1), _block("prompt-strategy", said, 2)).cast(BLOCKS),
        F.transform(media, lambda m, i: _block("multimodal", m["text"], 3, i)).cast(BLOCKS),
    )
    cold = F.concat(F.array(_block("error-card", cards_text, -1)).cast(BLOCKS), F.coalesce("_outside", none), F.array(_block("resume", told, 0, priority=F.lit(9))).cast(BLOCKS))
    x = x.withColumn("head", F.when(F.col("warm"), filled(F.array(*head).cast(BLOCKS))).otherwise(none)).withColumn("tail", F.array_sort(filled(F.when(F.col("warm"), changing).otherwise(cold))))
    return x.select(*TURN, "head", "tail", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("drift", F.lit(0.0)).alias("drift"))


BLOCKS = "array<struct<priority:int,place:int,rank:bigint,source:string,block:string>>"


def blocks(gathered: DataFrame) -> DataFrame:
    """(session_id, turn, source, stable, block) of every turn."""
    marked = lambda c, stable: F.transform(c, lambda b: F.struct(b["source"].alias("source"), F.lit(stable).alias("stable"), b["block"].alias("block")))
    both = F.concat(marked("head", True), marked("tail", False))
    return gathered.select(*TURN, F.explode(both).alias("b")).select(*TURN, "b.source", "b.stable", "b.block")


def assemble(gathered: DataFrame, budget: int = 400) -> DataFrame:
    """One row for each turn: text, prefix, suffix, tokens, kept prefix, warnings.

    ``kept_blocks`` and ``kept_chars`` are the blocks and characters at the head of
    the prefix that the turn before had as well. ``warning`` comes once in a session,
    at the first turn whose memories take over three quarters of the budget; so does
    ``suggestion``, at the first turn of strong drift.
    """
    texts = lambda c: F.transform(c, lambda b: b["block"])
    sources = F.array_join(F.transform(F.concat("head", "tail"), lambda b: b["source"]), ",")
    x = gathered.select(*TURN, texts("head").alias("head"), texts("tail").alias("tail"), sources.alias("sources"), "tokens", "drift")
    order = Window.partitionBy("session_id").orderBy("turn")
    x = x.withColumn("_before", F.coalesce(F.lag("head").over(order), F.array().cast("array<string>")))
    differs = F.transform("head", lambda h, i: ~h.eqNullSafe(F.get("_before", i)))
    x = x.withColumn("kept_blocks", F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)) - 1, F.size("head")).cast("long"))
    over, strong = F.col("tokens") > WARN_SHARE * budget, F.col("drift") >= SESSION_DRIFT
    first = lambda c: c & (F.sum(c.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    percent = F.floor(F.col("tokens") * 100 / budget + 0.5).cast("string")
    warning = F.concat(F.lit("[Token Budget Warning: "), F.col("tokens").cast("string"), F.lit(f"/{budget} tokens used ("), percent, F.lit("%) — consider compaction]"))
    x = x.withColumns({"warning": F.when(first(over), warning), "suggestion": F.when(first(strong), AUTO_SESSION)})
    joined = lambda c: F.array_join(c, "\n\n")
    kept = joined(F.slice("head", F.lit(1), F.col("kept_blocks").cast("int")))
    return x.select(
        *TURN, F.size("head").cast("long").alias("n_stable"), F.size("tail").cast("long").alias("n_dynamic"), "sources", "tokens", "kept_blocks", F.char_length(kept).cast("long").alias("kept_chars"),
        joined("head").alias("prefix"), joined("tail").alias("suffix"), joined(F.concat("head", "tail")).alias("text"), "drift", (F.col("drift") >= COMPACT_DRIFT).alias("auto_compact"), "warning", "suggestion",
    )
