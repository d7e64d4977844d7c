"""Streams: ingest, running session state, windows with late data, cooldown gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import heuristic_tokens, rough_tokens

#: A session without messages for so long is over: 30 days. For ``idle_ms`` of streams that run on; one that ends when its input is used up must not wait for timeouts.
IDLE_MS = 30 * 86_400_000


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events and their value by tumbling window; rows later than the watermark are left out."""
    x = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return x.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def session_windows(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", by: tuple[str, ...] = ("user_id",), late: str = "10 minutes") -> DataFrame:
    """Events by session window; on a stream, windows are emitted and forgotten once the watermark has passed them."""
    x = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return x.groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def ingest(messages: DataFrame, path: str, checkpoint: str, least: int = 20):
    """A5, K3: a stream of messages appended to a store; short ones and heartbeats are left out."""
    x = messages.filter((F.char_length("content") >= least) & ~F.col("content").startswith("HEARTBEAT")).withColumn("tokens", heuristic_tokens(F.col("content")))
    return x.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_state(messages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """L2: (session_id, messages, tokens, last_idx) after each batch in which a session has messages; one that is silent for ``idle_ms``, if given, is forgotten."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        n, tokens, last = state.get if state.exists else (0, 0, -1)
        for f in frames:
            n, tokens, last = n + len(f), tokens + int(f["tokens"].sum()), max(last, int(f["idx"].max()))
        state.update((n, tokens, last))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": [key[0]], "messages": [n], "tokens": [tokens], "last_idx": [last]})

    x = messages.withColumn("tokens", heuristic_tokens(F.col("content")))
    return x.groupBy("session_id").applyInPandasWithState(step, "session_id long, messages long, tokens long, last_idx long", "messages long, tokens long, last long", "update", _timeout(idle_ms))


def budget_stream(messages: DataFrame, budget: int, share: float = 0.9, chunk: int = 100, idle_ms: int | None = None) -> DataFrame:
    """Messages kept, ``chunk`` at a time, while their chunk uses no more than ``share`` of what is left of the budget.

    Chunks and the budget are carried from batch to batch; a session that is silent for ``idle_ms``, if given, is forgotten.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        n, left, used = state.get if state.exists else (0, budget, 0)
        rows = sorted((int(i), int(t)) for f in frames for i, t in zip(f["idx"], f["tokens"]))
        kept = []
        for i, t in rows:
            if n % chunk == 0:
                left, used = left - used, 0
            if used + t <= share * left:
                used += t
                kept.append(i)
            n += 1
        state.update((n, left, used))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": [key[0]] * len(kept), "idx": kept})

    x = messages.select("session_id", "idx", rough_tokens(F.col("content")).alias("tokens"))
    return x.groupBy("session_id").applyInPandasWithState(step, "session_id long, idx long", "n long, left long, used long", "append", _timeout(idle_ms))


def cooldown_stream(triggers: DataFrame, cap: int = 5, wait_ms: int = 300_000, idle_ms: int | None = None) -> DataFrame:
    """Triggers (session_id, at) that are accepted; caps and waits hold over batches."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, -1)
        out = []
        for at in sorted(int(a) for f in frames for a in f["at"]):
            if n < cap and (last < 0 or at - last >= wait_ms):
                n, last = n + 1, at
                out.append(at)
        state.update((n, last))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": [key[0]] * len(out), "at": out})

    return triggers.groupBy("session_id").applyInPandasWithState(step, "session_id long, at long", "n int, last long", "append", _timeout(idle_ms))
