"""What follows every turn (K3, L2, L7): running session state, the compaction trigger and its log, as one stateful stream.

State lives in several variables of a session: counts, the newest usage, the trigger's
gate, and the last evaluations. A row whose index is not above the highest one seen is
a repetition and changes nothing. A session that is silent for ``idle`` of event time
is closed by a timer: it gives one row, and all its state is deleted. Results go to
a folder for each batch, which a repeated batch replaces, so that a restart writes
nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.text import heuristic_tokens

OUT = "session_id long, kind string, idx long, turn long, messages long, tokens long, effective long, caliber string, fire boolean, reason string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Trigger:
    """When a session should be compacted: at ``threshold`` tokens (``minimum`` at least), ``cap`` times at most, ``wait_ms`` apart."""

    threshold: int = 64_000
    minimum: int = 1_000
    cap: int = 10
    wait_ms: int = 60_000

    def decide(self, tokens: int, fired: int, last: int, at: int) -> tuple[bool, str]:
        """(fire, reason) for so many tokens after ``fired`` compactions, the last one at ``last`` (-1: none)."""
        limit = max(self.threshold, self.minimum)
        if tokens < self.minimum:
            return False, f"Token count below minimum ({tokens} < {self.minimum})"
        if tokens < limit:
            return False, ""
        if fired >= self.cap:
            return False, f"Session compaction limit reached ({fired}/{self.cap})"
        if last >= 0 and at - last < self.wait_ms:
            return False, f"Cooldown active ({(self.wait_ms - (at - last)) // 1000}s remaining)"
        return True, f"Token count {tokens} exceeds threshold {limit}"


def after_turn_rows(rows: list[tuple], counts: tuple, gate: tuple, trigger: Trigger) -> tuple[list[tuple], tuple, tuple]:
    """New rows (idx, role, tokens, usage or None, at) of a session in order: its results, and the counts and gate after them.

    counts: messages, tokens, highest index, turns. gate: compactions, time of the last.
    A turn ends with the assistant's message; reported usage goes before the estimate.
    """
    (n, total, high, turns), (fired, last), out = counts, gate, []
    for idx, role, tokens, usage, at in rows:
        if idx <= high:
            continue
        n, total, high = n + 1, total + tokens, idx
        if role != "assistant":
            continue
        turns += 1
        effective, caliber = (usage, "reported") if usage is not None else (total, "estimated")
        fire, reason = trigger.decide(effective, fired, last, at)
        if fire:
            fired, last = fired + 1, at
        out.append((idx, turns, n, total, effective, caliber, fire, reason))
    return out, (n, total, high, turns), (fired, last)


class AfterTurn(StatefulProcessor):
    """State of one session; ``idle_ms`` of event time closes it."""

    def __init__(self, trigger: Trigger, idle_ms: int, remembered: int = 20):
        self.trigger, self.idle_ms, self.remembered = trigger, idle_ms, remembered

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "messages long, tokens long, high long, turns long")
        self.gate = handle.getValueState("gate", "fired long, last long")
        self.usage = handle.getMapState("usage", "kind string", "value long")
        self.evaluations = handle.getListState("evaluations", "turn long, fire boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("idx", kind="stable")
        usage = [None if pd.isna(u) else int(u) for u in frame["usage"]]
        at = [int(x) for x in frame["at_ms"]]
        new = list(zip(frame["idx"].astype("int64").tolist(), frame["role"].tolist(), frame["tokens"].astype("int64").tolist(), usage, at))
        counts = tuple(self.counts.get() or (0, 0, -1, 0))  # each call is a round trip to the store: none to ask first
        gate = tuple(self.gate.get() or (0, -1))
        out, counts, gate = after_turn_rows(new, counts, gate, self.trigger)
        self.counts.update(counts)
        self.gate.update(gate)
        if known := [u for u in usage if u is not None]:
            self.usage.updateValue(("latest",), (known[-1],))
        if out:
            before = [tuple(e) for e in self.evaluations.get()]
            self.evaluations.put([*before, *((r[1], r[6]) for r in out)][-self.remembered :])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(at) + self.idle_ms)
        yield self._frame(key, [("turn", *r) for r in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, total, high, turns = self.counts.get()
        shots = sum(bool(e[1]) for e in self.evaluations.get())
        for state in (self.counts, self.gate, self.usage, self.evaluations):
            state.clear()
        yield self._frame(key, [("closed", high, turns, n, total, total, "", False, f"{shots} of the last evaluations fired")])

    @staticmethod
    def _frame(key, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=names)

    def close(self) -> None:
        pass


def after_turn(messages: DataFrame, trigger: Trigger | None = None, idle_ms: int = 30 * 86_400_000, late: str = "1 hour") -> DataFrame:
    """A stream of (session_id, idx, role, content, at timestamp, usage: merged tokens or null) to a row for each turn and each closed session."""
    x = messages.withColumn("tokens", heuristic_tokens(F.col("content"))).withColumn("at_ms", F.unix_millis("at"))
    x = x.select("session_id", "idx", "role", "tokens", "usage", "at", "at_ms").withWatermark("at", late)
    return x.groupBy("session_id").transformWithStateInPandas(AfterTurn(trigger or Trigger(), idle_ms), OUT, "Append", "EventTime")


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stateful stream until its input is used up, into ``path/batch_id=N``; the state needs RocksDB."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        return stream.writeStream.foreachBatch(lambda batch, n: store_batch(batch, n, path)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def store_batch(batch: DataFrame, number: int, path: str) -> None:
    """The idempotent sink: a batch owns a folder, so that doing it again replaces what it wrote."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")


def after_turn_batch(messages: DataFrame, trigger: Trigger | None = None) -> DataFrame:
    """The same turns from a whole table, by an ordered fold; columns of ``after_turn`` but for kind."""
    import numpy as np
    import pyarrow as pa

    from ..operators.fold import ordered_fold

    trigger = trigger or Trigger()

    class Turns:
        def __init__(self):
            self.counts, self.gate = (0, 0, -1, 0), (0, -1)

        def step(self, idx, role, tokens, usage, at):
            rows = []
            for i, r, t, u, a in zip(idx.tolist(), role.tolist(), tokens.tolist(), usage.tolist(), at.tolist()):
                out, self.counts, self.gate = after_turn_rows([(i, r, t, None if u is None or u != u else int(u), a)], self.counts, self.gate, trigger)
                rows.append(out[0] if out else (i, 0, 0, 0, 0, "", False, ""))
            kinds = (np.int64, np.int64, np.int64, np.int64, object, bool, object)
            return tuple(np.array([r[k + 1] for r in rows], d) for k, d in enumerate(kinds))

    x = messages.select("session_id", "idx", "role", heuristic_tokens(F.col("content")).alias("_tokens"), F.col("usage").cast("double").alias("usage"), F.unix_millis("at").alias("at_ms"))
    longs = {n: ("long", pa.int64()) for n in ("turn", "messages", "tokens", "effective")}
    adds = longs | {"caliber": ("string", pa.string()), "fire": ("boolean", pa.bool_()), "reason": ("string", pa.string())}
    out = ordered_fold(x, ["session_id"], ["idx"], ["idx", "role", "_tokens", "usage", "at_ms"], Turns, adds)
    return out.filter("turn > 0").select("session_id", "idx", *adds)
