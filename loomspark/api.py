"""The Python facade (K13): an engine over tables of messages and memories, for many sessions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import drift, models, recall, resume, select, state
from .plans import assemble, compaction, context
from .sources import files


class ContextEngine:
    """Capabilities over ``messages`` (session_id, idx, role, content) and ``memories`` (id, session_id, content, score)."""

    def __init__(self, spark: SparkSession, messages: DataFrame, memories: DataFrame, providers: files.Providers | None = None):
        self.spark, self.messages, self.memories, self.providers = spark, messages, memories, providers or files.Providers()

    def ingest(self, new: DataFrame, least: int = 20) -> "ContextEngine":
        """K3, A5: an engine that also holds the new messages worth storing."""
        return ContextEngine(self.spark, self.messages.unionByName(files.ingestable(new, least)), self.memories, self.providers)

    def build(self, budget: int = 400) -> DataFrame:
        """K1: one memory block for each session, within the budget."""
        return assemble.recall_blocks(self.memories.select("session_id", "id", "content", "score"), budget)

    def assemble(self, turns: DataFrame, hits: DataFrame, history: DataFrame, cards: DataFrame, outside: DataFrame, budget: int = 4000) -> DataFrame:
        """K1 in full: the context of every turn, with drift taken from the engine's own messages."""
        scores = drift.drift(self.messages.withColumn("turn", F.floor(F.col("idx") / 2)))
        return context.assemble(context.gather(turns, hits, history, cards, outside, scores, drift.alerts(scores), budget), budget)

    def compact(self, keep: int = 20) -> tuple[DataFrame, DataFrame]:
        """K2: kept messages and summaries of the others."""
        return assemble.compact(self.messages, keep)

    def compact_to(self, windows: DataFrame | int, strategy: str = "recent") -> compaction.Compaction:
        """K2 in full: every session brought to its share of the context window, with verdicts and the messages afterwards."""
        return compaction.compact_to(self.messages, windows, strategy)

    def inject(self, budget: int = 400) -> DataFrame:
        """Messages with their session's block in front, as a system message."""
        block = self.build(budget).select("session_id", F.lit(-1).cast("long").alias("idx"), F.lit("system").alias("role"), F.col("block").alias("content"))
        return block.unionByName(self.messages.select("session_id", F.col("idx").cast("long").alias("idx"), "role", "content"))

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        return recall.search(self.memories.select("id", "content"), queries, k)

    def summaries(self) -> DataFrame:
        """K9: session summaries."""
        return state.summaries(self.messages, ["session_id"])

    def history(self, summaries: DataFrame, now: int) -> DataFrame:
        """K4: history blocks of stored summaries."""
        return resume.history_block(summaries, ["session_id"], now)

    def drift(self) -> DataFrame:
        return drift.drift(self.messages.withColumn("turn", F.floor(F.col("idx") / 2)))

    def budget(self, total: int) -> DataFrame:
        """Task and tokens of each session against the total."""
        g = self.messages.groupBy("session_id").agg(F.sum(tx.heuristic_tokens(F.col("content"))).alias("used"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda r: r["content"])).alias("text"))
        return g.select("session_id", "used", (F.lit(total) - F.col("used")).alias("left"), tx.task_type(F.col("text")).alias("task"))

    def suffix(self, target: int) -> DataFrame:
        m = self.messages.select("session_id", "idx", tx.heuristic_tokens(F.col("content")).alias("tokens"))
        return select.suffix_keep(m, ["session_id"], "idx", "tokens", target)

    def models(self, asked: DataFrame) -> DataFrame:
        return models.hint(models.resolve(asked, models.profiles(self.spark)))

    def signals(self) -> DataFrame | None:
        """What the providers give."""
        return self.providers.signals(self.spark)

    def close(self, session_id: int) -> "ContextEngine":
        """An engine without a session's messages."""
        return ContextEngine(self.spark, self.messages.filter(F.col("session_id") != session_id), self.memories, self.providers)
