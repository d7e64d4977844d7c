"""File sources and sinks: transcripts, ledgers, model profiles, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER_TYPES = ("session", "model_change", "thinking_level_change", "custom", "custom_message")
ENTRY = "type string, id string, parentId string, timestamp string, sessionId string, message struct<role:string,content:string>, derived struct<schemaVersion:int,derivedBy:string,sourceSessionId:string>, digestRound int"
COST = "at long, sessionId string, triggerReason string, inputTokens long, outputTokens long, cachedTokenShare double, strategyVersion string"
USAGE = "kind string, sessionId string, record map<string,double>, evaluation map<string,string>"
QUALITY = "k string, at long, sessionId string, triggerReason string, summaryText string, removedCount long, consistency string"


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """A1, A2: entries of JSONL transcripts with their raw line; lines that don't parse have type 'unparseable', others without a type 'unknown'. An interrupted rewrite is ended first."""
    recover(spark, path)
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("raw"), F.from_json("value", ENTRY).alias("e"))
    good = F.try_parse_json("raw").isNotNull()
    kind = F.when(~good, "unparseable").otherwise(F.coalesce("e.type", F.lit("unknown")))
    return lines.select("raw", kind.alias("type"), "e.id", "e.parentId", "e.timestamp", "e.sessionId", "e.message", "e.derived", "e.digestRound", kind.isin(*HEADER_TYPES).alias("is_header"))


def write_transcript(parts: list[DataFrame], path: str) -> None:
    """A3: headers, digest, summary and kept lines, in that order; each part has (seq, raw).

    Written beside the old transcript and then moved into its place. A crash at any
    step leaves the old or the new transcript whole, and ``recover``, which reading and
    writing call, puts it back at its path. One writer for each transcript at a time.
    """
    out = None
    for k, p in enumerate(parts):
        x = p.select(F.lit(k).alias("part"), "seq", "raw")
        out = x if out is None else out.unionByName(x)
    recover(out.sparkSession, path)
    out.repartitionByRange("part", "seq").sortWithinPartitions("part", "seq").select("raw").write.mode("overwrite").text(f"{path}.new")
    swap(out.sparkSession, f"{path}.new", path)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the function that makes its paths."""
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def recover(spark: SparkSession, path: str) -> None:
    """Ends what a crash inside ``swap`` left open: the new folder takes the path if its write had ended, else the old one comes back."""
    fs, at = _files(spark, path)
    if fs.exists(at(path)) or not fs.exists(at(f"{path}.old")):
        return
    left = f"{path}.new" if fs.exists(at(f"{path}.new/_SUCCESS")) else f"{path}.old"
    if not fs.rename(at(left), at(path)) and not fs.exists(at(path)):
        raise OSError(f"cannot move {left} to {path}")


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Move a finished folder into the place of another, if there is one; between the two moves ``recover`` knows both."""
    fs, at = _files(spark, path)
    if not fs.exists(at(new)):
        raise FileNotFoundError(new)
    old = f"{path}.old"
    if fs.exists(at(path)):
        if fs.exists(at(old)):  # left by a crash after the second move
            fs.delete(at(old), True)
        if not fs.rename(at(path), at(old)):
            raise OSError(f"cannot move {path} to {old}")
    if not fs.rename(at(new), at(path)) and (fs.exists(at(new)) or not fs.exists(at(path))):  # a reader may have done it
        raise OSError(f"cannot move {new} to {path}")
    fs.delete(at(old), True)


def ingestable(messages: DataFrame, least: int = 20, heartbeat: str = "HEARTBEAT") -> DataFrame:
    """A5: messages worth storing: long enough and no heartbeat."""
    return messages.filter((F.char_length("content") >= least) & ~F.col("content").startswith(heartbeat))


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """Cost records with ``valid``: types and ranges hold. Count the bad ones with ``count_if(not valid)``."""
    x = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", COST).alias("r")).select("r.*")
    share = F.col("cachedTokenShare")
    ok = F.col("at").isNotNull() & (F.col("inputTokens") >= 0) & (F.col("outputTokens") >= 0) & F.col("triggerReason").isNotNull() & (share.isNull() | share.between(0, 1))
    return x.withColumn("valid", F.coalesce(ok, F.lit(False)))


def append_costs(records: DataFrame, path: str) -> None:
    """Append as JSON lines."""
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.mode("append").text(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """(sessionId, kind, record, evaluation) of usage ledgers; lines that don't parse, or hold neither, are skipped."""
    x = spark.read.text(path).select(F.from_json("value", USAGE).alias("r")).select("r.*")
    return x.filter(((F.col("kind") == "usage") & F.col("record").isNotNull()) | ((F.col("kind") == "evaluation") & F.col("evaluation").isNotNull()))


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """Compaction quality records, with ``valid`` for lines of kind 'cq'."""
    x = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", QUALITY).alias("r")).select("r.*")
    return x.withColumn("valid", F.coalesce((F.col("k") == "cq") & F.col("at").isNotNull(), F.lit(False)))


def write_quality(records: DataFrame, path: str, rows_per_file: int = 2000) -> None:
    """A10: quality records; files are rolled by rows."""
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.option("maxRecordsPerFile", rows_per_file).mode("append").text(path)


def overlay(builtin: DataFrame, custom: DataFrame, key: str = "id") -> DataFrame:
    """Custom rows replace built-in ones of the same id."""
    return builtin.join(custom.select(key), key, "left_anti").unionByName(custom)


def snapshots_json(snapshots: DataFrame, session: str | None = None, since: int | None = None, until: int | None = None, strategy: str | None = None) -> DataFrame:
    """Snapshots of a session, time range and strategy as JSON, one row each."""
    x = snapshots
    for keep in ([F.col("session_id") == session] if session is not None else []) + ([F.col("at") >= since] if since is not None else []) + ([F.col("at") <= until] if until is not None else []) + ([F.col("strategy") == strategy] if strategy else []):
        x = x.filter(keep)
    return x.select("id", F.to_json(F.struct(*x.columns)).alias("json"))


def keep_last(snapshots: DataFrame, most: int = 200, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """The last snapshots of each group by time, then id; of the whole store without ``by``."""
    if not by:
        return snapshots.orderBy(F.desc("at"), F.desc("id")).limit(most)
    w = Window.partitionBy(*by).orderBy(F.desc("at"), F.desc("id"))
    return snapshots.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


class Providers:
    """Signal providers by name; each is a callable (spark) -> DataFrame."""

    def __init__(self):
        self._known: dict[str, object] = {}

    def register(self, name: str, provider) -> None:
        self._known[name] = provider

    def signals(self, spark: SparkSession) -> DataFrame | None:
        """The union of what all providers give, with their names."""
        out = None
        for name, provider in self._known.items():
            x = provider(spark).withColumn("provider", F.lit(name))
            out = x if out is None else out.unionByName(x, allowMissingColumns=True)
        return out
