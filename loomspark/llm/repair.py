"""Conversation structure repair: cheapest edits under a grammar of roles, by DuckDB's recursion inside hash partitions.

A conversation's role initials must have the form ``(s?(ua)+)?``: nothing, or an
optional system turn and then user and assistant in turn. Edits are Keep (free),
Rerole (3), Delete (4, the only one for blank and repeated rows) and Insert of an
empty user or assistant turn (3, anywhere); a truncated row that stays adds 3. The
grammar has four states (START, after system, after user, after assistant), so the
cheapest edits are a walk that keeps, for each state, the least cost and, among
equals, the least string of initials. (Two strings of one cost that end in one
state after the same rows are never a prefix of each other, since what the longer
one had more would be insertions, which cost; so the least stays the least whatever
follows.)

Spark orders the rows, finds the faults and deals pieces of at most 64 rows of a
conversation by hash. Each task hands batches of whole pieces to DuckDB, whose
recursive query moves all pieces of the batch by one turn at a time; its table is
keyed by (piece, state before, state behind), so it holds the last costs and audits
alone. The results of a conversation's pieces are transitions themselves, and the
same recursion joins eight of them at a time until one is left. So a conversation
of any length spreads over all tasks, and no task gathers one whole: the only pass
in a conversation's order is the last one, which streams its rows through SHA-256
(a hash of a sequence can't be split) and holds one batch and the edits' initials.

Odd input. Null roles and texts count as one space. Null turns come first; rows of
one turn are ordered by role, then by a hash of the text, then by text. A null
conv_id is a conversation. Roles count by their first character, whatever it is; an
empty role has none and is never legal. Costs and gaps are longs (gaps beyond are
given as the largest). No rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, slices, stash

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
#: Grammar states: at the start, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role's initial leads to, for each state that allows it.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ACCEPTED = (START, ASSISTANT)
#: Rows of a piece (as a power of two), and pieces that are joined at a time (likewise).
PIECE_BITS, JOIN_BITS = 6, 3
BATCH_ROWS, BATCH_BYTES = 20_000, 4_000_000
SPACE = " \t\n\x0b\x0c\r"
CLASSES = ("s", "u", "a", "")
#: What can be done with a row: all is free of faults, it is truncated, or it has to go.
SOUND, CUT, GONE = range(3)


def _insertions(state: int) -> list[tuple[int, int]]:
    """(state, how many) that insertions alone lead to, each by the fewest."""
    out = [(state, 0)]
    for at, n in out:
        out += [(to, n + 1) for c in "ua" for a, to in NEXT[c].items() if a == at and to not in [s for s, _ in out]]
    return out


def _moves() -> list[tuple[int, int, int, int, str]]:
    """(kind, state before, state behind, cost, initials): the best way over a row of each kind, insertions before it included."""
    best: dict[tuple[int, int, int], tuple[int, str]] = {}
    for c, initial in enumerate(CLASSES):
        for fault in (SOUND, CUT, GONE):
            for before in range(4):
                for at, n in _insertions(before):
                    ways = [(DELETE, at)]
                    if fault != GONE:
                        ways += [(KEEP, to) for a, to in NEXT.get(initial, {}).items() if a == at]
                        ways += [(REROLE, to) for r in "ua" for a, to in NEXT[r].items() if a == at]
                    for edit, to in ways:
                        cost = n * COST[INSERT] + COST[edit] + (TRUNCATED_COST if fault == CUT and edit != DELETE else 0)
                        key, way = (c * 3 + fault, before, to), (cost, INSERT * n + edit)
                        best[key] = min(best.get(key, way), way)
    return [(*k, *v) for k, v in best.items()]


#: One turn at a time for all pieces of a batch; the table keeps the last row of each key.
WALK = """
WITH RECURSIVE walk(unit, began, state, i, cost, audit) USING KEY (unit, began, state) AS (
  SELECT u.unit, s.state, s.state, 0::BIGINT, 0::BIGINT, ''
  FROM units u JOIN (VALUES (0), (1), (2), (3)) s(state) ON s.state = 0 OR NOT u.leads
  UNION
  SELECT unit, began, state, i, best.cost, best.audit FROM (
    SELECT w.unit, w.began, m.behind AS state, w.i + 1 AS i, min({'cost': w.cost + m.cost, 'audit': w.audit || m.letters}) AS best
    FROM walk w JOIN steps p ON p.unit = w.unit AND p.i = w.i JOIN moves m ON m.kind = p.kind AND m.before = w.state
    GROUP BY w.unit, w.began, m.behind, w.i)
)
SELECT unit, list({'before': began::INT, 'behind': state::INT, 'cost': cost, 'letters': audit} ORDER BY began, state) AS moves
FROM walk GROUP BY unit ORDER BY unit"""

#: First and last initial of each piece, and the illegal neighbours inside.
NEIGHBOURS = """
SELECT unit, first(head ORDER BY i) AS head, last(tail ORDER BY i) AS tail,
  (sum(illegal) + count(*) FILTER (before IS NOT NULL AND before || head NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal
FROM (SELECT *, lag(tail) OVER (PARTITION BY unit ORDER BY i) AS before FROM ends) GROUP BY unit ORDER BY unit"""

PIECE = "origin long, piece long, head string, tail string, illegal long, moves array<struct<before:int,behind:int,cost:bigint,letters:string>>"


def _duck() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "600MB", "temp_directory": ""})


def _advance(con, table: pa.Table, unit: np.ndarray, kinds, moves: pa.Table, illegal) -> pa.RecordBatch:
    """Joins the rows of each unit; ``table`` has conv, origin, piece, head and tail in order, ``unit`` numbers them from 0."""
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    i = np.arange(len(unit)) - np.repeat(starts, np.diff(np.r_[starts, len(unit)]))
    pieces = table.column("piece").take(pa.array(starts))
    con.register("units", pa.table({"unit": np.arange(len(starts)), "leads": np.asarray(pieces) == 0}))
    con.register("steps", pa.table({"unit": unit, "i": i, "kind": kinds}))
    con.register("moves", moves)
    con.register("ends", pa.table({"unit": unit, "i": i, "head": table.column("head"), "tail": table.column("tail"), "illegal": illegal}))
    walked, near = con.sql(WALK).to_arrow_table(), con.sql(NEIGHBOURS).to_arrow_table()
    one = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    letters = pa.list_(pa.struct([("before", pa.int32()), ("behind", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
    columns = [*(one(table.column(c).take(pa.array(starts))) for c in ("conv", "origin")), one(pieces), *(one(near.column(c)) for c in ("head", "tail", "illegal")), one(walked.column("moves").cast(letters))]
    return pa.RecordBatch.from_arrays(columns, ["conv", "origin", "piece", "head", "tail", "illegal", "moves"])


def _whole_units(batches, weigh):
    """Tables that end where ``unit`` ends and hold about BATCH_ROWS rows or BATCH_BYTES bytes; units arrive in a row and are small."""
    held, size = [], 0
    for batch in slices(batches, 2000):
        held.append(batch)
        size += weigh(batch)
        if size < 1:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        unit = np.asarray(table.column("unit"))
        end = int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if unit[0] != unit[-1] else 0
        if end:
            yield table.slice(0, end)
            held = table.slice(end).to_batches()
            size = sum(map(weigh, held))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbers(column) -> np.ndarray:
    """Runs of equal values, numbered from 0."""
    values = np.asarray(column)
    return np.cumsum(np.r_[0, values[1:] != values[:-1]])


def _walk_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv, origin, unit, piece, at, head, kind) to pieces; a unit is a piece of one conversation."""

    @lean
    def run(batches):
        con = _duck()
        names = ("kind", "before", "behind", "cost", "letters")
        moves = pa.table({n: [m[k] for m in _moves()] for k, n in enumerate(names)})
        for table in _whole_units(batches, lambda b: b.num_rows / BATCH_ROWS):
            table = table.append_column("tail", table.column("head"))
            yield _advance(con, table, _numbers(table.column("unit")), table.column("kind"), moves, np.zeros(len(table), np.int64))
        con.close()

    kind = rows.schema["conv"].dataType.simpleString()
    dealt = rows.repartition("unit").sortWithinPartitions("at").select("conv", "origin", "unit", "piece", "head", "kind")
    return dealt.mapInArrow(run, f"conv {kind}, {PIECE}")


def _join_pieces(pieces: DataFrame, bits: int) -> DataFrame:
    """Neighbouring pieces of a conversation to one, eight at a time; ``bits``: rows of a joined piece as a power of two."""

    @lean
    def run(batches):
        con = _duck()
        weigh = lambda b: max(b.num_rows / BATCH_ROWS, b.nbytes / BATCH_BYTES)
        for table in _whole_units(batches, weigh):
            lists = table.column("moves").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat, counts = lists.flatten(), np.diff(np.asarray(lists.offsets))
            moves = {n: flat.field(n) for n in ("before", "behind", "cost", "letters")}
            moves = pa.table({"kind": np.repeat(np.arange(len(table)), counts)} | moves)
            yield _advance(con, table, _numbers(table.column("unit")), np.arange(len(table)), moves, table.column("illegal"))
        con.close()

    kind = pieces.schema["conv"].dataType.simpleString()
    joined = pieces.withColumns({"_part": F.col("piece"), "piece": F.shiftright("piece", JOIN_BITS)})
    joined = joined.withColumn("unit", F.col("origin") + F.shiftleft("piece", bits))  # a row of the conversation's own
    dealt = joined.repartition("unit").sortWithinPartitions("unit", "_part")
    return dealt.select("conv", "origin", "unit", "piece", "head", "tail", "illegal", "moves").mapInArrow(run, f"conv {kind}, {PIECE}")


def _closed(pieces: DataFrame) -> DataFrame:
    """(conv, illegal, cost, audit) of conversations that are one piece: insertions behind the last row, then the cheapest accepted end."""
    tail = {s: min((n for to, n in _insertions(s) if to in ACCEPTED)) for s in range(4)}
    extra = F.element_at(F.array(*(F.lit(tail[s]) for s in range(4))), F.col("m.behind") + 1)
    ends = pieces.select("conv", "illegal", F.explode("moves").alias("m")).filter("m.before = 0")
    ends = ends.select("conv", "illegal", F.struct((F.col("m.cost") + extra * COST[INSERT]).alias("cost"), F.concat("m.letters", F.repeat(F.lit(INSERT), extra)).alias("audit")).alias("end"))
    best = ends.groupBy("conv", "illegal").agg(F.min("end").alias("end"))
    return best.select("conv", "illegal", F.col("end.cost").alias("cost"), F.col("end.audit").alias("audit"))


class _Hash:
    """Streams one conversation's rows under its edits."""

    def __init__(self, audit: str):
        self.audit, self.next, self.state, self.sha, self.any = audit, 0, START, hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def turn(self) -> str:
        """The role that comes next, user or assistant."""
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def inserted(self) -> None:
        while self.next < len(self.audit) and self.audit[self.next] == INSERT:
            self.add(self.turn(), "")
            self.next += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.next]
        self.next += 1
        if edit == REROLE:
            self.add(self.turn(), text)
        elif edit == KEEP:
            if role[:1] == "s":
                self.state = SYSTEM
            else:
                self.turn()
            self.add(role, text)

    def end(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


def _hashed(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """``repaired`` with repaired_sha256: a conversation's rows stream by behind its edits."""

    @lean
    def run(batches):
        now, head, n_rows = None, None, 0
        for batch in slices(batches, 2000):
            out: list[tuple] = []
            for at, role, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if at < 0:
                    if now:
                        out.append((head, now.end()))
                    head, now = batch.column(0).slice(n_rows, 1), _Hash(text)
                else:
                    now.row(role, text)
                n_rows += 1
            n_rows = 0
            if out:
                yield _pairs(out)
        if now:
            yield _pairs([(head, now.end())])

    kind = rows.schema["conv"].dataType.simpleString()
    lines = repaired.select("conv", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    lines = rows.select("conv", "at", "role", "text").unionByName(lines).repartition("conv").sortWithinPartitions("conv", "at")
    hashes = lines.mapInArrow(run, f"conv {kind}, repaired_sha256 string")
    return repaired.join(hashes.withColumnRenamed("conv", "_of"), F.col("conv").eqNullSafe(F.col("_of"))).drop("_of")


def _pairs(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([h for h, _ in out]), pa.array([s for _, s in out])], ["conv", "repaired_sha256"])


def damage(df: DataFrame) -> DataFrame:
    """The rows with faults put in by the CRC-32 of ``conv_id:turn``: one of twenty each is dropped, emptied, cut, repeated, or made the user's."""
    space = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("_fate")).filter("_fate != 0")
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def repair(df: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that has rows."""
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keys = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc(F.xxhash64("text"))]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, F.asc("text"))
    rows = stash(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")  # partitions in order, 2**33 numbers each

    bare = F.rtrim("text", F.lit(SPACE))
    slim = rows.select("conv", "turn", "role", "at", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.sha2("text", 256).alias("_sha"))
    slim = stash(slim, "faults")
    first = slim.groupBy("conv", "role", "_sha").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    counts = {int(p): n for p, n in slim.groupBy(F.shiftright("at", 33)).count().collect()}  # one for each partition
    before, sums = 0, []
    for p in sorted(counts):
        sums.append((p, before))
        before += counts[p]
    offsets = spark.createDataFrame(sums, "_p long, _before long")
    fault = F.when(F.col("blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    placed = slim.join(first, "at", "left").withColumn("_p", F.shiftright("at", 33)).join(F.broadcast(offsets), "_p")
    placed = placed.select("conv", "turn", "at", F.left("role", F.lit(1)).alias("head"), fault.alias("fault"), (F.col("_before") + F.col("at").bitwiseAND(2**33 - 1)).alias("pos"))
    placed = stash(placed, "placed")

    is_ = lambda f: F.sum(F.when(F.col("fault") == f, 1).otherwise(0)).alias(f)
    turns = placed.groupBy("conv", "turn").agg(is_("blank"), is_("duplicate"), is_("truncated"), F.min("pos").alias("_start"))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = F.when(F.count("turn") > 0, F.least(wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn"), wide(F.lit(2**63 - 1))))
    stats = turns.groupBy("conv").agg(F.coalesce(gaps.cast("long"), F.lit(0)).alias("gaps"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")), F.min("_start").alias("_start"))
    stats = stash(stats, "conversations")

    kind = F.coalesce(F.array_position(F.array(*map(F.lit, CLASSES[:3])), F.col("head")), F.lit(0))
    kind = F.when(kind == 0, len(CLASSES) - 1).otherwise(kind - 1) * 3
    kind = kind + F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(SOUND)
    piece = F.shiftright(F.col("pos") - F.col("_start"), PIECE_BITS)
    starts = stats.select(F.col("conv").alias("_of"), "_start")
    steps = placed.join(starts, F.col("conv").eqNullSafe(F.col("_of"))).select("conv", F.col("_start").alias("origin"), (F.col("_start") + F.shiftleft(piece, PIECE_BITS)).alias("unit"), piece.alias("piece"), "at", "head", kind.cast("int").alias("kind"))
    pieces = stash(_walk_rows(steps), "pieces")
    bits = PIECE_BITS
    while (pieces.agg(F.max("piece")).first()[0] or 0) > 0:
        bits += JOIN_BITS
        pieces = stash(_join_pieces(pieces, bits), "pieces")
    done = _hashed(rows, stash(_closed(pieces), "repaired"))
    out = done.join(stats.withColumnRenamed("conv", "_of"), F.col("conv").eqNullSafe(F.col("_of")))
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(df: DataFrame) -> DataFrame:
    """What ``repair`` makes of the damaged rows, for every conversation of ``df``; zeros and empty for those with no row left."""
    every = df.select(F.col("conv_id").alias("_id")).distinct()
    out = every.join(repair(damage(df)), F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
