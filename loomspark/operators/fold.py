"""Ordered folds in linear time: rows of each group stream by in order, one state is carried, no array of a group is made.

Where a decision depends on those before it, the rows are dealt by group, sorted
inside the partition and handed to a folder batch by batch. What is held is one
Arrow batch and the folder's own state, so a group of any length costs a sort and one
pass. Rows keep all their columns; the folder sees just those that it asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType


class Folder(Protocol):
    """The state of one group."""

    def step(self, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
        """The new columns of the group's next rows; a long group comes in several calls."""
        ...


def _starts(keys: list[pa.Array]) -> np.ndarray:
    """Rows of a batch whose key differs from the row before (nulls are equal); the first one is left to the caller."""
    out = np.zeros(len(keys[0]), bool)
    for k in keys:
        codes = k.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def fold_batches(batches: Iterator[pa.RecordBatch], by: list[str], columns: list[str], make: Callable[[], Folder], adds: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by group and order, with the folder's columns."""
    last, folder = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(c)) for c in by]
        key = tuple(k[0].as_py() for k in keys)
        starts = _starts(keys)
        starts[0] = folder is None or key != last
        last = tuple(k[-1].as_py() for k in keys)
        seen = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        cuts = [0, *[int(i) for i in np.flatnonzero(starts) if i], batch.num_rows]
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            if starts[a]:
                folder = make()
            parts.append(folder.step(*(c[a:b] for c in seen)))
        new = [pa.array(np.concatenate([p[k] for p in parts]), f.type) for k, f in enumerate(adds)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(f.name for f in adds)])


def ordered_fold(df: DataFrame, by: list[str], order: list[str | Column], columns: list[str], make: Callable[[], Folder], adds: dict[str, tuple[str, pa.DataType]], dealt: bool = False) -> DataFrame:
    """``df`` with the columns ``adds`` (name to SQL and Arrow type) that ``make()``'s folders give for each group's rows in order.

    ``dealt``: the rows are partitioned by group already. One shuffle and one sort.
    """
    fields = [pa.field(n, t) for n, (_, t) in adds.items()]
    schema = StructType(df.schema.fields)
    for n, (kind, _) in adds.items():
        schema = schema.add(n, kind)

    def run(batches):
        yield from fold_batches(batches, by, columns, make, fields)

    x = (df if dealt else df.repartition(*by)).sortWithinPartitions(*by, *order)
    return x.mapInArrow(run, schema)


class GreedyFill:
    """Keeps what has to stay, then each further row that still fits."""

    def __init__(self, budget: float):
        self.budget, self.used = budget, 0

    def step(self, must: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray]:
        out = np.zeros(len(tokens), bool)
        for i, (m, t) in enumerate(zip(must.tolist(), tokens.tolist())):
            if m or self.used + t <= self.budget:
                self.used += t
                out[i] = True
        return (out,)


class ChunkedFill:
    """Rows ``chunk`` at a time; each is kept while its chunk stays within ``share`` of what is left."""

    def __init__(self, budget: float, chunk: int, share: float):
        self.n, self.left, self.used, self.chunk, self.share = 0, float(budget), 0, chunk, share

    def step(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept, number = np.zeros(len(tokens), bool), (self.n + np.arange(len(tokens))) // self.chunk
        for i, t in enumerate(tokens.tolist()):
            if self.n % self.chunk == 0:
                self.left, self.used = self.left - self.used, 0
            if self.used + t <= self.left * self.share:
                self.used += t
                kept[i] = True
            self.n += 1
        return number, kept


class Share:
    """A share that moves from the last one towards each row's by ``rate``, with a least amount."""

    def __init__(self, rate: float, least: float):
        self.rate, self.least, self.last = rate, least, None

    def step(self, total: np.ndarray, percent: np.ndarray) -> tuple[np.ndarray]:
        out = np.zeros(len(total), np.int64)
        for i, (t, p) in enumerate(zip(total.tolist(), percent.tolist())):
            now = p if self.last is None else self.last + self.rate * (p - self.last)
            base = max(self.least, np.floor(t * now / 100 + 0.5))
            self.last = base / t * 100
            out[i] = int(base)
        return (out,)


class Cooldown:
    """Accepts a time unless the cap is reached or the last accepted one is too near."""

    def __init__(self, cap: int, wait: int):
        self.n, self.last, self.cap, self.wait = 0, None, cap, wait

    def step(self, at: np.ndarray) -> tuple[np.ndarray]:
        out = np.zeros(len(at), bool)
        for i, t in enumerate(at.tolist()):
            if self.n < self.cap and (self.last is None or t - self.last >= self.wait):
                self.n, self.last, out[i] = self.n + 1, t, True
        return (out,)
