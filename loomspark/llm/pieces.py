"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads the text once; at each position the output links name every
piece that ends there, longest first, and each relaxes the best score of the
position. Characters that no piece covers fall back to byte pieces, at a penalty
below every score. Scores are the vocabulary's own.

Spaces stand for the vocabulary's own space sign, and a space is put in front of
the text, as the vocabulary expects. A literal space sign in a text goes to bytes,
so that decoding gives every text back exactly.

No piece has a space behind another character, and none holds a line feed among
others (both are checked, else whole texts are one segment), so the best path
decomposes at these places; a worker remembers the paths of segments it has met.

The vocabulary (tens of thousands of pieces, a fixed file) is read on the driver
and broadcast; executors need no file.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SIGN = "▁"
#: Segments that a worker remembers, at most.
REMEMBER = 300_000
#: Followed failure links that an automaton keeps, at most.
SHORTCUTS = 400_000


def read_vocabulary(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is n(ormal), b(yte), or s(pecial)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "b" if p.is_byte(i) else "s" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "n"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


_LEAST = float("-inf")


class Codec:
    """Encoder and decoder for a vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        self.children: list[dict[str, int]] = [{}]
        self.piece = [-1]  # id of the piece that a state spells, -1 for none
        self.depth = [0]
        self.score = [s for _, s, _ in vocabulary]
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        normal = []
        for i, (p, _, kind) in enumerate(vocabulary):
            if kind == "b":
                value = int(p[1:-1], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif kind == "n":
                text = p.replace(SIGN, " ")
                normal.append(text)
                self.bytes_of.append(text.encode())
                self._add(text, i)
            else:
                self.bytes_of.append(b"")
        self._link()
        if len(self.byte_id) < 256:
            raise ValueError("the vocabulary has no byte pieces: texts outside it could not be given back")
        self.penalty = min(self.score) - 10.0
        self.alphabet = {c for p in normal for c in p}
        inner = any(" " in p.lstrip(" ") for p in normal)
        feed = any("\n" in p and p != "\n" for p in normal)
        self.segments = re.compile(r"(?s).+") if inner else re.compile(r" +[^ ]*") if feed else re.compile(r" +[^ \n]*|\n[^ \n]*")
        self.known: dict[str, tuple[int, ...]] = {}

    def _add(self, text: str, i: int) -> None:
        state = 0
        for c in text:
            state = self.children[state].setdefault(c, len(self.children))
            if state == len(self.children):
                self.children.append({})
                self.piece.append(-1)
                self.depth.append(0)
        self.piece[state] = i
        self.depth[state] = len(text)

    def _link(self) -> None:
        """Failure and output links, breadth first."""
        n = len(self.children)
        self.fail, self.out = [0] * n, [0] * n
        queue = list(self.children[0].values())
        for state in queue:
            for c, to in self.children[state].items():
                queue.append(to)
                back = self.fail[state]
                while back and c not in self.children[back]:
                    back = self.fail[back]
                self.fail[to] = self.children[back].get(c, 0)
        for state in queue:
            back = self.fail[state]
            self.out[state] = back if self.piece[back] >= 0 else self.out[back]
        self.ends = [state if self.piece[state] >= 0 else self.out[state] for state in range(n)]  # the longest piece that ends in a state
        self.value = [self.score[p] if p >= 0 else 0.0 for p in self.piece]
        self.singles = {c for c, to in self.children[0].items() if self.piece[to] >= 0}
        self.room = SHORTCUTS
        self.step = self.children  # from here on also holds followed failure links, as they are met

    def _next(self, state: int, c: str) -> int:
        if c not in self.alphabet:
            return 0
        back = state
        while back and c not in self.step[back]:
            back = self.fail[back]
        to = self.step[back].get(c, 0)
        if self.room:
            self.room -= 1
            self.step[state][c] = to
        return to

    def path(self, segment: str) -> tuple[int, ...]:
        """The ids of the best segmentation; of equal ones, that with the longer last piece."""
        step, out, depth, value, ends, singles = self.step, self.out, self.depth, self.value, self.ends, self.singles
        best, back = [0.0], [(0, 0)]
        state = i = 0
        for c in segment:
            i += 1
            to = step[state].get(c)
            state = self._next(state, c) if to is None else to
            # Bytes never beat the piece of the character itself.
            top, come = (_LEAST, None) if c in singles else (best[i - 1] + self.penalty * len(c.encode("utf-8", "surrogatepass")), (i - 1, 0))
            at = ends[state]
            while at:
                j = i - depth[at]
                s = best[j] + value[at]
                if s > top:
                    top, come = s, (j, at)
                at = out[at]
            best.append(top)
            back.append(come)
        ids: list[int] = []
        while i:
            j, at = back[i]
            if at:
                ids.append(self.piece[at])
            else:
                ids.extend(self.byte_id[b] for b in reversed(segment[j:i].encode("utf-8", "surrogatepass")))
            i = j
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; none for an empty one."""
        if not text:
            return []
        known = self.known
        parts = self.segments.findall(" " + text)
        if len(known) > REMEMBER:
            known.clear()
        long: dict[str, tuple[int, ...]] = {}
        for p in set(parts).difference(known):
            (known if len(p) < 64 else long)[p] = self.path(p)
        if long:
            return [i for p in parts for i in (known[p] if len(p) < 64 else long[p])]
        return list(chain.from_iterable(map(known.__getitem__, parts)))

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:].decode("utf-8", "surrogatepass")


_CODECS: dict[str, Codec] = {}


def codec_for(vocabulary: list[tuple[str, float, str]], name: str) -> Codec:
    """One codec for each vocabulary and worker."""
    if name not in _CODECS:
        _CODECS[name] = Codec(vocabulary)
    return _CODECS[name]


def _shared(spark, model: str):
    vocabulary = read_vocabulary(model)
    return spark.sparkContext.broadcast(vocabulary), hashlib.sha256(repr(vocabulary).encode()).hexdigest()


def _with_column(docs: DataFrame, source: str, out: str, kind: str, arrow: pa.DataType, model: str, of) -> DataFrame:
    """Add a column made row by row from another, in slices small enough that long texts don't add up."""
    vocabulary, name = _shared(docs.sparkSession, model)
    kept = [c for c in docs.columns if c != out or c == source]
    at = kept.index(source)

    @lean
    def run(batches):
        codec = codec_for(vocabulary.value, name)
        for part in slices(batches, 200):
            made = pa.array([None if x is None else of(codec, x) for x in part.column(at).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*kept, "_made"])

    x = docs.select(*kept)
    schema = T.StructType([*x.schema.fields, T.StructField("_made", T._parse_datatype_string(kind))])
    return x.mapInArrow(run, schema).select(*[c for c in kept if c != out], F.col("_made").alias(out))


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the ids of the text; null for a null text, empty for an empty one. A column of that name is replaced."""
    return _with_column(docs, text, out, "array<int>", pa.list_(pa.int32()), model, lambda codec, t: np.array(codec.encode(t), dtype=np.int32))


def decode(docs: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add ``out``, the text of the ids; null for null. A column of that name is replaced."""
    return _with_column(docs, ids, out, "string", pa.string(), model, lambda codec, x: codec.decode(x))


def encode_and_check(docs: DataFrame, model: str = MODEL, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(key, n_tokens, n_byte_tokens, ids_sha256, round_trip[, ids]) of every document.

    ``round_trip`` says whether decoding the ids gives the text back. A null text
    counts as empty: no tokens, and true. ``ids_sha256`` is over the ids as
    little-endian 32-bit integers. Rows stay as they are, repeated ones too; an
    empty table gives an empty result; other columns are not read.
    """
    vocabulary, name = _shared(docs.sparkSession, model)
    schema = f"{key} long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids

    @lean
    def run(batches):
        codec = codec_for(vocabulary.value, name)
        is_byte = np.zeros(len(codec.bytes_of), dtype=bool)
        is_byte[list(codec.byte_id.values())] = True
        for batch in slices(batches, 200):
            n, nb, sha, same, kept = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                ids = codec.encode(t or "")
                packed = np.array(ids, dtype="<i4")
                n.append(len(ids))
                nb.append(int(is_byte[packed].sum()))
                sha.append(hashlib.sha256(packed.tobytes()).hexdigest())
                same.append(codec.decode(ids) == (t or ""))
                if keep_ids:
                    kept.append(packed)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(nb, pa.int64()), pa.array(sha), pa.array(same)]
            names = [key, "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names=names + ["ids"] * keep_ids)

    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
