"""Byte-level BPE encoding and decoding.

Method: a segment tree over the byte positions of a piece keeps, at its root, the leftmost of the lowest-ranked adjacent
pairs.  A merge joins two live neighbours and makes three point updates (the merged pair, the pair before it and the
vanished one), each logarithmic in the piece's length, so that a run of a million bytes without a split costs n log n.  Nodes have
FAN children, so that the tree of a common word is its root and leaves.

Defined cases: a null text counts as empty; a text of any length is encoded whole; no result depends on the order of rows, so ties have no meaning; an empty text has no ids and decodes to no bytes; repeated rows are encoded
each; an empty table gives an empty table; columns named like the output columns are replaced, all others are kept.
The rank file is read once on the driver (a vocabulary is of fixed size) and broadcast.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, released, slices

#: Bytes that a task's cache of pieces and their ids takes, about; when full it starts afresh, and it goes with the task.
CACHE_BYTES = 80 << 20
#: Longer pieces are merged each time they occur.
CACHE_PIECE_CHARS = 48

#: Children of a node of the segment tree.
FAN = 32

_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int], longest: int) -> tuple[int, ...]:
    """Ids of one piece; the piece's bytes must all be tokens themselves."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    shift = n.bit_length()
    get = ranks.get
    leaves = [_NONE if (rank := get(piece[i : i + 2])) is None else rank << shift | i for i in range(n - 1)]
    leaves.append(_NONE)  # no pair begins at the last byte
    levels = [leaves]
    while len(levels[-1]) > FAN:
        under = levels[-1]
        levels.append([min(under[k : k + FAN]) for k in range(0, len(under), FAN)])
    top, inner = levels[-1], len(levels) > 1
    after = list(range(1, n + 2))  # start of the next live symbol
    before = list(range(-1, n))
    mask = (1 << shift) - 1
    while (least := min(top)) != _NONE:
        i = least & mask
        gone, back = after[i], before[i]
        end = after[i] = after[gone]
        leaves[gone] = leaves[i] = _NONE
        if end < n:
            before[end] = i
            to = after[end]
            if to - i <= longest and (rank := get(piece[i:to])) is not None:
                leaves[i] = rank << shift | i
        if back >= 0:
            rank = get(piece[back:end]) if end - back <= longest else None
            leaves[back] = _NONE if rank is None else rank << shift | back
        if inner:
            for k in (gone, i, back) if back >= 0 else (gone, i):  # point updates, each up to where nothing changes
                for under, level in zip(levels, levels[1:]):
                    k //= FAN
                    low = min(under[k * FAN : k * FAN + FAN])
                    if level[k] == low:
                        break
                    level[k] = low
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(out)


class _Pieces(dict):
    """Piece to the bytes of its ids (4 each); a missing piece is merged and, within the bounds, kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.longest, self.room = ranks, max(map(len, ranks), default=1), CACHE_BYTES

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks, self.longest)).tobytes()
        if len(piece) <= CACHE_PIECE_CHARS:
            self.room -= 180 + len(piece) + len(ids)
            if self.room < 0:
                self.clear()
                self.room = CACHE_BYTES
            self[piece] = ids
        return ids


def encode(df: DataFrame, vocab_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with an ``array<int>`` column of token ids; each match of ``pattern`` is merged by itself."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocab_path))
    kept = [c for c in df.columns if c != ids]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(ranks.value)
        return released(_encoded(batches, pieces, pattern, kept, text, ids, 1024), pieces)

    return df.mapInArrow(task, _with(df, kept, _ids_field(ids)))


def _with(df: DataFrame, kept: list[str], *fields: T.StructField) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in kept), *fields])


def _ids_field(ids: str) -> T.StructField:
    return T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)


def _encoded(batches: Iterator[pa.RecordBatch], pieces: _Pieces, pattern: str, kept: list[str], text: str, ids: str, most: int) -> Iterator[pa.RecordBatch]:
    """The columns ``kept`` and the ids, in batches of ``most`` rows at most."""
    import regex

    split = regex.compile(pattern).findall
    for batch in slices(batches, most):
        rows = [np.frombuffer(b"".join(map(pieces.__getitem__, split(t))), np.int32) if t else np.empty(0, np.int32) for t in batch.column(text).to_pylist()]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
        for lo, hi in _slices(ends):
            flat = np.concatenate(rows[lo:hi]) if hi > lo else np.empty(0, np.int32)
            made = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), made], names=[*kept, ids])


def _slices(ends: np.ndarray, most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges whose elements fit 32-bit offsets."""
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids in a binary column; an id outside the vocabulary fails the job."""
    tokens = df.sparkSession.sparkContext.broadcast({i: t for t, i in load_ranks(vocab_path).items()})
    kept = [c for c in df.columns if c != out]
    return df.mapInArrow(lambda batches: released(_decoded(batches, tokens.value, kept, ids, out, 1024)), _with(df, kept, T.StructField(out, T.BinaryType(), False)))


def _decoded(batches: Iterator[pa.RecordBatch], tokens: dict[int, bytes], kept: list[str], ids: str, out: str, most: int) -> Iterator[pa.RecordBatch]:
    """The columns ``kept`` and the bytes of the ids, in batches of ``most`` rows at most."""
    get = tokens.__getitem__
    for batch in slices(batches, most):
        column = batch.column(ids)
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        made = [b"" if v is False else b"".join(map(get, flat[a:b].tolist())) for a, b, v in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.binary())], names=[*kept, out])


#: Rows of the Arrow batches that :func:`round_trip` makes.
TRIP_ROWS = 256


def round_trip(df: DataFrame, vocab_path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """:func:`decode` of :func:`encode`, in one Python worker a task in place of two, over small batches."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocab_path))
    kept = [c for c in df.columns if c not in (ids, out)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(ranks.value)
        tokens = {i: t for t, i in ranks.value.items()}
        return released(_decoded(_encoded(batches, pieces, pattern, kept, text, ids, TRIP_ROWS), tokens, [*kept, ids], ids, out, TRIP_ROWS), pieces)

    return df.mapInArrow(task, _with(df, kept, _ids_field(ids), T.StructField(out, T.BinaryType(), False)))


def digests(df: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = encode(df.select("doc_id", "text"), vocab_path, pattern).select("doc_id", "ids")
    both = decode(coded, vocab_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
