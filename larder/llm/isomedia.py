"""ISO media containers as columns.

Method: walk the nested boxes of a file, decode the sample tables of each track (stsd, stts, stss, stsc, stsz, stco/co64) and
store codec, duration and the byte ranges of keyframes, without decoding payloads.  A writer makes such files of raw
8-bit samples, in frames of 576, so that any bytes can be stored losslessly.

Defined cases: null text is an empty payload, which is one frame of padding; empty and truncated or foreign files give no
tracks and an error text instead of a failed job; repeated rows give equal files; an empty table gives an empty table; extra columns are kept.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, written

FRAME = 576
RATE = 8000
#: Frames in a chunk, and from one sync frame to the next, in written files.
CHUNK, SYNC = 64, 16
#: Boxes that hold only boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf", b"dinf"}

TRACK = "struct<track_id:int,handler:string,codec:string,timescale:int,duration:bigint,n_samples:bigint,chunks:array<struct<at:bigint,bytes:bigint>>,keyframes:array<struct<at:bigint,bytes:bigint>>>"


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of a frame."""
    return data + b"\xff" * (-len(data) % FRAME if data else FRAME)


def pack(payload: bytes) -> bytes:
    """A file with one sound track of raw unsigned 8-bit samples; the payload is whole frames."""
    n = len(payload) // FRAME
    ends = np.arange(0, n, CHUNK, dtype=np.int64)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, min(n, CHUNK), 1)] + ([(len(ends), n - int(ends[-1]), 1)] if len(ends) > 1 and n % CHUNK else [])
    sync = np.arange(1, n + 1, SYNC, dtype=np.int64)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        at = first + ends * FRAME
        big = first + len(payload) > 0xFFFFFFFF
        offsets = _full(b"co64" if big else b"stco", struct.pack(">I", len(at)), at.astype(">u8" if big else ">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, FRAME)),
            _full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            offsets,
        )
        minf = _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1"))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * FRAME, 0x55C4, 0)), _full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"raw\0"), minf)
        tkhd = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, n * FRAME), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, b"\0" * 8)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n * FRAME, 0x10000, 0x100), b"\0" * 10, matrix, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    big = len(payload) + 16 > 0xFFFFFFFF
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if big else struct.pack(">I4s", 8 + len(payload), b"mdat")
    first = len(ftyp) + len(moov(0)) + len(head)
    return ftyp + moov(first) + head + payload


def walk(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the body of every box at one level."""
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        start = lo + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, start)
            start += 8
        elif size == 0:
            size = hi - lo
        if size < start - lo or lo + size > hi:
            raise ValueError(f"box {kind!r} at {lo} doesn't fit")
        yield kind, start, lo + size
        lo += size


def _tables(data: bytes, lo: int, hi: int, found: dict[bytes, tuple[int, int]]) -> None:
    for kind, a, b in walk(data, lo, hi):
        if kind in CONTAINERS:
            _tables(data, a, b, found)
        else:
            found.setdefault(kind, (a, b))


def _column(data: bytes, at: tuple[int, int] | None, dtype: str, width: int = 1, skip: int = 4) -> np.ndarray:
    """The entries of a table that follow its count."""
    if at is None:
        return np.empty((0, width), np.int64)
    (n,) = struct.unpack_from(">I", data, at[0] + skip)
    if at[0] + skip + 4 + n * width * np.dtype(dtype).itemsize > at[1]:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, dtype, n * width, at[0] + skip + 4).astype(np.int64).reshape(n, width)


def _clock(data: bytes, at: tuple[int, int]) -> tuple[int, int]:
    return struct.unpack_from(">IQ", data, at[0] + 20) if data[at[0]] == 1 else struct.unpack_from(">II", data, at[0] + 12)


def sample_ranges(data: bytes, t: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of every sample, and of every chunk, from the sample tables."""
    fixed, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
    size = np.full(n, fixed, np.int64) if fixed else _column(data, t[b"stsz"], ">u4", 1, 8)[:, 0]
    chunks = _column(data, t[b"co64"], ">u8")[:, 0] if b"co64" in t else _column(data, t.get(b"stco"), ">u4")[:, 0]
    runs = _column(data, t.get(b"stsc"), ">u4", 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks)))) if len(runs) else np.zeros(0, np.int64)
    if per.sum() != n:
        raise ValueError("chunks and sizes disagree on the samples")
    before = np.cumsum(size) - size
    first = np.cumsum(per) - per
    at = before - np.repeat(before[first[per > 0]], per[per > 0]) + np.repeat(chunks, per)
    total = np.add.reduceat(size, first[per > 0]) if n else np.zeros(0, np.int64)
    if n and (at + size).max() > len(data):
        raise ValueError("samples lie beyond the end")
    return at, size, chunks[per > 0], total


def tracks(data: bytes | None) -> list[dict]:
    """What the file says of its tracks; keyframes are all samples where no sync table is given."""
    out = []
    for kind, a, b in walk(data or b"", 0, len(data or b"")):
        if kind != b"moov":
            continue
        for trak, lo, hi in walk(data, a, b):
            if trak != b"trak":
                continue
            t: dict[bytes, tuple[int, int]] = {}
            _tables(data, lo, hi, t)
            at, size, chunk, total = sample_ranges(data, t)
            sync = _column(data, t[b"stss"], ">u4")[:, 0] - 1 if b"stss" in t else np.arange(len(at))
            stts = _column(data, t.get(b"stts"), ">u4", 2)
            scale, _ = _clock(data, t[b"mdhd"])
            out.append(
                {
                    "track_id": struct.unpack_from(">I", data, t[b"tkhd"][0] + (20 if data[t[b"tkhd"][0]] == 1 else 12))[0],
                    "handler": data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12].decode("latin-1"),
                    "codec": data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1"),
                    "timescale": scale,
                    "duration": int((stts[:, 0] * stts[:, 1]).sum()),
                    "n_samples": len(at),
                    "chunks": [{"at": x, "bytes": y} for x, y in zip(chunk.tolist(), total.tolist(), strict=True)],
                    "keyframes": [{"at": x, "bytes": y} for x, y in zip(at[sync].tolist(), size[sync].tolist(), strict=True)],
                }
            )
    return out


def to_media(payload: Column) -> Column:
    """A media file of each payload, padded to whole frames."""

    @F.pandas_udf("binary")
    def make(payload: pd.Series) -> pd.Series:
        return payload.map(lambda x: pack(pad(bytes(x or b""))))

    return make(payload)


def _index(media: pd.Series) -> pd.DataFrame:
    """The tracks of each file, or why it can't be read."""

    def one(x: bytes | None) -> tuple[list | None, str | None]:
        try:
            return tracks(x), None
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return None, f"{type(e).__name__}: {e}"

    return pd.DataFrame([one(x) for x in media], columns=["tracks", "error"])


def with_index(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with the columns ``tracks`` and ``error``."""
    kept = [c for c in df.columns if c not in ("tracks", "error")]
    index = F.pandas_udf(_index, f"struct<tracks:array<{TRACK}>,error:string>")
    return df.select(*map(col, kept), index(col(media)).alias("__told")).select(*map(col, kept), "__told.tracks", "__told.error")


def read_payload(media: str, chunks: Column) -> Column:
    """The bytes of a track's chunks, cut from the file by their ranges."""

    @F.pandas_udf("binary")
    def cut(media: pd.Series, at: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([b"".join(m[a : a + n] for a, n in zip(x, y, strict=True)) if x is not None else None for m, x, y in zip(media, at, size, strict=True)], dtype=object)

    return cut(col(media), chunks["at"], chunks["bytes"])


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Store every document as a media file, read the files back and tell their features."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    stored = written(docs.select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), to_media(data).alias("media")), "media")
    told = with_index(stored).withColumn("track", F.element_at("tracks", 1)).withColumn("payload", read_payload("media", F.col("track.chunks")))
    keys = F.col("track.keyframes")
    last = F.element_at(keys, -1)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), F.trim("track.codec")),
        F.concat(F.lit("timescale="), F.col("track.timescale")),
        F.concat(F.lit("duration="), F.col("track.duration")),
        F.concat(F.lit("samples="), F.col("track.n_samples")),
        F.concat(F.lit("keyframes="), F.size(keys)),
        F.concat(F.lit("first="), F.element_at(keys, 1)["at"], F.lit("+"), F.element_at(keys, 1)["bytes"]),
        F.concat(F.lit("last="), last["at"], F.lit("+"), last["bytes"]),
    )
    return told.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
