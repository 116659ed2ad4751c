"""Shared helpers: the shared folder and written intermediate tables (of the core), shipping, column-name hygiene, lookups."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import forget, scratch, ship, shared_folder, written

__all__ = ["forget", "scratch", "ship", "shared_folder", "written"]


#: How a table of hashes is written: they don't repeat, so that a dictionary or a high level is work for nothing.
HASHES_ONLY = {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of few rows: what Python holds of long texts at a time stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of few rows, and of 16 MB at most, for what is executed inside: where rows hold large binaries."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def hashable(df: DataFrame) -> list[str]:
    """Names of the columns that xxhash64 takes (maps have no hash)."""

    def has_map(kind: T.DataType) -> bool:
        if isinstance(kind, T.MapType):
            return True
        if isinstance(kind, T.ArrayType):
            return has_map(kind.elementType)
        return isinstance(kind, T.StructType) and any(has_map(f.dataType) for f in kind.fields)

    return [f.name for f in df.schema.fields if not has_map(f.dataType) and type(f.dataType).__name__ != "VariantType"]


def col(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8_bytes(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: A table of numbers and digests is broadcast up to this many bytes, which are counted first; beyond it the join shuffles.
BROADCAST_BYTES = 12 << 20
#: A key is hot if it has more than this part of all rows that a lookup joins: there are at most so many of them.
HOT_KEYS = 10_000


def _width(kind: T.DataType) -> int:
    return sum(_width(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 8 if isinstance(kind, T.NumericType) else 40


def small(table: DataFrame, extra: int = 0) -> DataFrame:
    """``table`` (a written table of numbers and digests), marked for broadcast if its size allows; extra: bytes of its arrays."""
    return F.broadcast(table) if table.count() * _width(table.schema) + extra <= BROADCAST_BYTES else table


def ends_of(pairs: DataFrame) -> DataFrame:
    """The distinct ids of a written table of pairs, as a written table."""
    return written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")


def lookup(df: DataFrame, table: DataFrame, key: str, spread, weight: str) -> DataFrame:
    """``df`` left-joined with ``table`` (one row for each key; ``weight``: how many rows of ``df`` have it; it isn't kept).

    A small table is broadcast.  Else hot keys are, HOT_KEYS of them at most, and their rows are dealt by ``spread`` in the shuffle that the others need.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    if table.count() * _width(table.schema) <= BROADCAST_BYTES:
        return df.join(F.broadcast(table.select(key, *values)), key, "left").select(*map(col, df.columns), *values)
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_KEYS > F.lit(total)
    hot = table.where(is_hot).select(key, F.struct(*values).alias("__hot"))
    cold = table.where(~is_hot).select(key, F.struct(*values).alias("__cold"), F.lit(0).alias("__salt"))
    dealt = df.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).cast("int"))
    told = dealt.join(cold, [key, "__salt"], "left").withColumn("__told", F.coalesce("__hot", "__cold"))
    return told.select(*(col(c) for c in df.columns), *(F.col(f"__told.{v}").alias(v) for v in values))


def released(batches, holds=None):
    """``batches``, and when they end (or the task is stopped) what the worker held for them goes back to the system."""
    try:
        yield from batches
    finally:
        if holds is not None:
            holds.clear()
        _trim()


def _trim() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)
