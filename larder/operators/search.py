"""Vector top-k: exact, cell-pruned (IVF) and batched, with query processing and late materialisation of item columns.

A search is a table scan with a bounded heap in each task (TakeOrderedAndProject); wide item columns join after the top-k.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V

#: metric -> (score of two vectors, whether larger is better)
METRICS: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {"ip": (V.dot, True), "l2": (V.squared_l2, False)}


@dataclass(frozen=True)
class QuerySteps:
    """Query text processing: strip, lower case, optional punctuation removal, truncation, then further steps."""

    strip_punctuation: bool = False
    most_chars: int = 512
    extra: tuple[Callable[[Column], Column], ...] = ()

    def then(self, step: Callable[[Column], Column]) -> QuerySteps:
        return replace(self, extra=(*self.extra, step))

    def apply(self, text: Column) -> Column:
        """The processed text; where nothing is left the stripped raw text, or ``unknown``."""
        out = F.lower(F.trim(text))
        if self.strip_punctuation:
            out = F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9\\s]", " "), "\\s+", " "))
        out = F.substring(out, 1, self.most_chars)
        for step in self.extra:
            out = step(out)
        raw = F.trim(text)
        return F.when(F.coalesce(out, F.lit("")) != "", out).when(F.coalesce(raw, F.lit("")) != "", raw).otherwise("unknown")


class VectorCache:
    """Query vectors by the SHA-256 of the processed query; the oldest entry goes first. Lookups don't refresh an entry."""

    def __init__(self, most: int = 1000):
        self.most, self._held = most, {}

    @staticmethod
    def key(query: str) -> str:
        return hashlib.sha256(query.encode()).hexdigest()

    def get(self, query: str) -> Sequence[float] | None:
        return self._held.get(self.key(query))

    def set(self, query: str, vector: Sequence[float]) -> None:
        self._held.pop(self.key(query), None)
        self._held[self.key(query)] = vector
        while len(self._held) > self.most:
            self._held.pop(next(iter(self._held)))


def unit(vector: Sequence[float]) -> list[float]:
    """The query over its length, unless it is nearly zero."""
    length = sum(float(x) * float(x) for x in vector) ** 0.5
    return [float(x) / length for x in vector] if length > 1e-9 else [float(x) for x in vector]


def _order(score: str, larger: bool, key: str) -> list[Column]:
    return [F.desc(score) if larger else F.asc(score), F.asc(key)]


def search(items: DataFrame, query: Sequence[float] | Column, k: int, metric: str = "ip", threshold: float | None = None, key: str = "row_id", vector: str = "embedding", normalise: bool = False) -> DataFrame:
    """key, score, rank of the k best rows.

    The threshold applies after ranking, so ranks may have gaps and fewer than k rows may come back.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    score, larger = METRICS[metric]
    own = V.normalise(F.col(vector)) if normalise else F.col(vector)
    other = query if isinstance(query, Column) else V.vector(unit(query) if normalise else query)
    top = items.where(F.col(vector).isNotNull()).select(key, score(own, other).alias("score")).orderBy(*_order("score", larger, key)).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*_order("score", larger, key))))  # k rows at most
    if threshold is not None:
        ranked = ranked.where(F.col("score") >= threshold if larger else F.col("score") <= threshold)
    return ranked


def attach(top: DataFrame, items: DataFrame, key: str = "row_id") -> DataFrame:
    """The items' columns for the rows of a top-k, which has k rows at most: it is broadcast to find its items, and they are broadcast to it.

    The items are scanned once and not shuffled.  Rows without an item keep nulls; items that share a key are one each.
    """
    found = items.join(F.broadcast(top.select(key).distinct()), key, "left_semi")
    return top.join(F.broadcast(found), key, "left")


def search_near(items: DataFrame, query_id: int, k: int, metric: str = "ip", threshold: float | None = None, key: str = "row_id", vector: str = "embedding") -> DataFrame:
    """Search by the vector of one of the items."""
    row = items.where(F.col(key) == query_id).select(vector).first()
    return search(items, [float(x) for x in row[0]], k, metric, threshold, key, vector)


#: Queries of a block, and items of a part, about: a task scores one block against one part.
BLOCK, PART = 4096, 8192


def batch_search(items: DataFrame, queries: DataFrame, k: int, metric: str = "ip", key: str = "row_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """query_key, key, score, rank of the k best rows for each query, independently, for any number of queries.

    Queries are dealt into blocks and items into parts; each pair of both is scored by itself and keeps k rows a query, which
    are then merged.  Vectors that are null or hold a null, and items of another length than the query, have no score and are left out.
    """
    own, asked = whole(items.select(key, vector), vector), whole(queries.select(query_key, vector), vector)
    n = own.count()
    parts, blocks = max(-(-n // PART), min(64, -(-n // 64)), 1), max(-(-asked.count() // BLOCK), 1)
    deal = lambda df, by, to, every: df.select(
        F.pmod(F.xxhash64(by, vector), F.lit(to)).alias("__own"), F.explode(F.sequence(F.lit(0), F.lit(every - 1))).alias("__other"), F.size(vector).alias("__dim"), F.col(by).alias("key"), F.col(vector).cast("array<double>").alias("v")
    )
    left = deal(own, key, parts, blocks).withColumnsRenamed({"__own": "part", "__other": "block", "__dim": "dim"}).withColumn("part", F.col("part").cast("int"))
    right = deal(asked, query_key, blocks, parts).withColumnsRenamed({"__own": "block", "__other": "part", "__dim": "dim"}).withColumn("block", F.col("block").cast("int"))
    return best_of_parts(left, right, ["block", "part", "dim"], k, metric, (key, items.schema[key].dataType), (query_key, queries.schema[query_key].dataType))


def whole(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there and holds no null."""
    return df.where(F.col(vector).isNotNull() & ~F.exists(vector, F.isnull))


def best_of_parts(left: DataFrame, right: DataFrame, by: list[str], k: int, metric: str, key: tuple[str, T.DataType], query_key: tuple[str, T.DataType]) -> DataFrame:
    """query_key, key, score, rank of the k best of ``left`` for each query of ``right`` (columns key, v, and ``by``, which pairs their parts)."""
    _, larger = METRICS[metric]
    (key, key_type), (query_key, query_type) = key, query_key

    def best(group, against):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # by key, so that of equal scores the first has the least key
        group = group.take(pc.sort_indices(group, sort_keys=[("key", "ascending")], null_placement="at_start"))
        rows = lambda t: np.asarray(t["v"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        at, of, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if group.num_rows and against.num_rows:
            x, y = np.ascontiguousarray(rows(group).T), rows(against)
            for lo in range(0, len(y), 64):
                some = y[lo : lo + 64]
                score = np.zeros((len(some), x.shape[1]))
                for d in range(x.shape[0]):  # in order, so that equal vectors have equal scores
                    score += some[:, d : d + 1] * x[d] if larger else (x[d] - some[:, d : d + 1]) ** 2
                order = np.where(np.isnan(score), -np.inf, -score) if larger else np.where(np.isnan(score), np.inf, score)
                last = np.partition(order, k - 1, axis=1)[:, k - 1] if k < order.shape[1] else np.full(len(some), np.inf)
                for i in range(len(some)):
                    near = np.flatnonzero(order[i] <= last[i])
                    near = near[np.argsort(order[i, near], kind="stable")[:k]]
                    at.append(near)
                    of.append(np.full(len(near), lo + i))
                    scores.append(score[i, near])
        return pa.table({query_key: against["key"].take(pa.array(np.concatenate(of))), key: group["key"].take(pa.array(np.concatenate(at))), "score": np.concatenate(scores)})

    schema = T.StructType([T.StructField(query_key, query_type), T.StructField(key, key_type), T.StructField("score", T.DoubleType())])
    scored = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, schema)
    w = Window.partitionBy(query_key).orderBy(*_order("score", larger, key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass
class Index:
    """An index is a table: flat, or with a cell for each row and the centres of the cells."""

    table: DataFrame
    kind: str
    metric: str
    centres: list[list[float]] | None = None
    key: str = "row_id"
    vector: str = "embedding"

    def search(self, query: Sequence[float], k: int, nprobe: int = 1, threshold: float | None = None) -> DataFrame:
        table = self.table
        if self.centres is not None:
            far = lambda c: sum((a - float(b)) ** 2 for a, b in zip(c, query, strict=True))
            cells = sorted(range(len(self.centres)), key=lambda i: far(self.centres[i]))[:nprobe]
            table = table.where(F.col("cell_id").isin(cells))  # prunes partitions of a stored index
        return search(table, query, k, self.metric, threshold, self.key, self.vector)

    def save(self, path: str) -> None:
        writer = self.table.write.mode("overwrite")
        (writer.partitionBy("cell_id") if self.centres is not None else writer).parquet(path)


#: kind -> function (items, key, vector, metric, options) -> Index
BUILDERS: dict[str, Callable[..., Index]] = {}


def register_builder(kind: str, build: Callable[..., Index]) -> None:
    BUILDERS[kind] = build


def build_index(items: DataFrame, kind: str = "flat_ip", key: str = "row_id", vector: str = "embedding", normalise: bool = False, **options) -> Index:
    """An index of ``items``; ``normalise`` stores unit vectors."""
    if kind not in BUILDERS:
        raise ValueError(f"unknown index kind {kind!r}; known: {sorted(BUILDERS)}")
    if items.select(vector).limit(1).isEmpty():
        raise ValueError("no vectors to index")
    items = items.withColumn(vector, V.normalise(F.col(vector))) if normalise else items
    return BUILDERS[kind](items, key=key, vector=vector, **options)


def _ivf(items: DataFrame, key: str, vector: str, nlist: int = 16, metric: str = "l2", seed: int = 1, least_per_cell: int = 39, **_) -> Index:
    """Cells by k-means; with fewer than 39 rows a cell, the exact L2 index."""
    if items.count() < least_per_cell * nlist:
        return Index(items, "flat_l2", "l2", key=key, vector=vector)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=nlist, seed=seed, featuresCol="__v", predictionCol="cell_id").fit(items.select(array_to_vector(V.doubles(F.col(vector))).alias("__v")))
    told = model.transform(items.withColumn("__v", array_to_vector(V.doubles(F.col(vector))))).drop("__v")
    return Index(told, "ivf", metric, [c.tolist() for c in model.clusterCenters()], key, vector)


register_builder("flat_ip", lambda items, key, vector, **_: Index(items, "flat_ip", "ip", key=key, vector=vector))
register_builder("flat_l2", lambda items, key, vector, **_: Index(items, "flat_l2", "l2", key=key, vector=vector))
register_builder("ivf", _ivf)
# a graph index has no table form: exact search answers it with full recall
register_builder("hnsw", lambda items, key, vector, **_: Index(items, "flat_l2", "l2", key=key, vector=vector))


def index_bytes(rows: int, dim: int) -> int:
    return rows * dim * 4


#: strategy -> function (index, query, k) -> top-k. ``hybrid`` falls back to exact search.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "exact": lambda index, query, k, **o: search(index.table, query, k, index.metric, key=index.key, vector=index.vector, **o),
    "approximate": lambda index, query, k, **o: index.search(query, k, **o),
    "hybrid": lambda index, query, k, **o: search(index.table, query, k, index.metric, key=index.key, vector=index.vector, **o),
}


def register_strategy(name: str, strategy: Callable[..., DataFrame]) -> None:
    if not callable(strategy):
        raise TypeError("a strategy is a function of index, query and k")
    STRATEGIES[name] = strategy
