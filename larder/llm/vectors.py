"""Embedding near-duplicates by collision-counting projections.

Method: all vectors are projected on random orthonormal directions.  In each of COUNTED directions a set of vectors is sorted, and
a window centred on a query holds the vectors that collide with it; the collisions of a pair are counted, and pairs that pass a
count calibrated to the wanted recall are verified by their cosine in double precision.

In d dimensions a window that keeps nine of ten pairs at a cosine of 0.9 holds about half of all vectors in each direction, whatever d is, so
that windows over the whole table would give a number of collisions that grows with its square.  So windows are taken
within cells: a tree of k directions cuts the table at their medians into 2^k cells, and a vector is in one cell of each tree.  k grows with the
logarithm of the number of vectors, and so many trees are grown that a pair at the threshold meets in one with the wanted recall, which
is told from the measured spread of the vectors.  For a spread in all directions the work grows with about the 1.2th power of the table (k one higher
takes 1.17 times the trees).  A cell of any size is split into blocks, which are paired, so no task holds a cell.  A pair that meets in several
trees counts in the first only.

Equal vectors are one node with a number of copies.  What leaves a task are sums for each vector and the edges of a
spanning forest, not pairs, so that a large group of near copies gives few rows.

Recall: RECALL for each of the two calibrations at the threshold itself, more for closer pairs; measured in tests against brute force.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths
don't link; a pair at the threshold itself (a tie) links; rows with a null id take no part (0 links, null component, not kept); repeated rows are vectors each;
vectors of any length are compared whole; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph
from .common import col, lookup, scratch, slices, written

RECALL = 0.98
#: Directions in which collisions are counted, and the part of pairs at the threshold that collide in one.
COUNTED, COLLIDE = 16, 0.9
#: Vectors of a cell and of a block that are aimed at (less than 2^16 in a block), and queries counted at a time.
CELL, BLOCK, TILE = 4096, 4096, 128
SEED = 11


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def plan(n: int, cosine: float, spread: float = 1.0) -> tuple[int, int]:
    """Cuts in a tree, and trees, for n vectors. spread: their variance over all directions (1: unit vectors about the origin)."""
    cuts = int(math.log2(n / CELL)) if n > CELL else 0
    # the odds that a cut doesn't part a pair at the threshold, from the pair's correlation in a direction
    stays = 1 - math.acos(max(-1.0, 1 - (1 - cosine) / max(spread, 1e-9))) / math.pi
    meet = stays**cuts
    return cuts, 1 if meet >= RECALL else min(1024, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))


def least_collisions() -> int:
    """The largest count that pairs at the threshold reach with the wanted recall."""
    tail = 0.0
    for c in range(COUNTED, -1, -1):
        tail += math.comb(COUNTED, c) * COLLIDE**c * (1 - COLLIDE) ** (COUNTED - c)
        if tail >= RECALL:
            return c
    return 0


def directions(dim: int, count: int) -> np.ndarray:
    """dim x count: random rotations, as many as it takes, cut to size."""
    rng = np.random.default_rng([SEED, dim])
    made = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(made, axis=1)[:, :count]


def _units(column: list[bytes], dim: int, kind: str = "f8") -> np.ndarray:
    x = np.frombuffer(b"".join(column), kind).astype(np.float64).reshape(len(column), dim)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def collisions(p: np.ndarray, q: np.ndarray, window: float) -> Iterator[tuple[int, np.ndarray]]:
    """For TILE rows of p at a time: where they start, and in how many directions each row of q lies in their windows."""
    order = np.argsort(q, axis=0, kind="stable")
    rank, low, width = np.empty(q.shape[::-1], np.uint16), np.empty(p.shape[::-1], np.uint16), np.empty(p.shape[::-1], np.uint16)
    for k in range(q.shape[1]):
        rank[k, order[:, k]] = np.arange(len(q))
        along = q[order[:, k], k]
        start = np.searchsorted(along, p[:, k] - window, "left")
        low[k], width[k] = start, np.searchsorted(along, p[:, k] + window, "right") - start
    for at in range(0, len(p), TILE):
        count = np.zeros((min(TILE, len(p) - at), len(q)), np.uint8)
        for k in range(len(rank)):
            count += (rank[k] - low[k, at : at + TILE, None]) < width[k, at : at + TILE, None]
        yield at, count


def _links(q: np.ndarray, m: np.ndarray, pq: np.ndarray, pm: np.ndarray, window: float, least: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with enough collisions and a cosine of at least ``cosine``."""
    for at, count in collisions(pq, pm, window):
        i, j = np.nonzero(count >= least)
        own = q[at : at + TILE]
        if len(i) > count.size // 16:
            near = (own @ m.T)[i, j]
        else:
            near = np.concatenate([np.einsum("ij,ij->i", own[i[k : k + 16384]], m[j[k : k + 16384]]) for k in range(0, len(i), 16384)] or [np.empty(0)])
        ok = near >= cosine
        yield i[ok] + at, j[ok]


class _Forest:
    """Keeps the edges that join two parts."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.edges.append((x, y))


def near_duplicates(df: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, n_links, component_id, kept of every row."""
    with scratch("known"):
        return _near_duplicates(df, cosine, key, vector)


def _near_duplicates(df: DataFrame, cosine: float, key: str, vector: str) -> DataFrame:
    v = col(vector).cast("array<double>")
    fine = F.size(v) > 0
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("of", F.when(F.col("fine") & F.col("id").isNotNull(), F.md5(F.array_join(F.col("v").cast("array<string>"), ",").cast("binary"))))
    classes = written(rows.where("of is not null").groupBy("of").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    kind = "f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "f8"
    dims = {r[0]: r[1] for r in classes.groupBy(F.size("v").alias("dim")).count().collect()}  # a table of vectors has few lengths
    parts = [_in_dimension(classes.where(F.size("v") == d), d, n, cosine, kind) for d, n in sorted(dims.items()) if n > 1]
    known = classes.select("of", "rep", "copies")
    if parts:
        told = parts[0]
        for more in parts[1:]:
            told = told.unionByName(more)
        told = written(told, "links")
        weights = told.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
        found = graph.components(told.where("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
        known = known.join(weights, "rep", "left").join(found, "rep", "left")
    else:
        known = known.withColumns({"links": F.lit(0).cast("long"), "label": F.lit(None).cast("long")})
    known = known.select("of", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("label", "rep").alias("component"))
    out = lookup(rows.select("id", "of"), written(known, "known"), "of", F.col("id"), "copies")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").cast(df.schema[key].dataType).alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _in_dimension(classes: DataFrame, dim: int, n: int, cosine: float, kind: str) -> DataFrame:
    """Links within one length of vectors: a, b of forest edges; a, null and the copies linked with a. kind: of a stored component."""
    made = classes.select("rep", "copies", "v")

    def units(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
        raw = [np.array(x, kind).tobytes() for x in batch.column(2).to_pylist()]
        return raw, _units(raw, dim, kind)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for batch in slices(batches):
            total += units(batch)[1].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    # one row for each task comes to the driver
    centre = sum((np.frombuffer(r[0], np.float64) for r in made.mapInArrow(mean, "total binary").toLocalIterator()), np.zeros(dim)) / n if n > CELL else np.zeros(dim)
    cuts, trees = plan(n, cosine, float(1 - centre @ centre))
    axes = directions(dim, max(COUNTED, cuts * trees))
    window, least = _normal_quantile((1 + COLLIDE) / 2) * math.sqrt((2 - 2 * cosine) / dim), least_collisions()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(units(batch)[1] @ axes[:, : cuts * trees]), pa.list_(pa.float64()))], names=["p"])

    medians = np.empty(0)
    if cuts:
        medians = np.array(made.mapInArrow(project, "p array<double>").agg(*(F.percentile_approx(F.col("p")[i], 0.5, 1000) for i in range(cuts * trees))).first(), np.float64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = 1 << np.arange(cuts, dtype=np.int64)
        for batch in slices(batches):
            raw, x = units(batch)
            if not raw:
                continue
            cells = (((x @ axes[:, : cuts * trees]) > medians).reshape(len(x), trees, cuts) * bit).sum(axis=2)
            codes, row = pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(np.tile(np.arange(len(x)), trees))
            places = (np.arange(trees, dtype=np.int64) << 40)[:, None] | cells.T
            yield pa.RecordBatch.from_arrays([pa.array(places.ravel()), *(c.take(row) for c in (batch.column(0), batch.column(1), pa.array(raw, pa.binary()), codes))], names=["place", "rep", "copies", "raw", "cells"])

    dealt = made.mapInArrow(deal, "place long, rep long, copies long, raw binary, cells binary")
    sizes = written(dealt.groupBy("place").agg(F.count("*").alias("of")).where("of > 1"), "cells").select("place", F.ceil(F.col("of") / BLOCK).cast("int").alias("blocks"), "of")
    placed = lookup(dealt, sizes, "place", F.col("rep"), "of").where("blocks is not null")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("place", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "copies", "raw", "cells")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["place"].iat[0]) >> 40
        pdf = pdf.sort_values("rep")
        one = pdf["low"].iat[0] == pdf["high"].iat[0]
        q = pdf[pdf["own"] == pdf["high"]]
        m = q if one else pdf[pdf["own"] == pdf["low"]]
        out = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="float64"), "links": pd.Series(dtype="int64")})
        if not len(q) or not len(m):
            return out
        xq, xm = _units(list(q["raw"]), dim, kind), _units(list(m["raw"]), dim, kind)
        cq, cm = (np.frombuffer(b"".join(x["cells"]), np.int64).reshape(len(x), trees) for x in (q, m))
        rq, rm, wq, wm = (x[c].to_numpy(np.int64) for c in ("rep", "copies") for x in (q, m))
        forest, sum_q, sum_m = _Forest(), np.zeros(len(q), np.int64), np.zeros(len(m), np.int64)
        for i, j in _links(xq, xm, xq @ axes[:, :COUNTED], xm @ axes[:, :COUNTED], window, least, cosine):
            new = rq[i] > rm[j] if one else np.ones(len(i), bool)
            for e in range(tree):  # met in an earlier tree
                new &= cq[i, e] != cm[j, e]
            i, j = i[new], j[new]
            np.add.at(sum_q, i, wm[j])
            np.add.at(sum_m, j, wq[i])
            forest.add(rq[i], rm[j])
        ids, sums = np.concatenate([rq, rm]), np.concatenate([sum_q, sum_m])
        some = sums > 0
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([ids[some], edges[:, 0]]), "b": pd.array([None] * int(some.sum()) + edges[:, 1].tolist(), "Int64"), "links": np.concatenate([sums[some], np.zeros(len(edges), np.int64)])})

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("links", T.LongType())])
    return placed.groupBy("place", "low", "high").applyInPandas(count, schema)
