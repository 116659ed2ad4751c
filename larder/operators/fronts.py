"""Choosing among many objectives without weights, or by outranking: Pareto fronts, TOPSIS, PROMETHEE.

All take a table and objectives and add columns.  No step compares all rows with all others:

* Pareto: rows with equal objectives are one point, however many there are.  Each task leaves of its points those that none of its others dominates.  The points
  that are left are sorted into blocks along the sum of their objectives, of which each has its corners; a block is compared with another only if the
  other's best corner dominates its worst one, so most pairs of blocks are ruled out by a few numbers.  Blocks hold BLOCK points at most.
* TOPSIS: two aggregations, one row each.
* PROMETHEE: a row's net flow needs how many rows are better and worse in each objective: its place among the sorted values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship, written
from .order import MOST_BROADCAST, numbered
from .ranking import Objective, objective_value

BLOCK = 4096


def _live(objectives: tuple[Objective, ...]) -> list[Objective]:
    return [o for o in objectives if o.enabled]


def _values(df: DataFrame, objectives: list[Objective]) -> list:
    """Each objective's value, larger always being better."""
    return [(-objective_value(df, o) if o.direction == "minimize" else objective_value(df, o)) for o in objectives]


def front_of(x: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """Which rows of x no row of ``against`` (of x itself, if it isn't given) dominates: is as good in all columns and better in one."""
    alone = against is None
    if alone:
        order = np.lexsort((*-x.T[::-1], -x.sum(axis=1)))  # a row is dominated by ones with a larger sum only, or with the same after rounding
        x = x[order]
        kept = np.empty((0, x.shape[1]))
        good = np.zeros(len(x), bool)
        for at in range(0, len(x), 256):
            some = x[at : at + 256]
            own = front_of(some, kept) if len(kept) else np.ones(len(some), bool)
            left = some[own]
            inner = ~((left[None] >= left[:, None]).all(axis=2) & (left[None] > left[:, None]).any(axis=2)).any(axis=1)
            own[np.flatnonzero(own)[~inner]] = False
            good[at : at + 256] = own
            kept = np.concatenate([kept, some[own]])
        out = np.zeros(len(x), bool)
        out[order[good]] = True
        return out
    good = np.ones(len(x), bool)
    for at in range(0, len(against), 1024):
        other = against[at : at + 1024]
        for low in range(0, len(x), 256):
            mine = x[low : low + 256]
            good[low : low + 256] &= ~((other[None] >= mine[:, None]).all(axis=2) & (other[None] > mine[:, None]).any(axis=2)).any(axis=1)
    return good


def pareto_front(df: DataFrame, objectives: tuple[Objective, ...]) -> DataFrame:
    """The rows of ``df`` that no other row dominates; equal rows stay together. Without objectives all rows stay."""
    live = _live(objectives)
    if not live:
        return df
    dim, names = len(live), [f"__o{k}" for k in range(len(live))]
    ship(df.sparkSession)
    rows = df.withColumns({c: v.cast("double") for c, v in zip(names, _values(df, live), strict=True)})
    points = rows.select(*names).distinct().select(F.array(*names).alias("__x"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("__x").flatten(), float).reshape(-1, dim)
            yield batch.filter(pa.array(front_of(x)))

    left = written(points.mapInArrow(local, points.schema), "local-fronts")
    total = F.aggregate("__x", F.lit(0.0), lambda s, v: s + v)
    order = [F.desc("__sum"), *(F.desc(F.col("__x")[k]) for k in range(dim))]
    placed = written(numbered(left.withColumn("__sum", total), order, out="__at", first=0).withColumn("__block", (F.col("__at") / BLOCK).cast("long")), "placed")
    corners = placed.groupBy("__block").agg(F.array(*(F.max(F.col("__x")[k]) for k in range(dim))).alias("best"), F.array(*(F.min(F.col("__x")[k]) for k in range(dim))).alias("worst"))
    one, two = corners.select(F.col("__block").alias("own"), "worst"), corners.select(F.col("__block").alias("other"), "best")
    # a block's points are dominated by points before them only, which lie in its own block or in ones before
    may = one.join(two, F.col("other") <= F.col("own")).where(F.forall(F.arrays_zip("best", "worst"), lambda z: z["best"] >= z["worst"])).select("own", "other")
    packed = placed.groupBy("__block").agg(F.flatten(F.collect_list("__x")).alias("x"), F.collect_list("__at").alias("at"))  # BLOCK points

    def beaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, other = (np.asarray(batch.column(c)[k].values, float).reshape(-1, dim) for c in ("x", "y"))
                bad = ~(front_of(x) if batch.column("own")[k].equals(batch.column("other")[k]) else front_of(x, other))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column("at")[k].values, np.int64)[bad])], names=["__at"])

    pairs = may.join(packed.withColumnRenamed("__block", "own"), "own").join(packed.select(F.col("__block").alias("other"), F.col("x").alias("y")), "other").select("own", "other", "x", "y", "at")
    lost = pairs.mapInArrow(beaten, "__at long").distinct()
    front = written(placed.join(lost, "__at", "left_anti").select(*(F.col("__x")[k].alias(c) for k, c in enumerate(names))), "front")
    return rows.join(F.broadcast(front) if front.count() <= MOST_BROADCAST else front, names, "left_semi").select(*df.columns)


def topsis(df: DataFrame, objectives: tuple[Objective, ...]) -> DataFrame:
    """``df`` with final_score: the distance from the worst point over the sum of the distances from the worst and the best one, of weighted columns of length 1."""
    live = _live(objectives)
    if not live:
        return df.withColumn("final_score", F.lit(0.0))
    names = [f"__o{k}" for k in range(len(live))]
    scored = df.withColumns(dict(zip(names, _values(df, live), strict=True)))
    stats = scored.agg(*(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"{c}l") for c in names), *(F.max(c).alias(f"{c}h") for c in names), *(F.min(c).alias(f"{c}w") for c in names))  # one row
    told = scored.join(F.broadcast(stats))
    far = lambda end: F.sqrt(sum((F.pow(F.when(F.col(f"{c}l") > 0, (F.col(c) - F.col(f"{c}{end}")) / F.col(f"{c}l") * float(o.weight)).otherwise(0.0), 2) for c, o in zip(names, live, strict=True)), F.lit(0.0)))
    best, worst = far("h"), far("w")
    return told.withColumn("final_score", F.when(best + worst > 0, worst / (best + worst)).otherwise(0.0)).select(*df.columns, "final_score")


def promethee(df: DataFrame, objectives: tuple[Objective, ...], key: str = "row_id") -> DataFrame:
    """``df`` with final_score, the net flow: for each objective, by its share of the weights, the part of the other rows that are worse less that of those that are better."""
    live = _live(objectives)
    total = sum(float(o.weight) for o in live)
    out, names = df, [f"__o{k}" for k in range(len(live))]
    n = df.agg((F.count("*") - 1).alias("__others"))  # one row
    flow = F.lit(0.0)
    scored = df.withColumns(dict(zip(names, _values(df, live), strict=True)))
    out = scored
    for c, o in zip(names, live, strict=True):
        # rows before a value and rows up to it: sums over the sorted distinct values, whose places come from the sorted rows
        at = numbered(scored.select(c), [F.asc(c)], out="__at")
        place = at.groupBy(c).agg((F.min("__at") - 1).alias(f"{c}b"), F.max("__at").alias(f"{c}e"))
        out = out.join(place, c)
        flow = flow + F.lit(float(o.weight) / total if total else 0.0) * (F.col(f"{c}b") - (F.col("__others") + 1 - F.col(f"{c}e")))
    out = out.join(F.broadcast(n))
    return out.withColumn("final_score", F.when(F.col("__others") > 0, flow / F.col("__others")).otherwise(0.0)).select(*df.columns, "final_score")
