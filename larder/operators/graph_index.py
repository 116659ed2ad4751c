"""A graph index: each vector's list of near ones, made by NN-descent in join rounds and searched by a beam for a batch of queries.

Making: the first lists come from windows over sorted random projections.  In each round every vector compares the members of its list, and of
the lists that it is in, with each other (both are bounded, so a popular vector brings no more than others), and each keeps its nearest.  Pairs of members
that were both there in the round before were compared then; of the others only those come out that are nearer than the last of a list.
Rounds end when few lists change.  NN-descent with lists of ``degree`` stops at lists of which a half is wrong: while they are made they are longer, by a factor that
grows with the logarithm of the number of vectors, and ``degree`` of them are stored.

Search: each query keeps its ``width`` nearest vectors seen.  A round follows the lists of the ones not followed yet, for all queries at once: the
list table is joined on the ids that some query is at.  Queries that have nothing left to follow take no part in the next round.  The search is approximate; its recall is measured in
tests, and the exact strategies stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..sources.tables import drop_shuffles, forget, written
from .order import numbered
from .search import whole

#: Vectors that a search may begin with: a bounded sample.
ENTRIES = 256
#: Vectors of a window that the first lists come from.
WINDOW = 256


@dataclass
class GraphIndex:
    """A stored graph: id, v, near (ids, nearest first); and the vectors that searches begin with."""

    spark: SparkSession
    path: str
    key: str
    vector: str

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int, width: int = 64, query_key: str = "query_id") -> DataFrame:
        """query_key, key, score (squared distance), rank of about the k nearest for each query."""
        return _ranked(self.visit(queries, max(width, k), query_key)[0], k, query_key, self.key)

    def visit(self, queries: DataFrame, width: int, query_key: str = "query_id") -> tuple[DataFrame, DataFrame]:
        """The nearest ``width`` seen (q, id, d), and the number of vectors compared with each query (q, seen)."""
        asked = written(whole(queries, self.vector).select(F.col(query_key).alias("q"), F.col(self.vector).cast("array<double>").alias("qv")), "asked")
        entries = self.spark.read.parquet(f"{self.path}/entries").limit(ENTRIES)
        entries = entries.agg(F.collect_list(F.struct("id", "v")).alias("entries"))  # ENTRIES vectors
        begun = asked.join(F.broadcast(entries)).select("q", F.explode(F.slice(F.array_sort(F.transform("entries", lambda e: F.struct(V.squared_l2(F.col("qv"), e["v"]).alias("d"), e["id"].alias("id")))), 1, 8)).alias("e"))
        held = written(begun.select("q", "e.id", "e.d", F.lit(False).alias("done")), "held")
        seen = written(held.select("q", "id"), "seen")
        best = Window.partitionBy("q").orderBy("d", "id")
        while True:
            follow = held.where("not done").select("q", "id")
            steps = follow.join(self.lists.select("id", "near"), "id").select("q", F.explode("near").alias("id")).distinct()
            fresh = written(steps.join(seen, ["q", "id"], "left_anti"), "fresh")
            if fresh.isEmpty():
                break
            told = fresh.join(self.lists.select("id", "v"), "id").join(asked, "q").select("q", "id", V.squared_l2(F.col("qv"), F.col("v")).alias("d"), F.lit(False).alias("done"))
            both = held.withColumn("done", F.lit(True)).unionByName(told)
            kept = written(both.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= width).drop("nth"), "held")
            more = written(seen.unionByName(fresh), "seen")
            for old in (held, seen, fresh):
                forget(old)
            held, seen = kept, more
        return held.select("q", "id", "d"), seen.groupBy("q").agg(F.count("*").alias("seen"))


def _ranked(held: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    w = Window.partitionBy("q").orderBy("d", "id")
    return held.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("id").alias(key), F.col("d").alias("score"), "rank")


def _nearest(pairs: DataFrame, most: int) -> DataFrame:
    """The nearest ``most`` v of each u among u, v, d, fresh; a pair that is there twice is as fresh as the older one."""
    w = Window.partitionBy("u").orderBy("d", "v")
    one = pairs.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return one.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def _projected(v: Column, dim: int, seed: int) -> Column:
    import random

    rng = random.Random(seed)
    return V.dot(v, V.vector([rng.gauss(0, 1) for _ in range(dim)]))


def build_graph(items: DataFrame, path: str, degree: int = 16, rounds: int = 8, key: str = "row_id", vector: str = "embedding", changes: float = 0.01) -> GraphIndex:
    """Make and store the graph of ``items`` below ``path``; rows of other lengths than the first's, or with nulls, aren't indexed."""
    spark = items.sparkSession
    floats = isinstance(items.schema[vector].dataType, T.ArrayType) and isinstance(items.schema[vector].dataType.elementType, T.FloatType)
    good = whole(items, vector).select(F.col(key).alias("id"), F.col(vector).cast("array<float>" if floats else "array<double>").alias("v"))
    first = good.select(F.size("v")).first()
    if first is None:
        raise ValueError("no vectors to index")
    dim = first[0]
    good = written(good.where(F.size("v") == dim), "nodes")
    n, lists = good.count(), None
    longer = degree * max(2, math.ceil(math.log2(max(n, 2)) / 5))
    member = lambda far, last, fresh: F.struct("id", "v", far.alias("far"), last.alias("last"), fresh.alias("fresh"))
    for seed in range(3):
        placed = numbered(good.select("id", "v", _projected(F.col("v"), dim, seed).alias("p")), [F.asc("p"), F.asc("id")], out="at", first=0)
        grouped = placed.groupBy((F.col("at") / WINDOW).cast("long").alias("window")).agg(F.collect_list(member(F.lit(math.inf), F.lit(0).cast("long"), F.lit(True))).alias("m"))  # WINDOW rows
        pairs = _compared(grouped.select("m"), longer)
        lists = pairs if lists is None else lists.unionByName(pairs)
    lists = written(_nearest(lists, longer), "lists")
    for _ in range(rounds):
        # a full list takes what is nearer than its last
        ends = lists.groupBy(F.col("u").alias("id")).agg(F.when(F.count("*") >= longer, F.max(F.struct("d", "v"))).alias("end"))
        nodes = good.join(ends, "id", "left").select("id", "v", F.coalesce("end.d", F.lit(math.inf)).alias("far"), F.coalesce("end.v", F.lit(0)).cast("long").alias("last"))
        back = Window.partitionBy("v").orderBy("d", "u")
        into = lists.withColumn("nth", F.row_number().over(back)).where(F.col("nth") <= longer).select(F.col("v").alias("of"), F.col("u").alias("id"), "fresh")
        members = lists.select(F.col("u").alias("of"), F.col("v").alias("id"), "fresh").unionByName(into).repartition("of").groupBy("of", "id").agg(F.max("fresh").alias("fresh"))
        members = members.withColumn("any", F.max("fresh").over(Window.partitionBy("of"))).where("any").drop("any")
        grouped = members.join(nodes, "id").groupBy("of").agg(F.collect_list(member(F.col("far"), F.col("last"), F.col("fresh"))).alias("m"))  # 2 * longer rows
        after = written(_nearest(lists.withColumn("fresh", F.lit(False)).unionByName(_compared(grouped.select("m"), longer)), longer), "lists")
        changed = after.where("fresh").count()
        forget(lists)
        lists = after
        del ends, nodes, into, members, grouped
        drop_shuffles(spark)  # a round's has each vector as often as it is in a list
        if changed <= changes * n * longer:
            break
    made = lists
    stored = Window.partitionBy("u").orderBy("d", "v")
    lists = made.withColumn("nth", F.row_number().over(stored)).where(F.col("nth") <= degree).select("u", "v", "d")
    near = lists.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("near"))
    back = Window.partitionBy("v").orderBy("d", "u")  # a way back from each list, so that no vector is out of reach
    into = lists.withColumn("nth", F.row_number().over(back)).where(F.col("nth") <= degree).groupBy("v").agg(F.collect_list("u").alias("into"))
    table = good.join(near, good["id"] == near["u"], "left").drop("u").join(into, good["id"] == into["v"], "left").drop(into["v"])
    none = F.array().cast(f"array<{good.schema['id'].dataType.simpleString()}>")
    table.select("id", good["v"], F.array_union(F.coalesce("near", none), F.coalesce("into", none)).alias("near")).write.mode("overwrite").parquet(f"{path}/lists")
    good.orderBy(F.xxhash64("id")).limit(ENTRIES).write.mode("overwrite").parquet(f"{path}/entries")
    for old in (good, made):
        forget(old)
    return GraphIndex(spark, path, key, vector)


def load_graph(spark: SparkSession, path: str, key: str = "row_id", vector: str = "embedding") -> GraphIndex:
    return GraphIndex(spark, path, key, vector)


def _compared(groups: DataFrame, most: int) -> DataFrame:
    """u, v, d (squared distance), fresh of the members of each row's short list m (id, v, far, last, fresh) with each other.

    For each member at most about the ``most`` nearest others come out, by distance and then id before ``far`` and ``last``; of two members one is fresh.
    """

    def told(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            us, vs, ds = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            for m in batch.column(0):
                ids = np.asarray(m.values.field("id"), np.int64)
                if len(ids) < 2:
                    continue
                x = np.asarray(m.values.field("v").flatten(), float).reshape(len(ids), -1)
                end, last = np.asarray(m.values.field("far"), float), np.asarray(m.values.field("last"), np.int64)
                fresh = m.values.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
                square = (x * x).sum(axis=1)
                far = square[:, None] + square[None, :] - 2 * (x @ x.T)
                far[(ids[:, None] == ids[None, :]) | ~(fresh[:, None] | fresh[None, :])] = np.inf
                slack = 1e-9 * (1 + square)  # of the products; equal vectors are told by their differences
                bound = end + slack
                if len(ids) - 1 > most:
                    bound = np.minimum(bound, np.partition(far, most - 1, axis=1)[:, most - 1] + slack)
                i, j = np.nonzero((far <= bound[:, None]) & (far < np.inf))
                d = ((x[i] - x[j]) ** 2).sum(axis=1)
                good = (d < end[i]) | ((d == end[i]) & (ids[j] < last[i]))
                us.append(ids[i[good]])
                vs.append(ids[j[good]])
                ds.append(d[good])
            u = np.concatenate(us)
            yield pa.RecordBatch.from_arrays([u, np.concatenate(vs), np.concatenate(ds), np.ones(len(u), bool)], names=["u", "v", "d", "fresh"])

    return groups.mapInArrow(told, "u long, v long, d double, fresh boolean")
