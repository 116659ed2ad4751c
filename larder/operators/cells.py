"""A stored cell index: vectors in files by their nearest centre, searched for a batch of queries in the cells next to them.

``path/centres`` has a row for each cell, ``path/cells`` the vectors in a partition for each cell.  Centres are fitted on a sample of
SAMPLE_EACH vectors a cell; every vector is indexed, and further ones are put into their cells without a new fit.  There are at most MOST_CELLS centres:
only they, and a row for each cell with the parts it is searched in, are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import BLOCK, PART, best_of_parts, whole

#: Cells at most, and vectors of the sample for each.
MOST_CELLS, SAMPLE_EACH = 1 << 16, 256


@dataclass
class CellIndex:
    """A stored index: its folder, and what its columns are called."""

    spark: SparkSession
    path: str
    key: str
    vector: str
    metric: str

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def centres(self) -> list[list[float]]:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell_id").limit(MOST_CELLS).collect()
        return [list(r["centre"]) for r in rows]

    def add(self, items: DataFrame) -> None:
        """Put further vectors into the cells there are."""
        told = _near(items.select(self.key, self.vector, *(c for c in items.columns if c not in (self.key, self.vector))), self.vector, self.centres(), 1)
        told = told.withColumn("cell_id", F.col("__cells")[0]).drop("__cells")
        # a cell of many vectors is written by several tasks
        told.hint("rebalance", "cell_id").write.mode("append").partitionBy("cell_id").parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, k: int, nprobe: int = 8, query_key: str = "query_id") -> DataFrame:
        """query_key, key, score, rank of the k best vectors in the ``nprobe`` cells next to each query.

        Cells that no query needs are not read: the row for each needed cell prunes the partitions when the search runs.  A cell is searched part by part, against
        a block of queries at a time, as in ``batch_search``.
        """
        probes = _near(whole(queries.select(query_key, self.vector), self.vector), self.vector, self.centres(), nprobe)
        probes = probes.withColumn("cell_id", F.explode("__cells")).drop("__cells")
        # partitions are numbered by the file system: cells without vectors have none
        sizes = self.cells.groupBy("cell_id").agg(F.count("*").alias("n"))
        asked = probes.groupBy("cell_id").agg(F.count("*").alias("asked"))
        plan = asked.join(sizes, "cell_id").select("cell_id", F.ceil(F.col("n") / PART).cast("int").alias("parts"), F.ceil(F.col("asked") / BLOCK).cast("int").alias("blocks")).where("parts > 0")
        plan = F.broadcast(plan)  # MOST_CELLS rows
        items = whole(self.cells, self.vector).join(plan, "cell_id")
        deal = lambda df, by, own, of, other, every: df.select(
            "cell_id",
            F.pmod(F.xxhash64(by), F.col(of)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(every) - 1)).alias(other),
            F.size(self.vector).alias("dim"),
            F.col(by).alias("key"),
            F.col(self.vector).cast("array<double>").alias("v"),
        )
        left = deal(items, self.key, "part", "parts", "block", "blocks")
        right = deal(probes.join(plan, "cell_id"), query_key, "block", "blocks", "part", "parts")
        key_type, query_type = items.schema[self.key].dataType, queries.schema[query_key].dataType
        return best_of_parts(left, right, ["cell_id", "block", "part", "dim"], k, self.metric, (self.key, key_type), (query_key, query_type))


def _near(df: DataFrame, vector: str, centres: list[list[float]], many: int) -> DataFrame:
    """``df`` with __cells, the numbers of the ``many`` nearest centres, nearest first."""

    def told(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = np.array(centres)
        square = (own * own).sum(axis=1)
        for batch in batches:
            x = np.array([v if v is not None and len(v) == own.shape[1] else np.full(own.shape[1], np.nan) for v in batch.column(vector).to_pylist()], float).reshape(-1, own.shape[1])
            far = np.nan_to_num(square[None, :] - 2 * (x @ own.T), nan=np.inf)
            order = np.argsort(far, axis=1, kind="stable")[:, :many]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order.astype("int32")), pa.list_(pa.int32()))], names=[*batch.schema.names, "__cells"])

    return df.mapInArrow(told, df.withColumn("__cells", F.lit(None).cast("array<int>")).schema)


def build_cells(items: DataFrame, path: str, cells: int, key: str = "row_id", vector: str = "embedding", metric: str = "l2", seed: int = 1) -> CellIndex:
    """Fit centres on a bounded sample and store every row of ``items`` below ``path``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"between 1 and {MOST_CELLS} cells")
    good = whole(items, vector)
    n = good.count()
    if not n:
        raise ValueError("no vectors to index")
    sample = good.sample(min(1.0, 1.2 * SAMPLE_EACH * cells / n), seed).limit(SAMPLE_EACH * cells) if n > SAMPLE_EACH * cells else good
    model = KMeans(k=cells, seed=seed, featuresCol="__v").fit(sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("__v")))
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    spark = items.sparkSession
    spark.createDataFrame(centres, "cell_id int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    index = CellIndex(spark, path, key, vector, metric)
    spark.createDataFrame([], items.schema).withColumn("cell_id", F.lit(0)).write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/cells")
    index.add(items)
    return index


def load_cells(spark: SparkSession, path: str, key: str = "row_id", vector: str = "embedding", metric: str = "l2") -> CellIndex:
    """An index stored before."""
    index = CellIndex(spark, path, key, vector, metric)
    if not index.centres():
        raise ValueError(f"no centres in {path}")
    return index


def recall(found: DataFrame, exact: DataFrame, query_key: str = "query_id", key: str = "row_id") -> DataFrame:
    """One row: the queries, the neighbours that an exact search has, and the part of them that was found."""
    hits = exact.select(query_key, key).join(found.select(query_key, key).withColumn("hit", F.lit(1)), [query_key, key], "left")
    return hits.agg(F.count_distinct(query_key).alias("queries"), F.count("*").alias("neighbours"), (F.count("hit") / F.count("*")).alias("recall"))
