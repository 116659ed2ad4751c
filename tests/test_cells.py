"""The stored cell index: recall, pruned partitions, further rows, hot cells."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import cells, search


def made(rng, n, at=0):
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    return [(at + k, [x + rng.gauss(0, 0.25) for x in rng.choice(centres)]) for k in range(n)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = made(rng, 4000) + [(10_000 + k, [5.0] * 16) for k in range(1500)] + [(90_000, None), (90_001, [None] * 16)]
    items = spark.createDataFrame(rows, "row_id long, embedding array<double>").repartition(6)
    path = str(tmp_path_factory.mktemp("index"))
    cells.build_cells(items, path, 32)
    return items, path


def queries(items, every=50):
    return items.where(F.col("row_id") % every == 0).select(F.col("row_id").alias("query_id"), "embedding")


def test_recall_of_a_loaded_index(spark, stored):
    items, path = stored
    index = cells.load_cells(spark, path)
    asked = queries(items)
    exact = search.batch_search(items, asked, 10, "l2")
    told = cells.recall(index.search(asked, 10, nprobe=8), exact).first()
    assert told["recall"] >= 0.9 and told["queries"] == asked.where("embedding is not null").count()
    every = cells.recall(index.search(asked, 10, nprobe=32), exact).first()
    assert every["recall"] == 1.0
    scores = lambda df: sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert scores(index.search(asked, 10, nprobe=32)) == scores(exact)


def test_partitions_are_pruned(spark, stored):
    items, path = stored
    one = items.where("row_id = 3").select(F.col("row_id").alias("query_id"), "embedding")
    found = cells.load_cells(spark, path).search(one, 5, nprobe=2)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert found.count() == 5


def test_further_rows_without_a_new_fit(spark, stored):
    items, path = stored
    index = cells.load_cells(spark, path)
    before = index.centres()
    more = spark.createDataFrame([(200_000 + k, [9.0 + k / 100] * 16) for k in range(20)], "row_id long, embedding array<double>")
    index.add(more)
    again = cells.load_cells(spark, path)
    assert again.centres() == before and again.cells.count() == items.count() + 20
    found = again.search(more.where("row_id = 200003").select(F.col("row_id").alias("query_id"), "embedding"), 3, nprobe=1)
    assert [r["row_id"] for r in found.orderBy("rank").collect()] == [200003, 200002, 200004]


def test_wrong_numbers(spark, stored):
    items, path = stored
    with pytest.raises(ValueError, match="cells"):
        cells.build_cells(items, path, 0)
    with pytest.raises(ValueError, match="no vectors"):
        cells.build_cells(items.where("row_id < 0"), path, 4)
