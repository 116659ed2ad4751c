"""The graph index: recall and the vectors visited."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import cells, graph_index, search


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(k, [x + rng.gauss(0, 0.5) for x in rng.choice(centres)]) for k in range(3000)]
    rows += [(5000 + k, [3.0] * 12) for k in range(60)] + [(7000, None), (7001, [None] * 12)]
    return spark.createDataFrame(rows, "row_id long, embedding array<double>").repartition(4).cache()


def test_recall_with_few_visits(spark, items, tmp_path):
    graph_index.build_graph(items, str(tmp_path), degree=12)
    index = graph_index.load_graph(spark, str(tmp_path))
    asked = items.where("row_id % 60 = 0").select(F.col("row_id").alias("query_id"), "embedding")
    exact = search.batch_search(items, asked, 10, "l2").where("row_id < 5000")
    told = cells.recall(index.search(asked, 10, width=48), exact).first()
    assert told["recall"] >= 0.95
    seen = index.visit(asked, 48)[1].agg(F.avg("seen")).first()[0]
    assert seen < 0.4 * 3000
    assert index.lists.count() == 3060


def test_nothing_to_index(items, tmp_path):
    with pytest.raises(ValueError, match="no vectors"):
        graph_index.build_graph(items.where("row_id > 6999"), str(tmp_path))


def test_lists_without_clusters(spark, tmp_path):
    """Vectors of many dimensions that lie in no clusters: lists of ``degree`` while they are made stop at about a half of the near ones."""
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(32)]) for k in range(2500)] + [(4000 + k, [0.5] * 32) for k in range(150)]
    items = spark.createDataFrame(rows, "row_id long, embedding array<float>").repartition(4).cache()
    graph_index.build_graph(items, str(tmp_path), degree=10)
    index = graph_index.load_graph(spark, str(tmp_path))
    asked = items.where("row_id % 25 = 0").select(F.col("row_id").alias("query_id"), "embedding")
    exact = search.batch_search(items, asked, 10, "l2")
    listed = index.lists.join(asked, F.col("id") == F.col("query_id")).select("query_id", F.explode("near").alias("row_id"))
    assert cells.recall(listed, exact.where("row_id <> query_id")).first()["recall"] >= 0.9
    assert cells.recall(index.search(asked, 10, width=32), exact).first()["recall"] >= 0.95
