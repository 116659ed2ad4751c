"""Batched vector search with more queries than a block has."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import search


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_many_queries(spark, metric, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 300)
    monkeypatch.setattr(search, "PART", 50)
    rng = random.Random(3)
    items = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(150)]
    asked = [(q, [float(rng.randint(-2, 2)) for _ in range(4)]) for q in range(1100)]
    df = spark.createDataFrame([*items, (900, None), (901, [1.0, None, 0.0, 0.0])], "row_id long, embedding array<double>")
    got = search.batch_search(df, spark.createDataFrame(asked, "query_id long, embedding array<double>"), 5, metric).orderBy("query_id", "rank").collect()
    score = lambda a, b: sum(x * y for x, y in zip(a, b)) if metric == "ip" else sum((x - y) ** 2 for x, y in zip(a, b))
    want = []
    for q, v in asked:
        best = sorted((-score(v, w) if metric == "ip" else score(v, w), i) for i, w in items)[:5]
        want += [(q, i, abs(s) if s == 0 else -s if metric == "ip" else s, r) for r, (s, i) in enumerate(best, 1)]
    assert [(r["query_id"], r["row_id"], r["score"], r["rank"]) for r in got] == want
    assert search.batch_search(df, df.limit(0).select(F.col("row_id").alias("query_id"), "embedding"), 5).count() == 0
