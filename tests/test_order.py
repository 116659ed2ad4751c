"""Places in a sorted table: each once, with adaptive execution on and off, and apart for the values of a column."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larder.operators.order import numbered
from larder.operators.ranking import Config, Factor, rank


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_whole_table_of_wide_rows(spark, tmp_path, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        wide = [F.concat(F.lit("x" * 40), F.col("id").cast("string")).alias(f"note{k}") for k in range(6)]
        items = spark.range(500_000).select(F.col("id").alias("row_id"), ((F.col("id") * 7919) % 10007).cast("double").alias("rating"), *wide)
        ranked = rank(items, Config((Factor("RatingScore"),)))
        ranked.select("rank", "row_id", "rating", "note0").write.parquet(str(tmp_path / "out"))
        out = spark.read.parquet(str(tmp_path / "out"))
        told = out.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.countDistinct("row_id")).first()
        assert tuple(told) == (500_000, 500_000, 1, 500_000, 500_000)
        pairs = out.select(F.col("rank"), "rating", "row_id").join(out.select((F.col("rank") - 1).alias("rank"), F.col("rating").alias("next"), F.col("row_id").alias("next_id")), "rank")
        assert pairs.where("next > rating or next = rating and next_id < row_id").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_apart_for_a_hot_value_a_null_and_few_rows(spark):
    rows = [("a", k) for k in range(3000)] + [(None, k) for k in range(5)] + [("b", 1)]
    df = spark.createDataFrame(rows, "kind string, x int").repartition(7)
    got = numbered(df, [F.desc("x")], by=["kind"], out="place").collect()
    assert sorted((r["kind"] or "", r["place"], r["x"]) for r in got) == sorted((k or "", {"a": 3000, None: 5, "b": 2}[k] - x, x) for k, x in rows)


def test_empty(spark):
    assert numbered(spark.createDataFrame([], "x int"), [F.asc("x")]).collect() == []
