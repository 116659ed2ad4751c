"""CSV records put together over splits, against the reader that takes a file as one task."""

from __future__ import annotations

import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.sources.csv_splits import records, read_split_csv


def written(path, rng, rows, end="\n"):
    bits = ["a", "b", ",", '"', "\n", "\n\n", " ", "é", "x" * 20, "1", ""]
    table = [[k, "".join(rng.choices(bits, k=rng.randrange(6))), rng.choice(["", "plain", "two\nlines", 'a "word"', "\n"]), rng.random()] for k in range(rows)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["k", "some text", "other", "score"])
        out.writerows(table)


@pytest.mark.parametrize("size", [64, 1000, 100_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_one_task_a_file(spark, tmp_path, size, end):
    rng = random.Random(size)
    for n, rows in enumerate((200, 1, 0)):
        written(tmp_path / f"{n}.csv", rng, rows, end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = read_split_csv(spark, str(tmp_path)).orderBy("k", "score").collect()
        splits = records(spark, str(tmp_path)).select("at.split").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("inferSchema", True).option("lineSep", end).csv(str(tmp_path))
    assert [tuple(r) for r in got] == [tuple(r) for r in whole.orderBy("k", "score").collect()] and len(got) == 201
    assert splits > 20 or size > 64


def test_a_cell_over_many_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"' + "line\n" * 400 + '"\n2,"x"\n3,"' + "a,b\n" * 300 + '"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = read_split_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r) for r in got] == [(1, "line\n" * 400), (2, "x"), (3, "a,b\n" * 300)]


def test_kinds_and_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,l,d,day,flag,s,none\n1,3000000000,1,2024-01-02,true,x,\n2,1,2.5,2024-01-03,false,7,\n")
    got = read_split_csv(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in got.dtypes] == ["int", "bigint", "double", "date", "boolean", "string", "string"]
    assert tuple(got.orderBy("i").first()) == (1, 3000000000, 1.0, dt.date(2024, 1, 2), True, "x", None)
    own = read_split_csv(spark, str(tmp_path / "a.csv"), got.withColumn("i", F.col("i").cast("string")).schema)
    assert own.schema["i"].dataType.simpleString() == "string"
