"""Sessions on a stream against the same rows as a table."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.streaming.sessions import session_stream, session_table

BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "conv_id string, at timestamp, role string, text string"


def made():
    rng = random.Random(6)
    rows, now = [], 0.0
    for k in range(240):
        now += rng.choice([1, 2, 5, 40])
        conv = rng.choice(["a", "a", "b", "c", "", None])
        rows.append((conv, BEGIN + dt.timedelta(seconds=now), rng.choice(["user", "assistant", "user", "assistant", "reset"]), f"text {k}"))
    return rows


def test_stream_equals_table(spark, tmp_path):
    rows = made()
    for k in range(0, 240, 60):
        spark.createDataFrame(rows[k : k + 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            first = {p.name for p in (tmp_path / "in").iterdir()}
    assert first
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = session_stream(stream, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    order = lambda df: sorted((r["conv_id"], r["begun"], r["turn"], r["role"], r["text"]) for r in df.collect())
    want = order(session_table(spark.createDataFrame(rows, SCHEMA), 60))
    assert order(out.where("event = 'turn'")) == want and len(want) > 100
    assert {c for c, *_ in want} == {"a", "b", "c"}
    events = {r["event"]: r["n"] for r in out.groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert events["reset"] > 5 and events["expired"] > 5
    # each session that isn't the last of its id has ended once
    sessions = out.where("event = 'turn'").select("conv_id", "begun").distinct().count()
    assert sessions - 3 <= events["reset"] + events["expired"] <= sessions


def test_by_hand(spark):
    at = lambda s: BEGIN + dt.timedelta(seconds=s)
    rows = [("a", at(0), "user", "1"), ("a", at(10), "assistant", "2"), ("a", at(71), "user", "3"), ("a", at(72), "reset", None), ("a", at(73), "user", "4"), ("b", at(5), "user", "5"), ("", at(5), "user", "lost"), (None, at(5), "user", "lost")]
    got = session_table(spark.createDataFrame(rows, SCHEMA), 60).collect()
    assert sorted((r["text"], r["conv_id"], (r["begun"] - BEGIN).seconds, r["turn"]) for r in got) == [("1", "a", 0, 0), ("2", "a", 0, 1), ("3", "a", 71, 0), ("4", "a", 73, 0), ("5", "b", 5, 0)]
    with pytest.raises(ValueError, match="streaming"):
        session_stream(spark.createDataFrame(rows, SCHEMA), 60)
