"""Exact top-k against brute force: ties, copies, nulls, vectors of several lengths and many rounds."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from larder.llm import topk
from larder.llm.common import ship


def brute(table, k=10, every=100):
    ok = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(ok):
        if i is not None and math.fmod(i, every) == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0) for m, (j, w) in enumerate(ok) if m != n and len(w) == len(v))
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(near[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in topk.nearest(df).select("query_id", "rank", "vec_id", "score").collect()), key=str)


def clustered(rng, n, dim):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [[x + rng.gauss(0, 0.2) for x in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("block", [2048, 16])
def test_against_brute_force(spark, monkeypatch, block):
    ship(spark)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(7)
    table = list(enumerate(clustered(rng, 1500, 12)))
    hot = table[0][1]
    table += [(k, hot) for k in range(5000, 5700)]  # copies: a third of all rows
    table += [(k, [float(rng.randrange(3)) for _ in range(12)]) for k in range(6000, 6300)]  # many ties
    table += [(100, table[100][1])] * 3 + [(100, table[101][1]), (None, hot), (None, table[300][1])]
    table += [(7000, None), (7100, []), (7101, []), (7200, [None] * 12), (7300, [math.nan] * 12), (7400, [math.inf] + [0.0] * 11), (7500, [0.0] * 12), (7600, [1.0, 2.0]), (7601, [3.0, -2.0]), (7700, [1.5] * 3), (-200, [5.0] * 12)]
    rng.shuffle(table)
    df = spark.createDataFrame([(i, v, "x") for i, v in table], "vec_id long, embedding array<double>, entry string").repartition(5)
    assert got(df) == brute(table)


def test_few_blocks_are_visited(spark, monkeypatch):
    """In well-parted clusters the bound stops most visits: the rounds read a small part of the index."""
    ship(spark)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = random.Random(8)
    table = list(enumerate(clustered(rng, 2000, 8)))
    seen = []
    kept = topk.written

    def spied(df, what, **options):
        out = kept(df, what, **options)
        if what == "visits":
            seen.append(out.select(F.sum(F.size("asking"))).first()[0] or 0)
        return out

    monkeypatch.setattr(topk, "written", spied)
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    assert got(df) == brute(table)
    assert len(seen) > 1 and sum(seen) * 16 < 0.6 * 20 * 2000


def test_empty_and_too_large(spark):
    ship(spark)
    assert got(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []
    with pytest.raises(ValueError, match="64 bits"):
        topk.nearest(spark.createDataFrame([(100, [1e12]), (1, [2.0])], "vec_id long, embedding array<double>"))
