"""BM25 with skipped spans, fusion, Pareto fronts, TOPSIS and PROMETHEE against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import fronts, keywords
from larder.operators.ranking import Objective
from larder.plans import retrieval_queries


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, [1 / (1 + w) for w in range(60)], k=rng.randrange(1, 30)))) for k in range(2000)]
    rows += [(3000, None), (3001, ""), (3002, "Été w1 w1 W1!")]
    return rows


def bm25(rows, query):
    terms = {k: re.findall(r"[^\W_]+", (t or "").lower()) for k, t in rows}
    mean = sum(map(len, terms.values())) / len(terms)
    df = Counter(t for ts in terms.values() for t in set(ts))
    out = {}
    for k, ts in terms.items():
        n = Counter(ts)
        s = sum(math.log(1 + (len(terms) - df[t] + 0.5) / (df[t] + 0.5)) * n[t] * 2.2 / (n[t] + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for t in set(query.lower().split()) if n[t])
        if s:
            out[k] = s
    return out


def test_bm25_skips_spans_and_stays_exact(spark, docs, tmp_path):
    df = spark.createDataFrame(docs, "row_id long, text string").repartition(5)
    keywords.build_keywords(df, str(tmp_path), span=32)
    index = keywords.load_keywords(spark, str(tmp_path))
    for query in ("w40 w55", "w0 w1 w58", "été", "W1 nosuchword"):
        want = sorted(bm25(docs, query).items(), key=lambda x: (-x[1], x[0]))[:10]
        got = [(r["row_id"], r["score"]) for r in index.search(query, 10).orderBy("rank").collect()]
        assert [k for k, _ in got] == [k for k, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want])
    assert index.search("...", 10).collect() == [] and index.search("nosuchword", 10).collect() == []
    assert index.kept_spans(["w40", "w55"], 3).count() < 0.8 * index.bounds(["w40", "w55"]).count()


def shuffled(spark) -> int:
    """Rows that all stages so far have written into shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_postings_take_little_disk(spark, docs, tmp_path):
    """A row for each term of a batch of documents is shuffled, not one for each posting, and nothing but the index stays."""
    df = spark.createDataFrame(docs, "row_id long, text string").coalesce(2)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before, there = shuffled(spark), set(shared.iterdir())
    keywords.build_keywords(df, str(tmp_path), span=32)
    postings = sum(len(set(re.findall(r"[^\W_]+", (t or "").lower()))) for _, t in docs)
    assert shuffled(spark) - before < 0.1 * postings
    assert set(shared.iterdir()) == there


def test_hybrid_takes_little_disk(spark, sf):
    """Both searches of hybrid_topk: few rows are shuffled for a posting, and the scores of all documents go when the best are known."""
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.array_distinct(keywords.terms_of(F.col("text"))).alias("t"))
    postings = texts.agg(F.sum(F.size("t"))).first()[0]
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before, there = shuffled(spark), set(shared.iterdir())
    assert retrieval_queries.QUERIES["hybrid_topk"](spark, sf).count() == 20
    assert shuffled(spark) - before < 2 * postings  # 4.2 where postings were shuffled, and most terms of this small table are in one document
    assert {p.name.split("-")[0] for p in set(shared.iterdir()) - there} <= {"postings", "bounds", "best"}


def test_bm25_of_long_and_of_equal_documents(spark, tmp_path, monkeypatch):
    """Counts and lengths of more than a byte or two, batches of few words, keys of any kind, and ties by key."""
    monkeypatch.setattr(keywords, "BATCH_WORDS", 500)
    rng = random.Random(7)
    rows = [(f"d{k:04}", " ".join(rng.choices(["a", "b", "c", "d", "e"], k=rng.randrange(40)))) for k in range(300)]
    rows += [("long", "a b " * 40_000), ("many", "b " * 300 + "c"), *((f"same{k}", "a b c e " * 3) for k in range(9, -1, -1)), ("none", None)]
    keywords.build_keywords(spark.createDataFrame(rows, "row_id string, text string").coalesce(1), str(tmp_path), span=3)
    index = keywords.load_keywords(spark, str(tmp_path))
    for k in (5, 400):
        got = [(r["row_id"], r["score"]) for r in index.search("c a e b", k).orderBy("rank").collect()]
        want = sorted(bm25(rows, "c a e b").items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        assert [s for _, s in got] == pytest.approx([s for _, s in want])
        assert [x for x, _ in got if x.startswith("same")] == [x for x, _ in want if x.startswith("same")]
        assert {x for x, _ in got} == {x for x, _ in want}


def test_fused_order(spark):
    near = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.1)], "row_id long, score double")
    words = spark.createDataFrame([(2, 6.0), (4, 12.0)], "row_id long, score double")
    got = [(r["row_id"], round(r["score"], 6)) for r in keywords.fused(near, words, 3).orderBy("rank").collect()]
    assert got == [(2, 0.71), (1, 0.63), (4, 0.3)]


@pytest.mark.parametrize("block", [4096, 50])
def test_pareto(spark, monkeypatch, block):
    monkeypatch.setattr(fronts, "BLOCK", block)
    rng = random.Random(2)
    rows = [(k, rng.randrange(30), round(rng.random(), 2), rng.randrange(20)) for k in range(3000)]
    rows += [(5000 + k, k, 1 - k / 400, 3) for k in range(400)]  # a long front
    rows += [(9000, None, 0.5, 3), (9001, 29, 1.0, 0), (9002, 29, 1.0, 0)]
    df = spark.createDataFrame(rows, "row_id long, a long, b double, c long").repartition(6)
    objectives = (Objective("a"), Objective("b"), Objective("c", direction="minimize"))
    x = np.array([[a or 0, b, -c] for _, a, b, c in rows], float)
    want = {r[0] for r, mine in zip(rows, x, strict=True) if not ((x >= mine).all(axis=1) & (x > mine).any(axis=1)).any()}
    got = [r["row_id"] for r in fronts.pareto_front(df, objectives).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert fronts.pareto_front(df.limit(0), objectives).count() == 0 and fronts.pareto_front(df, ()).count() == len(rows)


def test_pareto_of_equal_rows_is_of_points(spark, monkeypatch):
    """Rows with equal objectives are compared once: 40,000 rows of 400 points make no more than 400 points to compare."""
    sizes = []
    monkeypatch.setattr(fronts, "numbered", lambda df, *a, real=fronts.numbered, **o: sizes.append(df.count()) or real(df, *a, **o))
    df = spark.range(40000).repartition(8).selectExpr("id AS row_id", "CAST(id % 400 AS DOUBLE) AS a", "CAST((id % 400) * 7 % 400 AS DOUBLE) AS b")
    x = np.array([[k, -(k * 7 % 400)] for k in range(400)], float)
    want = {k for k in range(400) if not ((x >= x[k]).all(axis=1) & (x > x[k]).any(axis=1)).any()}
    got = [r["row_id"] for r in fronts.pareto_front(df, (Objective("a"), Objective("b", direction="minimize"))).collect()]
    assert len(got) == 100 * len(want) and {k % 400 for k in got} == want and len(set(got)) == len(got)
    assert sizes[0] <= 400


def test_pareto_of_sums_that_round(spark, monkeypatch):
    monkeypatch.setattr(fronts, "BLOCK", 4)
    rows = [(k, 1e17, k / 1000) for k in range(2560)] + [(7000, -0.0, 20.0), (7001, 0.0, 20.0)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double").coalesce(1)
    got = {r["row_id"] for r in fronts.pareto_front(df, (Objective("a"), Objective("b"))).collect()}
    assert got == {2559, 7000, 7001}


def test_topsis_and_promethee(spark):
    rows = [(k, float(k % 7), float((k * 3) % 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    objectives = (Objective("a", weight=0.6), Objective("b", weight=0.4, direction="minimize"))
    v = np.array([[a, -b] for _, a, b in rows])
    w = v / np.sqrt((v * v).sum(axis=0)) * [0.6, 0.4]
    best, worst = (np.sqrt(((w - e) ** 2).sum(axis=1)) for e in (w.max(axis=0), w.min(axis=0)))
    got = {r["row_id"]: r["final_score"] for r in fronts.topsis(df, objectives).collect()}
    assert [got[k] for k in range(40)] == pytest.approx(list(worst / (best + worst)))
    flow = [sum(wt * ((v[:, j] < x[j]).sum() - (v[:, j] > x[j]).sum()) for j, wt in ((0, 0.6), (1, 0.4))) / 39 for x in v]
    got = {r["row_id"]: r["final_score"] for r in fronts.promethee(df, objectives).collect()}
    assert [got[k] for k in range(40)] == pytest.approx(flow)
    assert fronts.topsis(df, ()).agg(F.sum("final_score")).first()[0] == 0
