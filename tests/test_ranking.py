import random

import pytest
from pyspark.sql import functions as F

from larder.operators import ranking as R
from larder.operators.order import numbered
from larder.operators.ranking import Config, Factor, Objective

BURGERS = [
    (0, "Truffle Burger", "Burger", 25.0, 4.8, 100, 800, 5.0),
    (1, "Basic Burger", "Burger", 10.0, 4.0, 500, 600, 0.0),
    (2, "Green Salad", "Salad", 12.0, 4.5, 200, 250, 2.0),
    (3, "Double Burger", "Burger", 18.0, 4.6, 300, 950, 2.0),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(BURGERS, "row_id int, name string, category string, price double, rating double, order_count int, calories int, delivery_fee double").cache()


def order(df):
    return [r["name"] for r in df.orderBy("rank").collect()]


def test_normalisers(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "x double")
    value = lambda how, inv=False: [r["norm_x"] for r in R.normalised(df, {"x": (how, inv)}).orderBy("x").collect()]
    assert value("min_max") == [0, 0.5, 1] and value("min_max", True) == [1, 0.5, 0]
    assert value("z_score") == pytest.approx([1 / 3, 0.5, 2 / 3]) and value("identity") == [10, 20, 30]
    one = spark.createDataFrame([(5.0,)], "x double")
    assert R.normalised(one, {"x": ("min_max", False)}).first()["norm_x"] == 1.0
    assert R.normalised(one, {"x": ("z_score", False)}).first()["norm_x"] == 1.0
    assert R.normalised(one.select(F.lit(0.0).alias("x")), {"x": ("min_max", False)}).first()["norm_x"] == 0.5


def test_cheapest_first(items):
    assert order(R.rank(items, Config((Factor("PriceScore", invert=True),)))) == ["Basic Burger", "Green Salad", "Double Burger", "Truffle Burger"]


def test_diversity_puts_another_category_second(items):
    assert order(R.rank(items, Config((Factor("RatingScore"),), diversity_column="category", diversity_weight=2.0)))[:2] == ["Truffle Burger", "Green Salad"]


def test_penalty_and_missing_factor(items):
    assert order(R.rank(items, Config((Factor("PenaltyScore", invert=True),))))[0] == "Basic Burger"
    scores = R.rank_factors(items.drop("rating"), (Factor("RatingScore", 0.5), Factor("PriceScore", 0.5, invert=True)))
    assert scores.agg(F.max("final_score")).first()[0] == 1.0


def test_unknown_names(items):
    with pytest.raises(ValueError):
        R.scorer("NoScore")
    with pytest.raises(ValueError):
        R.rank(items, Config((Factor("PriceScore"),), strategy="none"))
    assert R.rank(items, Config()).count() == 4


def test_diversity_equals_the_greedy_choice(spark):
    rng, cases = random.Random(5), {0.0: [], 0.3: [], 1.0: []}
    want = {w: {} for w in cases}
    for case in range(60):
        n, w = rng.randint(1, 7), rng.choice([0.0, 0.3, 1.0])
        own = [(case * 10 + i, f"{case}{rng.choice('ab')}", rng.randint(0, 4) / 2) for i in range(n)]
        cases[w] += own
        left, seen = list(own), {}
        while left:
            best = max(left, key=lambda r: (r[2] - seen.get(r[1], 0) * w, -r[0]))
            want[w][best[0]] = best[2] - seen.get(best[1], 0) * w
            seen[best[1]] = seen.get(best[1], 0) + 1
            left.remove(best)
    for w, rows in cases.items():
        df = spark.createDataFrame(rows, "row_id int, category string, final_score double")
        told = {r["row_id"]: r["adjusted_score"] for r in R.diversify(df, "category", w, [F.asc("row_id")]).collect()}
        assert told == {k: pytest.approx(v) for k, v in want[w].items()}
        few = R.diversify(df, "category", w, [F.asc("row_id")], most=2).orderBy(F.desc("adjusted_score"), "row_id").limit(2).collect()
        assert [r["row_id"] for r in few] == sorted(told, key=lambda k: (-told[k], k))[:2]


def test_a_category_of_nine_tenths_is_dealt_over_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 > 0, "hot").alias("category"), (F.col("id") * 37 % 5003).cast("double").alias("final_score"))
        ranges = numbered(df, [F.desc("final_score")], by=["category"]).larder_tables[0]
        parts = ranges.where("category = 'hot'").groupBy(F.shiftright("__id", 33)).count().collect()
        assert len(parts) > 8 and max(r["count"] for r in parts) < 5000
        got = R.diversify(df, "category", 0.5, [F.asc("row_id")])
        assert got.where("category = 'hot'").agg(F.min("adjusted_score")).first()[0] == -0.5 * 17_999
        ranked = R.rank_factors(df, (Factor("DiversityScore", normalisation="identity"),)).groupBy("category", "final_score").count().collect()
        assert sorted((r["category"] or "", round(1 / r["final_score"]), r["count"]) for r in ranked) == [("", 2000, 2000), ("hot", 18000, 18000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_objectives_and_conflicts(items):
    objectives = (Objective("rating", weight=0.5), Objective("price", weight=0.5, direction="minimize"))
    told = R.conflicts(items, objectives).collect()
    assert len(told) == 1 and told[0]["label"].startswith("rating vs price (Correlation: +0.")
    flat = R.conflicts(items.limit(1), objectives)
    assert flat.count() == 0
    assert Objective.of({"name": "a", "type": "odd", "minimize": True}) == Objective("a", "numeric", direction="minimize")
    assert R.rank(items, Config(objectives=objectives, optimizer="TOPSIS", max_results=2)).count() == 2


def test_config_from_json(tmp_path):
    (tmp_path / "c.json").write_text('{"factors": [{"scorer": "PriceScore", "weight": 2}], "max_results": 3}')
    assert R.Config.load(str(tmp_path / "c.json")) == Config((Factor("PriceScore", 2),), max_results=3)


def test_full_rank_needs_no_window_over_all_rows(spark):
    rows = [(i, float(i * 37 % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, rating double")
    ranked = R.rank(df, Config((Factor("RatingScore", label="stars"), Factor("RatingScore", 0.5))))
    got = [r["row_id"] for r in sorted(ranked.collect(), key=lambda r: r["rank"])]
    assert got == [i for i, v in sorted(rows, key=lambda x: (-x[1], x[0]))] and sorted(r["rank"] for r in ranked.collect()) == list(range(1, 501))
    assert set(ranked.first()["raw"]) == {"stars", "RatingScore"}
