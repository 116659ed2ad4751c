"""Filters against a row-at-a-time model of their two-valued logic, and the engine's outputs."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from larder.functions import predicates as P
from larder.operators import filtering as E
from larder.operators.filtering import Config, Group, Rule

NAN = float("nan")
ROWS = [
    (0, 420.0, 35, True, ["vegan", "Spicy"], "Italian", "2024-01-10", None),
    (1, 650.5, 12, False, ["meat"], "italian bistro", "2024-01-20T06:00:00", "yes"),
    (2, None, 30, None, None, None, None, "TRUE"),
    (3, NAN, -1, True, [], "", "not a date", "maybe"),
    (4, 500.0, 0, False, ["vegan", None], "Thai", "2024-01-15", "1"),
]
SCHEMA = "row_id int, calories double, protein int, flag boolean, tags array<string>, cuisine string, created string, answer string"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def missing(v):
    return v is None or isinstance(v, float) and math.isnan(v)


def number(v):
    return None if missing(v) else float(v)


def text(v):
    return "nan" if missing(v) else str(v)


MODEL = {
    "==": lambda v, t: number(v) is not None and number(v) == t,
    "!=": lambda v, t: missing(v) or number(v) != t,
    ">": lambda v, t: number(v) is not None and number(v) > t,
    ">=": lambda v, t: number(v) is not None and number(v) >= t,
    "<": lambda v, t: number(v) is not None and number(v) < t,
    "<=": lambda v, t: number(v) is not None and number(v) <= t,
    "between": lambda v, t: number(v) is not None and t[0] <= number(v) <= t[1],
    "outside": lambda v, t: number(v) is not None and not t[0] <= number(v) <= t[1],
    "approximately_equal": lambda v, t: number(v) is not None and abs(number(v) - t) <= 0.05 * abs(t),
    "contains": lambda v, t: t in text(v),
    "icontains": lambda v, t: t.lower() in text(v).lower(),
    "startswith": lambda v, t: text(v).startswith(t),
    "endswith": lambda v, t: text(v).endswith(t),
    "exact": lambda v, t: text(v) == t,
    "regex": lambda v, t: re.search(t, text(v)) is not None,
    "list_contains": lambda v, t: t in (v or []),
    "contains_any": lambda v, t: bool(set(t) & set(v or [])),
    "overlap": lambda v, t: bool(set(t) & set(v or [])),
    "contains_all": lambda v, t: set(t) <= set(v or []),
    "superset": lambda v, t: set(t) <= set(v or []),
    "subset": lambda v, t: set(v or []) <= set(t),
    "is_true": lambda v, t: v is True or v == 1 and not isinstance(v, str) or isinstance(v, str) and v.lower() in ("true", "1", "yes"),
    "is_null": lambda v, t: missing(v),
    "in": lambda v, t: None in t if v is None else v in t,
}
MODEL |= {"is_false": lambda v, t: not MODEL["is_true"](v, t), "not_null": lambda v, t: not missing(v), "not_in": lambda v, t: not MODEL["in"](v, t)}
COLUMN = {name: i for i, name in enumerate(SCHEMA.replace(",", "").split()[::2])}
CASES = (
    [("calories", op, t) for op in ("==", "!=", ">", ">=", "<", "<=", "approximately_equal") for t in (500.0, 420.0, 0.0)]
    + [("protein", op, t) for op in ("==", "!=", ">", "<=") for t in (12.0, -1.0)]
    + [("calories", op, [420, 500]) for op in ("between", "outside")]
    + [("cuisine", op, t) for op in ("contains", "icontains", "startswith", "endswith", "exact") for t in ("Ital", "italian", "i", "nan", "")]
    + [("cuisine", "regex", t) for t in ("^I", "an$", "a.i", "^$")]
    + [("tags", "list_contains", "vegan")]
    + [("tags", op, t) for op in ("contains_any", "overlap", "contains_all", "superset", "subset") for t in (["vegan"], ["vegan", "Spicy"], ["x"])]
    + [(c, op, None) for c in ("flag", "answer", "protein") for op in ("is_true", "is_false")]
    + [(c, op, None) for c in ("calories", "cuisine", "tags") for op in ("is_null", "not_null")]
    + [("cuisine", op, t) for op in ("in", "not_in") for t in (["Thai", "Italian"], ["Thai", None])]
)


@pytest.mark.parametrize("column,op,threshold", CASES)
def test_predicate_agrees_with_the_model(items, column, op, threshold):
    want = [r[0] for r in ROWS if MODEL[op](r[COLUMN[column]], threshold)]
    got = [r[0] for r in E.passed(items, [Rule(column, op, threshold)]).select("row_id").orderBy("row_id").collect()]
    assert got == want


@pytest.mark.parametrize(
    "op,threshold,want",
    [("before", "2024-01-15", [0]), ("after", "2024-01-15", [1]), ("between_dates", ["2024-01-10", "2024-01-15"], [0, 4]), ("today", None, [4]), ("last_days", 3, [1, 4]), ("next_days", 2, [0, 4]), ("before", "no date", [])],
)
def test_dates(items, op, threshold, want):
    got = E.passed(items, [Rule("created", op, threshold)], Config(now=dt.datetime(2024, 1, 15, 12))).select("row_id").orderBy("row_id").collect()
    assert [r[0] for r in got] == want


def test_every_operator_is_there_and_never_null(items):
    assert len(P.PREDICATES) + len(P.SCHEMA_PREDICATES) == 35
    for name, p in P.PREDICATES.items():
        for c in items.columns:
            t = [1, 2] if name in ("between", "outside", "between_dates") else 1
            out = p(F.col(c), t, P.Context(items.schema[c].dataType, now=dt.datetime(2024, 1, 1)))
            assert items.select(out.alias("x")).where("x is null").isEmpty(), (name, c)


def test_groups_and_skipped_members(items):
    group = Group("OR", (Rule("protein", ">", 100), Group("AND", (Rule("flag", "is_true"), Rule("calories", "<=", 500)))))
    assert [r[0] for r in E.passed(items, [group]).select("row_id").collect()] == [0]
    assert E.passed(items, [Group("OR", (Rule("gone", "==", 1), Rule("protein", ">", 100)))]).count() == 5
    assert E.passed(items, [Group("OR", (Rule("gone", "==", 1), Rule("protein", ">", 100)))], Config(strict=True)).count() == 0
    assert E.passed(items, [Group("AND", ())]).count() == 5
    with pytest.raises(ValueError):
        E.passed(items, [Group("AND", (Rule("gone", "==", 1),))], Config(skip_missing_columns=False))
    with pytest.raises(ValueError):
        Group("XOR")
    with pytest.raises(ValueError):
        Rule("a", "==", 1, tolerance=2)


def test_hard_rules_stop_and_soft_rules_score(items):
    rules = [Rule("protein", ">=", 10, priority=2), Rule("calories", "<=", 600, priority=1), Rule("flag", "is_true", rule_type="SOFT", weight=2, reward=1, penalty=-1)]
    out = {r["row_id"]: r for r in E.apply_rules(items, rules).collect()}
    assert {k: r["hard_passed"] for k, r in out.items()} == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert out[1]["rejection_reason"] == "Hard rule failed: calories <= 600" and out[1]["failed_rules"] == ["calories"]
    assert out[4]["rejection_reason"] == "Hard rule failed: protein >= 10" and out[4]["matched_rules"] == ["calories"]
    assert out[0]["soft_score"] == 2.0 and out[0]["matched_rules"] == ["calories", "protein", "flag"]
    stats = E.statistics(E.apply_rules(items, rules)).first()
    assert (stats["n_in"], stats["n_passed"], stats["max_soft"]) == (5, 1, 2.0)
    assert {r["rule_column"]: r["n_failed"] for r in E.hard_breakdown(E.apply_rules(items, rules)).collect()} == {"calories": 3, "protein": 1}


def test_a_custom_operator(items):
    P.register("divisible_by", lambda v, t, c: P.surely(v % t == 0))
    try:
        assert [r[0] for r in E.passed(items, [Rule("protein", "divisible_by", 10)]).select("row_id").collect()] == [2, 4]
    finally:
        del P.PREDICATES["divisible_by"]


def test_hard_rules_reach_the_scan(spark, sf):
    plan = E.passed(spark.read.parquet(f"{sf}/lineitem.parquet"), [Rule("l_quantity", ">", 30)]).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_quantity" in plan.split("PushedFilters")[1]


def test_a_stream_is_filtered(spark, sf, tmp_path):
    from larder.streaming import filter_stream

    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.limit(100).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = filter_stream(stream, [Rule("value", ">", 0)]).writeStream.format("memory").queryName("filtered").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("filtered").count() == spark.read.parquet(str(tmp_path / "in")).where("value > 0").count()
