"""Data-quality validation and profiling: everything that needs rows is told by one aggregation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import CANONICAL

# Which columns a table must, should and may have.
MANDATORY = ["recipe_name", "ingredients"]
#: What a table loses without each of these.
RECOMMENDED = {
    "price": "no price: budgets can't be met",
    "meal_type": "no meal type: meals can't be told apart",
    "diet_labels": "no diet labels: diets (keto, vegan and others) can't be kept",
    "protein_g_per_serving": "no protein: nothing can be suggested as rich in it",
    "calories_per_serving": "no calories: no search by nutrition, nothing can be suggested as light",
}
OPTIONAL = ["rating", "description", "image_url", "cuisine_type", "preparation_time_minutes", "availability", "popularity", "item_type"]

Violation = Callable[[Column], Column]


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def positive(c: Column) -> Column:
    """A violation: less than 0. What isn't a number is no violation."""
    return F.coalesce(_number(c) < 0, F.lit(False))


def greater_than_zero(c: Column) -> Column:
    return F.coalesce(_number(c) <= 0, F.lit(False))


def in_range(low: float | None = None, high: float | None = None) -> Violation:
    def broken(c: Column) -> Column:
        n = _number(c)
        under = n < low if low is not None else F.lit(False)
        over = n > high if high is not None else F.lit(False)
        return F.coalesce(under | over, F.lit(False))

    return broken


def non_empty(c: Column) -> Column:
    """A violation: null, blank, or the text ``nan``."""
    return c.isNull() | F.coalesce(F.trim(c.cast("string")).isin("", "nan"), F.lit(False))


RULES: dict[str, list[tuple[str, Violation]]] = {
    "price": [("positive", positive)],
    "servings": [("greater_than_zero", greater_than_zero)],
    "calories_per_serving": [("positive", positive)],
    "protein_g_per_serving": [("positive", positive)],
}


def absent(df: DataFrame, name: str) -> Column:
    """Whether a cell is missing: null, or no number."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c.isNull()


def profile_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, missing_percent (2 places), warning (over 50 %): one pass, whatever the number of columns."""
    columns = columns or df.columns
    told = df.agg(F.count("*").alias("n"), *(F.count_if(absent(df, c)).alias(f"c{i}") for i, c in enumerate(columns)))
    share = lambda i: F.round(F.coalesce(F.try_divide(F.col(f"c{i}") * 100.0, F.col("n")), F.lit(0.0)), 2)
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), share(i).alias("missing_percent")) for i, c in enumerate(columns)))
    return told.select(F.explode(rows).alias("x")).select("x.column_name", "x.missing_percent", (F.col("x.missing_percent") > 50).alias("warning"))


def violations(df: DataFrame, rules: dict[str, list[tuple[str, Violation]]] | None = None, key: str = "row_id") -> DataFrame:
    """column_name, rule, n_violations, first_key, first_value of every rule whose column is there: one pass."""
    checks = [(c, name, broken) for c, each in (RULES if rules is None else rules).items() if c in df.columns for name, broken in each]
    if not checks:
        return df.sparkSession.createDataFrame([], "column_name string, rule string, n_violations bigint, first_key bigint, first_value string")
    told = df.agg(*(F.struct(F.count_if(broken(F.col(c))).alias("n"), F.min(F.when(broken(F.col(c)), F.struct(F.col(key).cast("bigint").alias("key"), F.col(c).cast("string").alias("value")))).alias("first")).alias(f"c{i}") for i, (c, _, broken) in enumerate(checks)))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("rule"), F.col(f"c{i}.n").alias("n_violations"), F.col(f"c{i}.first.key").alias("first_key"), F.col(f"c{i}.first.value").alias("first_value")) for i, (c, name, _) in enumerate(checks)))
    return told.select(F.explode(rows).alias("x")).select("x.*")


def violating_rows(df: DataFrame, column: str, broken: Violation, key: str = "row_id") -> DataFrame:
    """The keys and values that break a rule, as a table: there may be many."""
    return df.where(broken(F.col(column))).select(key, F.col(column).cast("string").alias("value"))


def fits(kind: T.DataType, canonical: str) -> bool:
    """Whether a column of a Spark type can be a canonical field."""
    want = CANONICAL[canonical][0]
    if want == "float":
        return isinstance(kind, (T.NumericType, T.BooleanType))
    return isinstance(kind, (T.StringType, T.ArrayType))


@dataclass
class Check:
    validator: str
    status: str
    messages: list[str] = field(default_factory=list)


@dataclass
class ValidationResult:
    rows: int
    columns: int
    checks: list[Check]

    @property
    def is_valid(self) -> bool:
        return all(c.status not in ("FAILED", "ERROR") for c in self.checks)

    def report(self) -> str:
        lines = [f"rows: {self.rows}", f"columns: {self.columns}", f"valid: {self.is_valid}"]
        return "\n".join([*lines, *(f"{c.validator}: {c.status}" + "".join(f"\n  {m}" for m in c.messages) for c in self.checks)])


def validate(df: DataFrame, key: str = "row_id") -> ValidationResult:
    """All validators; a validator that breaks counts as ERROR and the others still run."""
    names = df.columns
    twice = [c for c, n in Counter(names).items() if n > 1]
    own = [f"c{i}" for i in range(len(names))]
    plain = df.toDF(*own)  # names may repeat
    told = plain.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in own)).first()
    n = told["n"]

    def types() -> list[str]:
        return [f"DATATYPE_MISMATCH: {c} is {f.dataType.simpleString()}" for c, o, f in zip(names, own, df.schema.fields, strict=True) if c in CANONICAL and told[o] and not fits(f.dataType, c)]

    def rules() -> list[str]:
        if twice:
            return []
        keyed = df if key in names else df.withColumn(key, F.monotonically_increasing_id())
        return [f"{r['column_name']} {r['rule']}: {r['n_violations']} rows, first {r['first_value']!r}" for r in violations(keyed, key=key).where("n_violations > 0").collect()]

    def missing() -> list[str]:
        return [f"{c}: {round(100 * (n - told[o]) / n, 2)} % missing" for c, o in zip(names, own, strict=True) if n and round(100 * (n - told[o]) / n, 2) > 50]

    plan = [
        ("required columns", "FAILED", lambda: [f"MISSING_REQUIRED_COLUMN: {c}" for c in MANDATORY if c not in names]),
        ("recommended columns", "WARNING", lambda: [text for c, text in RECOMMENDED.items() if c not in names]),
        ("duplicate columns", "FAILED", lambda: [f"DUPLICATE_COLUMN: {c}" for c in twice]),
        ("empty dataset", "FAILED", lambda: [] if n else ["EMPTY_DATASET"]),
        ("missing values", "WARNING", missing),
        ("types", "FAILED", types),
        ("rules", "FAILED", rules),
    ]
    checks = []
    for name, status, run in plan:
        try:
            found = run()
            checks.append(Check(name, status if found else "PASSED", found))
        except Exception as e:  # noqa: BLE001 - reported as the validator's result
            checks.append(Check(name, "ERROR", [str(e)]))
    return ValidationResult(n, len(names), checks)
