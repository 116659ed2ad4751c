"""Computed metrics: virtual columns that rules and objectives may name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Metric = Callable[[DataFrame], Column]


def number(df: DataFrame, names: tuple[str, ...] | str, default: float) -> Column:
    """The first of these columns that the table has, as a double; the default if it has none. Missing cells stay null."""
    for name in (names,) if isinstance(names, str) else names:
        if name in df.columns:
            return F.col(f"`{name}`").try_cast("double") if isinstance(df.schema[name].dataType, T.StringType) else F.col(f"`{name}`").cast("double")
    return F.lit(float(default))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0, null where either is missing."""
    return F.when(b == 0, 0.0 * a).otherwise(a / b)


PROTEIN, CARBS, FAT, FIBER = (("protein_g_per_serving", "protein"), ("carbs_g_per_serving", "carbs"), ("fat_g_per_serving", "fat"), ("fiber_g_per_serving", "fiber"))
CALORIES = ("calories_per_serving", "calories")


def _share(of: tuple[str, ...]) -> Metric:
    return lambda df: ratio(number(df, of, 0), number(df, PROTEIN, 0) + number(df, CARBS, 0) + number(df, FAT, 0)) * 100


def _over(a: tuple[str, ...] | str, b: tuple[str, ...] | str) -> Metric:
    return lambda df: ratio(number(df, a, 0), number(df, b, 1))


def list_size(df: DataFrame, name: str) -> Column:
    """Elements of a list column; 0 where the cell or the list is missing or the column is text."""
    is_list = name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType)
    return F.coalesce(F.size(name), F.lit(0)) if is_list else F.lit(0)


METRICS: dict[str, Metric] = {
    "protein_to_calorie_ratio": _over(PROTEIN, CALORIES),
    "net_carbs": lambda df: number(df, CARBS, 0) - number(df, FIBER, 0),
    "fat_percentage": _share(FAT),
    "carb_percentage": _share(CARBS),
    "protein_percentage": _share(PROTEIN),
    "price_per_serving": _over("price", "servings"),
    "protein_per_dollar": _over(PROTEIN, "price"),
    "rating_per_price": _over("rating", "price"),
    "ingredient_count": lambda df: list_size(df, "ingredients"),
    "calories_per_100g": lambda df: ratio(number(df, CALORIES, 0), number(df, ("weight_g_per_serving", "weight_g"), 100)) * 100,
}


def register(name: str, metric: Metric) -> None:
    METRICS[name] = metric


def with_metrics(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with these metrics as columns; a physical column of the name wins."""
    return df.withColumns({n: METRICS[n](df) for n in names if n not in df.columns})
