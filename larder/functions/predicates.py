"""Filter predicates as Column expressions.

Each operator name maps to a function ``(value, threshold, context) -> Column``.  A predicate is never null: a missing cell
counts as the value each operator defines for it, so AND, OR and NOT are two-valued.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Context:
    """What a predicate may need besides value and threshold."""

    dtype: T.DataType
    tolerance: float = 0.05
    now: dt.datetime | None = None


Predicate = Callable[[Column, Any, Context], Column]


class BadThreshold(ValueError):
    """A threshold that an operator can't take; found when the plan is made, not per row."""


def surely(condition: Column, default: bool = False) -> Column:
    return F.coalesce(condition, F.lit(default))


def as_number(value: Column, dtype: T.DataType) -> Column:
    """A double, null where the value isn't a number; NaN counts as missing."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(None).cast("double")
    number = value.cast("double") if isinstance(dtype, (T.NumericType, T.BooleanType)) else value.try_cast("double")
    return F.nanvl(number, F.lit(None).cast("double")) if not isinstance(dtype, (T.IntegralType, T.BooleanType)) else number


def _number(threshold: Any) -> float:
    try:
        return float(threshold)
    except (TypeError, ValueError) as e:
        raise BadThreshold(f"not a number: {threshold!r}") from e


def _pair(threshold: Any) -> tuple[Any, Any]:
    if not isinstance(threshold, (list, tuple)) or len(threshold) != 2:
        raise BadThreshold(f"not a pair: {threshold!r}")
    return threshold[0], threshold[1]


def _numeric(compare: Callable[[Column, Column], Column]) -> Predicate:
    return lambda v, t, c: surely(compare(as_number(v, c.dtype), F.lit(_number(t))))


def _not_equal(v: Column, t: Any, c: Context) -> Column:
    """A missing cell differs from any number, text that is no number doesn't."""
    return F.when(v.isNull(), True).otherwise(surely(as_number(v, c.dtype) != F.lit(_number(t)), isinstance(c.dtype, (T.FloatType, T.DoubleType))))


def _approximately(v: Column, t: Any, c: Context) -> Column:
    t = _number(t)
    return surely(F.abs(as_number(v, c.dtype) - F.lit(t)) <= F.lit(c.tolerance * abs(t)))


def _between(v: Column, t: Any, c: Context) -> Column:
    lo, hi = map(_number, _pair(t))
    return surely(as_number(v, c.dtype).between(F.lit(lo), F.lit(hi)))


def _outside(v: Column, t: Any, c: Context) -> Column:
    lo, hi = map(_number, _pair(t))
    n = as_number(v, c.dtype)
    return surely((n < F.lit(lo)) | (n > F.lit(hi)))


def as_text(v: Column) -> Column:
    """A missing cell compares as the text ``nan``."""
    return F.coalesce(v.cast("string"), F.lit("nan"))


def _text(test: Callable[[Column, Column], Column], lower: bool = False) -> Predicate:
    fold = F.lower if lower else lambda x: x
    return lambda v, t, c: test(fold(as_text(v)), fold(F.lit(str(t))))


def _regex(v: Column, t: Any, c: Context) -> Column:
    try:
        re.compile(t)
    except (re.error, TypeError):
        return F.lit(False)
    return F.rlike(as_text(v), F.lit(t))


def _listed(threshold: Any) -> list:
    return list(threshold) if isinstance(threshold, (list, tuple, set, frozenset)) else [threshold]


def as_list(v: Column, c: Context) -> Column:
    """The cell's elements; a scalar is a list of one."""
    return F.coalesce(v, F.array().cast(c.dtype)) if isinstance(c.dtype, T.ArrayType) else F.array(v)


def _literals(threshold: Any, c: Context) -> Column:
    kind = c.dtype.elementType if isinstance(c.dtype, T.ArrayType) else c.dtype
    return F.array(*(F.lit(x).cast(kind) for x in _listed(threshold))).cast(T.ArrayType(kind))


def _overlap(v: Column, t: Any, c: Context) -> Column:
    return surely(F.arrays_overlap(as_list(v, c), _literals(t, c)))


def _contains_all(v: Column, t: Any, c: Context) -> Column:
    return surely(F.size(F.array_except(_literals(t, c), as_list(v, c))) == 0)


def _subset(v: Column, t: Any, c: Context) -> Column:
    return surely(F.size(F.array_except(as_list(v, c), _literals(t, c))) == 0)


def _is_true(v: Column, t: Any, c: Context) -> Column:
    if isinstance(c.dtype, T.BooleanType):
        return surely(v)
    if isinstance(c.dtype, T.NumericType):
        return surely(v == 1)
    return surely(F.lower(v.cast("string")).isin("true", "1", "yes")) if isinstance(c.dtype, T.StringType) else F.lit(False)


def _is_null(v: Column, t: Any, c: Context) -> Column:
    return v.isNull() | F.isnan(v) if isinstance(c.dtype, (T.FloatType, T.DoubleType)) else v.isNull()


def _comparable(value: Any, dtype: T.DataType) -> bool:
    """Whether a threshold can equal a cell of this type at all."""
    if isinstance(dtype, T.StringType):
        return isinstance(value, str)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return isinstance(value, (bool, int, float))
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def _in(v: Column, t: Any, c: Context) -> Column:
    values = _listed(t)
    cell = v.cast("int") if isinstance(c.dtype, T.BooleanType) else v
    out = v.isNull() if None in values else F.lit(False)
    for x in values:
        if x is not None and _comparable(x, c.dtype):
            literal = F.lit(x) if isinstance(c.dtype, (T.NumericType, T.StringType)) else F.lit(int(x)) if isinstance(c.dtype, T.BooleanType) else _instant(x)
            out = out | surely(cell == literal)
    return out


def _instant(threshold: Any) -> Column:
    if isinstance(threshold, (dt.datetime, dt.date)):
        return F.lit(threshold.isoformat()).cast("timestamp_ntz")
    return F.lit(str(threshold)).try_cast("timestamp_ntz")


def as_instant(v: Column, c: Context) -> Column:
    return v.cast("timestamp_ntz") if isinstance(c.dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) else v.cast("string").try_cast("timestamp_ntz")


def _now(c: Context) -> dt.datetime:
    return c.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _days(threshold: Any) -> dt.timedelta:
    return dt.timedelta(days=_number(threshold))


def _between_dates(v: Column, t: Any, c: Context) -> Column:
    lo, hi = _pair(t)
    return surely(as_instant(v, c).between(_instant(lo), _instant(hi)))


#: operator -> predicate. ``exists`` and ``not_exists`` depend on the schema alone and are resolved by the filter engine.
PREDICATES: dict[str, Predicate] = {
    "==": _numeric(lambda v, t: v == t),
    "!=": _not_equal,
    ">": _numeric(lambda v, t: v > t),
    ">=": _numeric(lambda v, t: v >= t),
    "<": _numeric(lambda v, t: v < t),
    "<=": _numeric(lambda v, t: v <= t),
    "between": _between,
    "outside": _outside,
    "approximately_equal": _approximately,
    "contains": _text(F.contains),
    "icontains": _text(F.contains, lower=True),
    "startswith": _text(F.startswith),
    "endswith": _text(F.endswith),
    "exact": _text(lambda v, t: v == t),
    "regex": _regex,
    "list_contains": _overlap,
    "contains_any": _overlap,
    "contains_all": _contains_all,
    "overlap": _overlap,
    "subset": _subset,
    "superset": _contains_all,
    "is_true": _is_true,
    "is_false": lambda v, t, c: ~_is_true(v, t, c),
    "is_null": _is_null,
    "not_null": lambda v, t, c: ~_is_null(v, t, c),
    "in": _in,
    "not_in": lambda v, t, c: ~_in(v, t, c),
    "before": lambda v, t, c: surely(as_instant(v, c) < _instant(t)),
    "after": lambda v, t, c: surely(as_instant(v, c) > _instant(t)),
    "between_dates": _between_dates,
    "today": lambda v, t, c: surely(F.to_date(as_instant(v, c)) == F.lit(_now(c).date())),
    # no upper bound, and no lower bound below: future and past instants pass
    "last_days": lambda v, t, c: surely(as_instant(v, c) >= _instant(_now(c) - _days(t))),
    "next_days": lambda v, t, c: surely(as_instant(v, c) <= _instant(_now(c) + _days(t))),
}
SCHEMA_PREDICATES = ("exists", "not_exists")


def register(name: str, predicate: Predicate) -> None:
    """Add or replace an operator; a pandas UDF inside ``predicate`` serves what Column functions can't say."""
    PREDICATES[name] = predicate
