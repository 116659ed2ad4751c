"""Declarative hard and soft rules, compiled to Column trees.

HARD rules (flat ones by priority, then groups) decide ``hard_passed``; SOFT rules score what passed.  All is decided row by row in
one projection: nothing is shuffled or collected, and a HARD rule on a plain column reaches the scan as a pushed filter when
``passed`` is asked for.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.metrics import METRICS


@dataclass(frozen=True)
class Rule:
    """One condition. HARD rules exclude rows, SOFT rules add reward * weight or penalty * weight to the row's score."""

    column: str
    operator: str
    value: Any = None
    rule_type: str = "HARD"
    priority: int = 0
    weight: float = 1.0
    reward: float = 1.0
    penalty: float = 0.0
    tolerance: float = 0.05
    required_column: str | None = None
    enabled: bool = True
    description: str = ""

    def __post_init__(self) -> None:
        if self.rule_type not in ("HARD", "SOFT"):
            raise ValueError(f"rule_type must be HARD or SOFT, not {self.rule_type!r}")
        if not self.column:
            raise ValueError("a rule needs a column")
        if not 0 <= self.tolerance <= 1:
            raise ValueError("tolerance must lie in [0, 1]")

    def label(self) -> str:
        return f"{self.column} {self.operator} {self.value}"


@dataclass(frozen=True)
class Group:
    """A nested AND or OR of rules and groups."""

    operator: str
    rules: tuple[Rule | Group, ...] = ()
    enabled: bool = True
    description: str = ""

    def __post_init__(self) -> None:
        if self.operator not in ("AND", "OR"):
            raise ValueError(f"a group is AND or OR, not {self.operator!r}")


@dataclass(frozen=True)
class Config:
    skip_missing_columns: bool = True
    stop_on_hard_fail: bool = True
    strict: bool = False
    """Strict: a missing column fails its rule instead of passing it."""
    now: dt.datetime | None = None


@dataclass
class Compiled:
    """The rules as columns, in evaluation order, and what was skipped."""

    hard: list[tuple[Rule, Column]] = field(default_factory=list)
    groups: list[tuple[Group, Column]] = field(default_factory=list)
    soft: list[tuple[Rule, Column]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def _value(df: DataFrame, rule: Rule) -> tuple[Column, Any] | None:
    if rule.column in df.columns:
        return F.col(f"`{rule.column}`"), df.schema[rule.column].dataType
    if rule.column in METRICS:
        metric = METRICS[rule.column](df)
        return metric, df.select(metric.alias("m")).schema["m"].dataType
    return None


def compile_rule(df: DataFrame, rule: Rule, config: Config, warnings: list[str]) -> Column:
    """The rule as a non-null boolean column. A rule that can't be told is skipped, which passes (or fails if strict)."""

    def skipped(why: str) -> Column:
        if not config.skip_missing_columns:
            raise ValueError(why)
        warnings.append(why)
        return F.lit(not config.strict)

    value = _value(df, rule)
    if rule.operator in P.SCHEMA_PREDICATES:
        return F.lit((value is not None) == (rule.operator == "exists"))
    if value is None:
        return skipped(f"no column {rule.column!r}")
    if rule.operator not in P.PREDICATES:
        return skipped(f"no operator {rule.operator!r}")
    try:
        return P.PREDICATES[rule.operator](value[0], rule.value, P.Context(value[1], rule.tolerance, config.now))
    except P.BadThreshold as e:
        if rule.operator in ("between", "outside", "between_dates"):
            return F.lit(False)
        return skipped(f"{rule.label()}: {e}")


def compile_group(df: DataFrame, group: Group, config: Config, warnings: list[str]) -> Column:
    parts = [compile_group(df, x, config, warnings) if isinstance(x, Group) else compile_rule(df, x, config, warnings) for x in group.rules if x.enabled]
    if not parts:
        return F.lit(True)
    return reduce(lambda a, b: a & b if group.operator == "AND" else a | b, parts)


def compile_rules(df: DataFrame, rules: list[Rule | Group], config: Config | None = None) -> Compiled:
    """Rules as columns. A top-level rule on a column that is neither there nor a metric is dropped with a warning."""
    config, out = config or Config(), Compiled()
    there = set(df.columns) | set(METRICS)
    flat = []
    for r in rules:
        if isinstance(r, Group):
            if r.enabled:
                out.groups.append((r, compile_group(df, r, config, out.warnings)))
        elif r.enabled and (r.required_column or r.column) not in there and not config.strict:
            out.warnings.append(f"rule dropped, no column {r.required_column or r.column!r}")
        elif r.enabled:
            flat.append(r)
    for r in sorted(flat, key=lambda r: r.priority):
        (out.hard if r.rule_type == "HARD" else out.soft).append((r, compile_rule(df, r, config, out.warnings)))
    return out


def _labels(pairs: list[tuple[Column, str]]) -> Column:
    """The labels whose condition holds, in order."""
    if not pairs:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in pairs)))


def apply_rules(df: DataFrame, rules: list[Rule | Group], config: Config | None = None) -> DataFrame:
    """``df`` with hard_passed, rejection_reason, matched_rules, failed_rules, soft_score and rule_explanations.

    With stop_on_hard_fail, rules after the first failed one count as not evaluated.
    """
    config = config or Config()
    c = compile_rules(df, rules, config)
    # each predicate once, under a name of its own
    names = {id(p): f"__rule_{i}" for i, (_, p) in enumerate([*c.hard, *c.groups, *c.soft])}
    at = lambda p: F.col(names[id(p)])
    df0 = df.withColumns({names[id(p)]: p for _, p in [*c.hard, *c.groups, *c.soft]}) if names else df
    flat = reduce(lambda a, b: a & b, (at(p) for _, p in c.hard), F.lit(True))
    passed = reduce(lambda a, b: a & b, (at(p) for _, p in c.groups), flat)
    reason = [F.when(~at(p), F.lit(f"Hard rule failed: {r.label()}")) for r, p in c.hard]
    reason += [F.when(flat & ~at(p), F.lit(f"Hard group failed: {g.description or g.operator}")) for g, p in c.groups]
    seen, before = [], F.lit(True)
    for r, p in c.hard:
        seen.append((r, at(p), before))
        before = (before & at(p)) if config.stop_on_hard_fail else before
    soft = [(r, at(p), passed) for r, p in c.soft]
    score = reduce(lambda a, b: a + b, (F.when(p, r.reward * r.weight).otherwise(r.penalty * r.weight) for r, p, _ in soft), F.lit(0.0))
    explained = [
        F.when(
            ev,
            F.struct(
                F.lit(r.column).alias("column"),
                F.lit(r.operator).alias("operator"),
                F.lit(str(r.value)).alias("threshold"),
                F.lit(r.rule_type).alias("rule_type"),
                p.alias("passed"),
                F.lit(float(r.weight)).alias("weight"),
                (F.when(p, r.reward * r.weight).otherwise(r.penalty * r.weight) if r.rule_type == "SOFT" else F.lit(0.0)).cast("double").alias("contribution"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.description).alias("description"),
            ),
        )
        for r, p, ev in [*seen, *soft]
    ]
    out = df0.withColumns(
        {
            "hard_passed": passed,
            "rejection_reason": F.coalesce(*reason, F.lit(None).cast("string")) if reason else F.lit(None).cast("string"),
            "matched_rules": _labels([(p & ev, r.column) for r, p, ev in [*seen, *soft]]),
            "failed_rules": _labels([(~p & ev, r.column) for r, p, ev in [*seen, *soft]]),
            "soft_score": F.when(passed, score).otherwise(0.0),
            "rule_explanations": F.array_compact(F.array(*explained)) if explained else F.array().cast("array<struct<column:string,operator:string,threshold:string,rule_type:string,passed:boolean,weight:double,contribution:double,priority:int,description:string>>"),
        }
    )
    return out.drop(*names.values())


def passed(df: DataFrame, rules: list[Rule | Group], config: Config | None = None) -> DataFrame:
    """The rows of ``df`` that all HARD rules and groups pass, as a plain filter that Catalyst can push to the scan."""
    c = compile_rules(df, rules, config)
    return df.where(reduce(lambda a, b: a & b, (p for _, p in [*c.hard, *c.groups]), F.lit(True)))


def rejected(filtered: DataFrame) -> DataFrame:
    return filtered.where(~F.col("hard_passed"))


def hard_breakdown(filtered: DataFrame) -> DataFrame:
    """Failures for each column of the HARD rules: rule_column, n_failed."""
    failed = filtered.select(F.explode(F.filter("rule_explanations", lambda x: (x["rule_type"] == "HARD") & ~x["passed"])).alias("x"))
    return failed.groupBy(F.col("x.column").alias("rule_column")).agg(F.count("*").alias("n_failed"))


def soft_breakdown(filtered: DataFrame) -> DataFrame:
    """For each column of the SOFT rules: rule_column, rewarded, penalised, total_delta."""
    soft = filtered.where("hard_passed").select(F.explode(F.filter("rule_explanations", lambda x: x["rule_type"] == "SOFT")).alias("x"))
    return soft.groupBy(F.col("x.column").alias("rule_column")).agg(F.count_if(F.col("x.passed")).alias("rewarded"), F.count_if(~F.col("x.passed")).alias("penalised"), F.round(F.sum("x.contribution"), 4).alias("total_delta"))


def statistics(filtered: DataFrame) -> DataFrame:
    """One row: n_in, n_passed, n_rejected and average, largest and smallest soft score of what passed."""
    score = F.when(F.col("hard_passed"), F.col("soft_score"))
    return filtered.agg(
        F.count("*").alias("n_in"),
        F.count_if("hard_passed").alias("n_passed"),
        F.count_if(~F.col("hard_passed")).alias("n_rejected"),
        F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("avg_soft"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("max_soft"),
        F.coalesce(F.min(score), F.lit(0.0)).alias("min_soft"),
    )


def candidate_scores(filtered: DataFrame, key: str = "row_id") -> DataFrame:
    return filtered.where("hard_passed").select(key, "soft_score")


def as_json(filtered: DataFrame) -> DataFrame:
    """Each row as one JSON document, explanations included."""
    return filtered.select(F.to_json(F.struct("*")).alias("json"))
