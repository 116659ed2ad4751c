"""Multi-factor and multi-objective ranking.

Normalisers see the whole result set.  Their minimum, maximum, mean and deviation are taken by one aggregation, whose single row is
joined back; order and diversity of a full table are numbered range by range, so that no window holds the table or a large category.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import METRICS, number, ratio
from .order import numbered

Scorer = Callable[[DataFrame, Mapping[str, Any]], Column]


def _cell(df: DataFrame, names: tuple[str, ...], default: float) -> Column:
    """The first column that is there, a missing cell as the default; the default if none is."""
    return F.coalesce(number(df, names, default), F.lit(float(default)))


def _nutrition(df: DataFrame, p: Mapping[str, Any]) -> Column:
    target = float(p.get("target", 500))
    return 1 / (1 + F.abs(_cell(df, ("calories_per_serving", "calories"), target) - target))


def truthy(df: DataFrame, name: str) -> Column:
    """1 where the cell holds something: not null, not blank, not empty, not zero."""
    if name not in df.columns:
        return F.lit(0)
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    test = c != "" if isinstance(kind, T.StringType) else F.size(c) > 0 if isinstance(kind, T.ArrayType) else c if isinstance(kind, T.BooleanType) else c != 0 if isinstance(kind, T.NumericType) else c.isNotNull()
    return F.coalesce(test, F.lit(False)).cast("int")


def _metadata(df: DataFrame, p: Mapping[str, Any]) -> Column:
    keys = p.get("keys", ["image_url", "description", "ingredients"])
    return sum((truthy(df, k) for k in keys), F.lit(0)) / len(keys) if keys else F.lit(1.0)


def category(df: DataFrame, name: str | None) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("unknown")) if name in df.columns else F.lit("unknown")


#: The column that tells how many rows a row's category has, where :func:`counted` has put it.
CATEGORY_ROWS = "__category_rows"


def counted(df: DataFrame, column: str | None) -> DataFrame:
    """``df`` with the number of rows of each row's category: counted in each task first, then joined, so that a large category is dealt over tasks."""
    own = df.withColumn("__category", category(df, column))
    sizes = own.groupBy("__category").agg(F.count("*").alias(CATEGORY_ROWS))
    return own.join(sizes, own["__category"].eqNullSafe(sizes["__category"]), "left").select(*(own[f"`{c}`"] for c in df.columns), CATEGORY_ROWS)


def _diversity(df: DataFrame, p: Mapping[str, Any]) -> Column:
    rows = F.col(CATEGORY_ROWS) if CATEGORY_ROWS in df.columns else F.count("*").over(Window.partitionBy(category(df, p.get("column", "category"))))
    return 1 / rows


SCORERS: dict[str, Scorer] = {
    "SemanticScore": lambda df, p: _cell(df, ("semantic_similarity",), 0),
    "SoftRuleScore": lambda df, p: _cell(df, ("soft_score",), 0),
    "NutritionScore": _nutrition,
    "RatingScore": lambda df, p: _cell(df, ("rating",), 3),
    "PopularityScore": lambda df, p: _cell(df, ("order_count", "popularity"), 0),
    "PriceScore": lambda df, p: _cell(df, ("price",), 0),
    "FreshnessScore": lambda df, p: _cell(df, ("days_since_added", "age_days"), 100),
    "MetadataScore": _metadata,
    "PenaltyScore": lambda df, p: _cell(df, (p.get("key", "delivery_fee"),), 0),
    "DiversityScore": _diversity,
}

#: Columns a scorer needs unless its factor names one: without them the factor is dropped and its weight spread over the rest.
REQUIRED = {"RatingScore": "rating", "PriceScore": "price", "NutritionScore": "calories_per_serving", "PopularityScore": "popularity"}


#: Scorers that need more than a row's own columns: function (table, parameters) -> the table with them.
PREPARED: dict[str, Callable[[DataFrame, Mapping[str, Any]], DataFrame]] = {"DiversityScore": lambda df, p: counted(df, p.get("column", "category"))}


def register_scorer(name: str, scorer: Scorer) -> None:
    SCORERS[name] = scorer


def scorer(name: str) -> Scorer:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {sorted(SCORERS)}")
    return SCORERS[name]


@dataclass(frozen=True)
class Factor:
    scorer: str
    weight: float = 1.0
    normalisation: str = "min_max"
    invert: bool = False
    enabled: bool = True
    priority: int = 0
    required_column: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)
    custom: Callable[[Column], Column] | None = None
    label: str | None = None

    @property
    def name(self) -> str:
        return self.label or self.scorer


@dataclass(frozen=True)
class Objective:
    """type: numeric, categorical, boolean or computed; direction: maximize or minimize."""

    name: str
    type: str = "numeric"
    weight: float = 1.0
    direction: str = "maximize"
    target: Any = None
    normalisation: str = "min_max"
    enabled: bool = True
    column: str | None = None

    @classmethod
    def of(cls, d: Mapping[str, Any]) -> Objective:
        """From a dict. ``maximize`` and ``minimize`` flags may stand for the direction; an unknown type counts as numeric."""
        d = dict(d)
        up, down = d.pop("maximize", None), d.pop("minimize", None)
        if up is not None or down is not None:
            d["direction"] = "maximize" if (up if up is not None else not down) else "minimize"
        if d.get("type") not in ("numeric", "categorical", "boolean", "computed"):
            d["type"] = "numeric"
        return cls(**d)


@dataclass(frozen=True)
class Config:
    factors: tuple[Factor, ...] = ()
    objectives: tuple[Objective, ...] = ()
    strategy: str = "weighted"
    optimizer: str = "weighted_sum"
    diversity_column: str | None = None
    diversity_weight: float = 0.0
    max_results: int | None = None

    def __post_init__(self) -> None:
        if self.diversity_weight < 0:
            raise ValueError("diversity_weight must not be negative")

    @classmethod
    def of(cls, d: Mapping[str, Any]) -> Config:
        d = dict(d)
        return cls(**d | {"factors": tuple(Factor(**f) for f in d.get("factors", ())), "objectives": tuple(Objective.of(o) for o in d.get("objectives", ()))})

    @classmethod
    def load(cls, path: str) -> Config:
        """From a JSON or YAML file."""
        with open(path) as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.of(yaml.safe_load(text))
        return cls.of(json.loads(text))


#: Normaliser -> expression of a score x and its set's statistics s (fields low, high, mean, sd, n).
NORMALISERS: dict[str, Callable[[Column, Callable[[str], Column]], Column]] = {
    "min_max": lambda x, s: F.when(s("high") > s("low"), (x - s("low")) / (s("high") - s("low"))).otherwise(F.when(s("low") > 0, 1.0).otherwise(0.5)),
    "z_score": lambda x, s: F.when((s("n") < 2) | (F.coalesce(s("sd"), F.lit(0.0)) == 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - s("mean")) / s("sd") + 3) / 6))),
    "identity": lambda x, s: x,
}


def normalised(df: DataFrame, how: Mapping[str, tuple[str, bool] | tuple[str, bool, Callable | None]]) -> DataFrame:
    """``df`` with norm_<c> for each column c of ``how``: (normaliser, invert). Statistics come from one aggregation."""
    stats = df.agg(*(x for c in how for x in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"), F.count(c).alias(f"n_{c}"))))
    joined = df.join(F.broadcast(stats))  # a single row
    made = {}
    for c, (name, invert, *custom) in how.items():
        value = custom[0](F.col(c)) if custom and custom[0] else NORMALISERS.get(name, NORMALISERS["identity"])(F.col(c), lambda k, c=c: F.col(f"{k}_{c}"))
        made[f"norm_{c}"] = 1 - value if invert else value
    return joined.withColumns(made).drop(*stats.columns)


def active_factors(df: DataFrame, factors: tuple[Factor, ...], linear: bool = False) -> list[Factor]:
    """Enabled factors by descending priority whose required column is there, with weights that sum to 1."""
    kept = []
    for f in sorted((f for f in factors if f.enabled), key=lambda f: -f.priority):
        needs = REQUIRED.get(f.scorer) if linear or f.required_column is None else f.required_column
        if needs is None or needs in df.columns:
            kept.append(f)
    weights = [1.0 if linear else f.weight for f in kept]
    total = sum(weights)
    return [Factor(**{**f.__dict__, "weight": w / total if total else 0.0}) for f, w in zip(kept, weights, strict=True)]


def _distinct(names: list[str]) -> list[str]:
    """The names, repeated ones with a number: they are keys of a map."""
    return [n if n not in names[:i] else f"{n}_{names[:i].count(n) + 1}" for i, n in enumerate(names)]


def rank_factors(df: DataFrame, factors: tuple[Factor, ...], linear: bool = False) -> DataFrame:
    """``df`` with final_score and maps raw, normalised and contribution by factor. An unknown scorer keeps its weight but adds nothing."""
    known = [(f"__f{i}", f) for i, f in enumerate(active_factors(df, factors, linear)) if f.scorer in SCORERS]
    if not known:
        empty = F.create_map().cast("map<string,double>")
        return df.withColumns({"final_score": F.lit(0.0), "raw": empty, "normalised": empty, "contribution": empty})
    scored = df
    for c, f in known:
        ready = PREPARED[f.scorer](scored, f.params) if f.scorer in PREPARED else scored
        scored = ready.withColumn(c, SCORERS[f.scorer](ready, f.params).cast("double")).select(*scored.columns, c)
    told = normalised(scored, {c: (f.normalisation, f.invert, f.custom) for c, f in known})
    names = _distinct([f.name for _, f in known])
    of = lambda e: F.create_map(*(x for n, (c, f) in zip(names, known, strict=True) for x in (F.lit(n), e(c, f))))
    total = sum((F.col(f"norm_{c}") * f.weight for c, f in known), F.lit(0.0))
    return told.withColumns({"final_score": total, "raw": of(lambda c, f: F.col(c)), "normalised": of(lambda c, f: F.col(f"norm_{c}")), "contribution": of(lambda c, f: F.col(f"norm_{c}") * f.weight)}).drop(*(x for c, _ in known for x in (c, f"norm_{c}")))


COMPUTED: dict[str, Callable[[DataFrame], Column]] = {
    "protein_per_dollar": lambda df: ratio(number(df, ("protein", "protein_g_per_serving"), 0), number(df, "price", 1)),
    "calories_per_100g": METRICS["calories_per_100g"],
    "protein_density": lambda df: ratio(number(df, ("protein", "protein_g_per_serving"), 0), number(df, ("weight_g", "weight_g_per_serving"), 1)),
    "customer_value_score": lambda df: ratio(number(df, "rating", 3), number(df, "price", 1)),
    "restaurant_margin_score": lambda df: number(df, "price", 0) - number(df, "cost", 0),
    "nutrition_score": lambda df: ratio(number(df, ("protein", "protein_g_per_serving"), 0) + number(df, ("fiber", "fiber_g_per_serving"), 0), number(df, ("calories", "calories_per_serving"), 500)) * 100,
}


def objective_value(df: DataFrame, o: Objective) -> Column:
    """An objective's raw value, never null."""
    name = o.column or o.name
    there = name in df.columns
    if o.type == "categorical":
        wanted = list(o.target) if isinstance(o.target, (list, tuple, set)) else [o.target]
        if there and isinstance(df.schema[name].dataType, T.ArrayType):  # a target in the list
            value = F.coalesce(F.arrays_overlap(F.col(f"`{name}`"), F.array(*map(F.lit, wanted))), F.lit(False)).cast("double")
        else:
            value = F.coalesce(F.col(f"`{name}`").isin(wanted), F.lit(False)).cast("double") if there else F.lit(0.0)
    elif o.type == "boolean":
        kind = df.schema[name].dataType if there else None
        c = F.col(f"`{name}`") if there else None
        true = F.lit(False) if c is None else c if isinstance(kind, T.BooleanType) else F.lower(c.cast("string")).isin("true", "1", "yes")
        value = (F.coalesce(true, F.lit(False)) == F.lit(True if o.target is None else bool(o.target))).cast("double")
    elif o.type == "computed":
        value = COMPUTED[o.name](df) if o.name in COMPUTED else number(df, name, 0)
    else:
        value = number(df, name, 0)
        if o.target is not None:
            value = 1 / (1 + F.abs(F.coalesce(value, F.lit(0.0)) - float(o.target)))
    return F.coalesce(value, F.lit(0.0)).cast("double")


def rank_objectives(df: DataFrame, objectives: tuple[Objective, ...]) -> DataFrame:
    """``df`` with final_score, the sum of normalised objectives times their weights, which are taken as given."""
    live = [(f"__o{i}", o) for i, o in enumerate(objectives) if o.enabled]
    empty = F.create_map().cast("map<string,double>")
    if not live:
        return df.withColumns({"final_score": F.lit(0.0), "raw": empty, "normalised": empty, "contribution": empty})
    told = normalised(df.withColumns({c: objective_value(df, o) for c, o in live}), {c: (o.normalisation, o.direction == "minimize") for c, o in live})
    names = _distinct([o.name for _, o in live])
    of = lambda e: F.create_map(*(x for n, (c, o) in zip(names, live, strict=True) for x in (F.lit(n), e(c, o))))
    total = sum((F.col(f"norm_{c}") * o.weight for c, o in live), F.lit(0.0))
    return told.withColumns({"final_score": total, "raw": of(lambda c, o: F.col(c)), "normalised": of(lambda c, o: F.col(f"norm_{c}")), "contribution": of(lambda c, o: F.col(f"norm_{c}") * o.weight)}).drop(*(x for c, _ in live for x in (c, f"norm_{c}")))


def conflicts(df: DataFrame, objectives: tuple[Objective, ...], limit: float = 0.2) -> DataFrame:
    """one, two, correlation, label of objective pairs that pull against each other: one aggregation for all pairs."""
    live = [o for o in objectives if o.enabled]
    scored = df.select(*(objective_value(df, o).alias(f"__o{i}") for i, o in enumerate(live)))
    pairs = [(i, j) for i in range(len(live)) for j in range(i + 1, len(live))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "one string, two string, correlation double, label string")
    flat = lambda i: F.coalesce(F.stddev_samp(f"__o{i}"), F.lit(0.0)) == 0
    told = scored.agg(
        F.array(
            *(
                F.struct(
                    F.lit(live[i].name).alias("one"),
                    F.lit(live[j].name).alias("two"),
                    F.when(flat(i) | flat(j), F.lit(None).cast("double")).otherwise(F.corr(f"__o{i}", f"__o{j}")).alias("correlation"),
                    F.lit(live[i].direction == live[j].direction).alias("same"),
                )
                for i, j in pairs
            )
        ).alias("pairs")
    )
    row = told.select(F.explode("pairs").alias("p")).select("p.*")
    hit = F.when(F.col("same"), F.col("correlation") < -limit).otherwise(F.col("correlation") > limit)
    label = F.concat(F.col("one"), F.lit(" vs "), F.col("two"), F.lit(" (Correlation: "), F.format_string("%+.2f", "correlation"), F.lit(")"))
    return row.where(hit).select("one", "two", "correlation", label.alias("label"))


#: Rows of a category that each task keeps at most where only so many results are wanted.
MOST_KEPT = 1000


def diversify(df: DataFrame, column: str | None, weight: float, base: list[Column], score: str = "final_score", most: int | None = None) -> DataFrame:
    """adjusted_score: the score less ``weight`` for every better row of the same category.

    Equal to the greedy choice that lowers a category's rows each time one is taken, for weights of 0 and more.  With ``most`` only rows that can be
    among so many best are kept: each task keeps as many of a category.  Without it a category of any size is numbered range by range.
    """
    if most is not None and most <= MOST_KEPT:
        w = Window.partitionBy(category(df, column)).orderBy(F.desc(score), *base)
        placed = df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= most)
    else:
        placed = numbered(df.withColumn("__category", category(df, column)), [F.desc(score), *base], by=["__category"], out="__nth").drop("__category")
    return placed.withColumn("adjusted_score", F.col(score) - float(weight) * (F.col("__nth") - 1)).drop("__nth")


#: strategy or optimizer -> function (df, config) -> scored rows. Names without an own method are weighted sums, as a baseline.
STRATEGIES: dict[str, Callable[[DataFrame, Config], DataFrame]] = {
    "weighted": lambda df, c: rank_factors(df, c.factors),
    "linear": lambda df, c: rank_factors(df, c.factors, linear=True),
    "ml": lambda df, c: rank_factors(df, c.factors),
    "hybrid": lambda df, c: rank_factors(df, c.factors),
}
OPTIMIZERS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {name: (lambda df, c: rank_objectives(df, c.objectives)) for name in ("weighted_sum", "pareto", "topsis", "promethee", "electre", "learning_to_rank")}


def register_strategy(name: str, strategy: Callable[[DataFrame, Config], DataFrame]) -> None:
    STRATEGIES[name.lower()] = strategy


def register_optimizer(name: str, optimizer: Callable[[DataFrame, Config], DataFrame]) -> None:
    OPTIMIZERS[name.lower()] = optimizer


def _of(table: Mapping[str, Callable], name: str, what: str) -> Callable:
    if name.lower() not in table:
        raise ValueError(f"unknown {what} {name!r}; known: {sorted(table)}")
    return table[name.lower()]


def rank(df: DataFrame, config: Config, order: str = "row_id") -> DataFrame:
    """``df`` scored, ordered and cut: adds rank, final_score (adjusted for diversity where asked), raw, normalised, contribution.

    Ties keep the order of the column ``order``.
    """
    scored = _of(OPTIMIZERS, config.optimizer, "optimizer")(df, config) if config.objectives else _of(STRATEGIES, config.strategy, "strategy")(df, config)
    base = [F.asc(order)]
    if config.diversity_weight:  # without a column all rows are one group
        scored = diversify(scored, config.diversity_column, config.diversity_weight, base, most=config.max_results).withColumn("penalty", F.col("final_score") - F.col("adjusted_score")).withColumn("final_score", F.col("adjusted_score")).drop("adjusted_score")
    by = [F.desc("final_score"), *base]
    if config.max_results:
        top = scored.orderBy(*by).limit(config.max_results)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*by)))  # max_results rows
    return numbered(scored, by)


def statistics(ranked: DataFrame) -> DataFrame:
    """One row: n, top and average score, and the average raw value of each factor."""
    return ranked.agg(F.count("*").alias("n"), F.max("final_score").alias("top_score"), F.round(F.avg("final_score"), 6).alias("avg_score"))


def factor_averages(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.explode("raw").alias("factor", "value")).groupBy("factor").agg(F.round(F.avg("value"), 6).alias("avg_raw"))


def breakdown(ranked: DataFrame, key: str = "row_id") -> DataFrame:
    """key, breakdown (contributions to 4 places under lower-case names) and final_score."""
    rounded = F.map_from_entries(F.transform(F.map_entries("contribution"), lambda e: F.struct(F.lower(e["key"]), F.round(e["value"], 4))))
    return ranked.select(key, rounded.alias("breakdown"), F.round("final_score", 4).alias("final_score"))


def explained(ranked: DataFrame, key: str = "row_id", drivers: int = 2) -> DataFrame:
    """key, rank, explanation: the largest contributions, in order."""
    entries = F.transform(F.map_entries("contribution"), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key")))
    top = F.slice(F.sort_array(entries, asc=False), 1, drivers)
    return ranked.select(key, "rank", F.array_join(F.transform(top, lambda e: F.concat(e["key"], F.lit(" "), F.format_string("%+.4f", e["value"]))), ", ").alias("explanation"))


def explanations(ranked: DataFrame, config: Config, conflict_table: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """key, rank, text: the score, each factor or objective by its contribution with raw value and weight, the set's conflicts, the diversity penalty.

    conflict_table: what ``conflicts`` tells of the same set; it has a row for each pair of objectives at most.
    """
    live = config.objectives or active_factors(ranked, config.factors, linear=config.strategy == "linear")
    weights = dict(zip(_distinct([x.name for x in live]), (float(x.weight) for x in live), strict=True))
    told = F.create_map(*(x for n, w in weights.items() for x in (F.lit(n), F.lit(w)))) if weights else F.create_map().cast("map<string,double>")
    entries = F.array_sort(F.transform(F.map_entries("contribution"), lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("name"))))
    line = lambda e: F.concat(F.format_string("%+.4f ", F.element_at("contribution", e["name"])), e["name"], F.format_string(" (value %.2f, scaled %.2f, weight %.2f)", F.element_at("raw", e["name"]), F.element_at("normalised", e["name"]), F.element_at(told, e["name"])))
    parts = [F.format_string("score %.4f", "final_score"), F.array_join(F.transform(entries, line), "\n")]
    out = ranked
    if conflict_table is not None:
        rows = conflict_table.agg(F.array_join(F.transform(F.array_sort(F.collect_list("label")), lambda x: F.concat(F.lit("conflict: "), x)), "\n").alias("__conflicts"))  # one row
        out = out.join(F.broadcast(rows))
        parts.append(F.when(F.col("__conflicts") != "", F.col("__conflicts")))
    if "penalty" in ranked.columns:
        parts.append(F.when(F.col("penalty") > 0, F.format_string("diversity -%.4f", "penalty")))
    return out.select(key, "rank", F.concat_ws("\n", *parts).alias("text"))


def report(ranked: DataFrame, config: Config, conflict_table: DataFrame | None = None, key: str = "row_id", shown: int = 10) -> str:
    """A ranking as text: strategy, averages, conflicts and the first rows with their two largest drivers. A few rows come to the driver."""
    facts = statistics(ranked).first()
    how = f"objectives by {config.optimizer}" if config.objectives else f"factors by {config.strategy}"
    lines = [f"ranking of {facts['n']} rows, {how}", f"score: best {facts['top_score'] or 0:.4f}, mean {facts['avg_score'] or 0:.4f}"]
    for x in config.objectives or config.factors:
        if x.enabled:
            lines.append(f"  {x.name}: weight {x.weight:.2f}" + (f", {x.direction}" if config.objectives else ""))
    lines += [f"  mean {r['factor']}: {r['avg_raw']:.2f}" for r in factor_averages(ranked).orderBy("factor").collect()]
    if conflict_table is not None:
        lines += [f"conflict: {r['label']}" for r in conflict_table.orderBy("label").collect()]
    first = explained(ranked.where(F.col("rank") <= shown), key).join(ranked.where(F.col("rank") <= shown).select(key, "final_score"), key)
    lines += [f"{r['rank']}. {r[key]}: {r['final_score']:.4f} ({r['explanation']})" for r in first.orderBy("rank").collect()]
    return "\n".join(lines)
