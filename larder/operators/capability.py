"""Capability profiling: which features a table's columns and values support, told by one aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import MANDATORY, RECOMMENDED


@dataclass(frozen=True)
class Capability:
    """columns must be there; of the values of a column at least one must occur (whole cells, any case)."""

    name: str
    category: str
    columns: tuple[str, ...]
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _item(name: str, *values: str) -> Capability:
    return Capability(f"{name} Recommendation", "Item Type", ("item_type",), {"item_type": values})


# The built-in capabilities.
DEFINITIONS = [
    Capability("Nutrition Search", "Nutrition", ("calories_per_serving", "protein_g_per_serving")),
    Capability("Calorie Filtering", "Nutrition", ("calories_per_serving",)),
    Capability("High Protein", "Nutrition", ("protein_g_per_serving",)),
    Capability("Low Calorie", "Nutrition", ("calories_per_serving",)),
    Capability("Low Carb", "Nutrition", ("carbs_g_per_serving",)),
    Capability("Budget Filtering", "Pricing", ("price",)),
    Capability("Dietary Labels", "Dietary", ("diet_labels",)),
    Capability("Keto Recommendation", "Dietary", ("diet_labels",), {"diet_labels": ("keto",)}),
    Capability("Vegan Recommendation", "Dietary", ("health_labels",), {"health_labels": ("vegan",)}),
    Capability("Allergen Filtering", "Dietary", ("cautions",)),
    Capability("Rating Ranking", "Rating & Popularity", ("rating",)),
    Capability("Popularity Ranking", "Rating & Popularity", ("popularity",)),
    Capability("Ingredient Search", "Menu Content", ("ingredients",)),
    Capability("Meal Type Filtering", "Menu Content", ("meal_type",)),
    Capability("Cuisine Filtering", "Menu Content", ("cuisine_type",)),
    Capability("Prep Time Filtering", "Menu Content", ("preparation_time_minutes",)),
    Capability("Availability Filtering", "Menu Content", ("availability",)),
    _item("Drink", "drink", "coffee", "smoothie", "juice"),
    _item("Dessert", "dessert"),
    _item("Appetizer", "appetizer"),
    _item("Soup", "soup"),
    _item("Salad", "salad"),
    _item("Main Course", "main_course"),
    Capability("Item Images", "Media", ("image_url",)),
]


class Registry:
    """Capabilities by name; a later one of the same name replaces the earlier."""

    def __init__(self, capabilities: list[Capability] | None = None):
        self._held = {c.name: c for c in (DEFINITIONS if capabilities is None else capabilities)}

    def register(self, capability: Capability) -> None:
        self._held[capability.name] = capability

    def unregister(self, name: str) -> None:
        self._held.pop(name, None)

    def get(self, name: str) -> Capability | None:
        return self._held.get(name)

    def by_category(self, category: str) -> list[Capability]:
        return [c for c in self._held.values() if c.category == category]

    def by_status(self, df: DataFrame) -> dict[str, list[str]]:
        """The names of this registry's capabilities that ``df`` has, has in part and lacks."""
        out: dict[str, list[str]] = {"ENABLED": [], "PARTIAL": [], "DISABLED": []}
        for r in detect(df, self).select("name", "status").collect():  # a row for each capability
            out[r["status"]].append(r["name"])
        return out

    def __iter__(self):
        return iter(self._held.values())

    def __len__(self) -> int:
        return len(self._held)


def detect(df: DataFrame, registry: Registry | None = None) -> DataFrame:
    """name, category, status (ENABLED, PARTIAL, DISABLED), reason of every capability."""
    registry = registry or Registry()
    rows, found = [], []
    for i, c in enumerate(registry):
        missing = [x for x in c.columns if x not in df.columns]
        if missing:
            status, reason = F.lit("DISABLED"), F.lit("missing columns: " + ", ".join(missing))
        elif c.values:
            test = [F.coalesce(F.max(F.lower(F.col(f"`{x}`").cast("string")).isin([v.lower() for v in values])), F.lit(False)) for x, values in c.values.items()]
            found.append(F.array(*test).alias(f"f{i}"))
            ok = F.forall(f"f{i}", lambda x: x)
            status = F.when(ok, "ENABLED").otherwise("PARTIAL")
            reason = F.when(ok, "").otherwise("missing values: " + ", ".join(v for values in c.values.values() for v in values))
        else:
            status, reason = F.lit("ENABLED"), F.lit("")
        rows.append(F.struct(F.lit(c.name).alias("name"), F.lit(c.category).alias("category"), status.alias("status"), reason.alias("reason")))
    told = df.agg(F.count("*").alias("n"), *found)
    return told.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def score(detected: DataFrame) -> DataFrame:
    """One row: enabled, partial, disabled, and the percentage enabled."""
    enabled = F.count_if(F.col("status") == "ENABLED")
    return detected.agg(enabled.alias("enabled"), F.count_if(F.col("status") == "PARTIAL").alias("partial"), F.count_if(F.col("status") == "DISABLED").alias("disabled"), F.round(100.0 * enabled / F.count("*"), 2).alias("score"))


def item_types(df: DataFrame) -> DataFrame:
    """item_type, n of every type there is: as a table, there may be many."""
    return df.where("item_type is not null").groupBy("item_type").agg(F.count("*").alias("n"))


#: Item types that a report names; it tells how many there are, and ``item_types`` has them all.
SHOWN_TYPES = 1000


def report(df: DataFrame, registry: Registry | None = None) -> dict:
    """What the table supports, with its item types and the columns it lacks."""
    detected = detect(df, registry)
    every = item_types(df) if "item_type" in df.columns else None
    types = [r[0] for r in every.orderBy("item_type").limit(SHOWN_TYPES).collect()] if every is not None else []
    return {
        "n_item_types": every.count() if every is not None else 0,
        "capabilities": [r.asDict() for r in detected.collect()],
        "score": score(detected).first()["score"],
        "item_types": types,
        "missing_mandatory": [c for c in MANDATORY if c not in df.columns],
        "warnings": [text for c, text in RECOMMENDED.items() if c not in df.columns],
    }
