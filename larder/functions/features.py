"""Feature derivation: engineers, each a set of Column expressions over canonical columns.

An engineer whose required column is missing is skipped; one that fails is reported and the rest go on.  All features are one
projection, so Catalyst shares what they have in common.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import list_size


@dataclass(frozen=True)
class Settings:
    high_protein_ratio: float = 0.20
    low_carb_ratio: float = 0.30
    low_fat_ratio: float = 0.30
    low_sodium_mg: float = 140.0
    high_fiber_g: float = 5.0
    low_calorie: float = 150.0
    high_protein_g: float = 15.0
    keto_carbs_g: float = 20.0
    price_edges: tuple[float, ...] = (10.0, 25.0)


# Weights of the nutrition score, price labels, keyword lists.
SCORE_WEIGHTS = {"fiber_g_per_serving": 2.0, "protein_g_per_serving": 1.0, "sodium_mg_per_serving": -0.05, "sugar_g_per_serving": -1.0, "saturated_fat_g_per_serving": -2.0}
PRICE_LABELS = {"budget_category": ("budget", "mid-range", "premium"), "price_level": ("$", "$$", "$$$"), "price_bucket": ("<=$10", "$10-$25", ">$25")}
MEAT = ["meat", "chicken", "pork", "beef", "fish", "lamb", "duck", "turkey", "seafood", "shrimp", "crab", "lobster", "lard"]
ANIMAL = ["meat", "chicken", "pork", "beef", "fish", "egg", "milk", "cheese", "butter", "cream", "yogurt", "honey", "lamb", "duck", "turkey", "seafood", "shrimp", "crab", "lobster", "gelatin", "lard"]
GLUTEN = ["wheat", "barley", "rye", "flour", "semolina", "spelt", "pasta", "bread"]
DAIRY = ["milk", "cheese", "butter", "cream", "yogurt", "whey", "casein", "ghee"]
HARAM = ["pork", "lard", "alcohol", "wine", "beer", "gelatin", "bacon"]
MEALS = {
    "is_breakfast": {"meal_type": ["breakfast", "morning", "brunch"]},
    "is_lunch": {"meal_type": ["lunch", "brunch", "midday"]},
    "is_dinner": {"meal_type": ["dinner", "supper", "evening", "night"]},
    "is_snack": {"meal_type": ["snack", "tea time"], "dish_type": ["snack", "starter", "appetizer", "hors d'oeuvre", "side dish"]},
    "is_dessert": {"dish_type": ["dessert", "sweet", "cake", "pastry", "cookie", "pie", "pudding"], "meal_type": ["dessert"]},
}
ITEM_TYPES = [
    ("coffee", ["coffee", "latte", "cappuccino", "espresso", "americano", "macchiato"]),
    ("smoothie", ["smoothie"]),
    ("juice", ["juice", "lemonade"]),
    ("drink", ["coke", "pepsi", "water", "soda", "tea", "iced tea", "energy drink", "beer", "wine"]),
    ("dessert", ["cake", "chocolate", "ice cream", "gelato", "cookie", "brownie", "pudding", "cheesecake", "tart", "muffin"]),
    ("soup", ["soup", "broth", "bisque", "chowder"]),
    ("salad", ["salad"]),
    ("appetizer", ["spring roll", "bruschetta", "nachos", "mozzarella sticks", "wings", "sampler", "starter"]),
    ("sauce", ["sauce", "dip", "dressing", "gravy", "salsa"]),
    ("side", ["side", "fries", "rice", "coleslaw", "bread"]),
    ("combo", ["combo", "deal", "set", "bundle", "platter"]),
]


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-case text holds one of the words as a substring; null text holds none."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return F.coalesce(out, F.lit(False))


def list_holds_any(df: DataFrame, name: str, words: list[str], split: bool = True) -> Column:
    """Whether an element of a list column, or of text split at commas and semicolons, holds one of the words."""
    if name not in df.columns:
        return F.lit(False)
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        items = F.col(name)
    elif not isinstance(kind, T.StringType):
        return F.lit(False)
    else:
        items = F.split(F.col(name), "[,;]") if split else F.array(F.col(name))
    return F.coalesce(F.exists(items, lambda x: holds_any(x, words)), F.lit(False))


def classify(title: Column, groups: list[tuple[str, list[str]]] | None = None, otherwise: str = "main_course") -> Column:
    """The first group one of whose words the title holds."""
    out = F
    for label, words in groups or ITEM_TYPES:
        out = out.when(holds_any(title, words), label)
    return out.otherwise(otherwise)


def binned(value: Column, edges: tuple[float, ...], labels: tuple[str, ...], missing: str = "nan") -> Column:
    """Right-closed bins: a value on an edge belongs to the lower one."""
    out = F.when(value.isNull(), missing)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(value <= edge, label)
    return out.otherwise(labels[len(edges)])


def density(grams: Column, calories: Column) -> Column:
    return F.coalesce(F.try_divide(grams.cast("double"), calories.cast("double")), F.lit(0.0))


Engineer = Callable[[DataFrame, Settings], dict[str, Column]]


def nutrition(df: DataFrame, s: Settings) -> dict[str, Column]:
    cal, out = F.col("calories_per_serving"), {}
    limits = {"protein": ("is_high_protein", 4, s.high_protein_ratio), "carbs": ("is_low_carb", 4, s.low_carb_ratio), "fat": ("is_low_fat", 9, s.low_fat_ratio)}
    for what, name in (("protein", "protein_density"), ("carbs", "carb_density"), ("fat", "fat_density"), ("fiber", "fiber_density")):
        if f"{what}_g_per_serving" not in df.columns:
            continue
        grams = F.col(f"{what}_g_per_serving")
        out[name] = density(grams, cal)
        if what in limits:
            flag, kcal, limit = limits[what]
            share = F.try_divide(grams.cast("double") * kcal, cal.cast("double"))
            out[flag] = F.coalesce(share >= limit if flag == "is_high_protein" else share <= limit, F.lit(False))
        if what == "protein":
            out["protein_calorie_ratio"] = out[name] * 100
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in SCORE_WEIGHTS.items() if c in df.columns]
    out["nutrition_score"] = sum(parts, F.lit(0.0))
    if "sodium_mg_per_serving" in df.columns:
        out["is_low_sodium"] = F.coalesce(F.col("sodium_mg_per_serving") < s.low_sodium_mg, F.lit(False))
    if "fiber_g_per_serving" in df.columns:
        out["is_high_fiber"] = F.coalesce(F.col("fiber_g_per_serving") >= s.high_fiber_g, F.lit(False))
    return out


def dietary(df: DataFrame, s: Settings) -> dict[str, Column]:
    there = F.col("ingredients").isNotNull() if "ingredients" in df.columns else F.lit(False)
    free = lambda words: there & ~list_holds_any(df, "ingredients", words)
    label = lambda *words: list_holds_any(df, "health_labels", list(words))
    out = {"is_vegan": label("vegan") | free(ANIMAL)}
    out["is_vegetarian"] = label("vegetarian", "vegan") | out["is_vegan"] | free(MEAT)
    out["is_gluten_free"] = label("gluten-free", "gluten free") | free(GLUTEN)
    out["is_dairy_free"] = label("dairy-free", "dairy free") | free(DAIRY)
    keto = list_holds_any(df, "diet_labels", ["keto"]) | label("keto")
    out["is_keto"] = keto | (F.coalesce(F.col("carbs_g_per_serving"), F.lit(100.0)) < s.keto_carbs_g) if "carbs_g_per_serving" in df.columns else keto
    out["is_halal"] = label("halal") | free(HARAM)
    if "calories_per_serving" in df.columns:
        out["is_low_calorie"] = F.coalesce(F.col("calories_per_serving") < s.low_calorie, F.lit(False))
        by_share = "protein_g_per_serving" in df.columns
    else:
        by_share = False
    if not by_share and "protein_g_per_serving" in df.columns:
        out["is_high_protein"] = F.coalesce(F.col("protein_g_per_serving") >= s.high_protein_g, F.lit(False))
    return out


def meal(df: DataFrame, s: Settings) -> dict[str, Column]:
    out = {}
    for flag, places in MEALS.items():
        hit = F.lit(False)
        for name, words in places.items():
            hit = hit | list_holds_any(df, name, words, split=False)
        out[flag] = hit
    return out


def price(df: DataFrame, s: Settings) -> dict[str, Column]:
    return {name: binned(F.col("price").cast("double"), s.price_edges, labels) for name, labels in PRICE_LABELS.items()}


def metadata(df: DataFrame, s: Settings) -> dict[str, Column]:
    out = {f"{one}_count": list_size(df, many) for one, many in (("ingredient", "ingredients"), ("health_label", "health_labels"), ("diet_label", "diet_labels"))}
    return out | {f"{c}_length": F.coalesce(F.char_length(c), F.lit(0)) for c in ("recipe_name", "description") if c in df.columns}


def item_type(df: DataFrame, s: Settings) -> dict[str, Column]:
    return {} if "item_type" in df.columns else {"item_type": classify(F.col("recipe_name"))}


#: In order: name, required columns, engineer.
ENGINEERS: list[tuple[str, tuple[str, ...], Engineer]] = [
    ("item type", ("recipe_name",), item_type),
    ("nutrition", ("calories_per_serving",), nutrition),
    ("dietary", (), dietary),
    ("meal", (), meal),
    ("price", ("price",), price),
    ("metadata", (), metadata),
]


#: What each feature tells, beside its name.
DESCRIPTIONS = {
    "item_type": "kind of dish or drink, by the words of its name",
    "protein_density": "grams of protein for each kilocalorie",
    "carb_density": "grams of carbohydrates for each kilocalorie",
    "fat_density": "grams of fat for each kilocalorie",
    "fiber_density": "grams of fibre for each kilocalorie",
    "protein_calorie_ratio": "grams of protein for 100 kilocalories",
    "is_high_protein": "protein gives much of the energy, or there is much of it",
    "is_low_carb": "carbohydrates give little of the energy",
    "is_low_fat": "fat gives little of the energy",
    "nutrition_score": "weighted sum of fibre, protein, sodium, sugar and saturated fat",
    "is_low_sodium": "little sodium in a serving",
    "is_high_fiber": "much fibre in a serving",
    "is_vegan": "labelled so, or without ingredients from animals",
    "is_vegetarian": "labelled so, vegan, or without meat and fish",
    "is_gluten_free": "labelled so, or without ingredients with gluten",
    "is_dairy_free": "labelled so, or without ingredients of milk",
    "is_keto": "labelled so, or with few carbohydrates",
    "is_halal": "labelled so, or without ingredients that rule it out",
    "is_low_calorie": "few kilocalories in a serving",
    "is_breakfast": "for the morning",
    "is_lunch": "for midday",
    "is_dinner": "for the evening",
    "is_snack": "for between meals, or a side dish",
    "is_dessert": "sweet, after a meal",
    "budget_category": "price bin by name",
    "price_level": "price bin by signs",
    "price_bucket": "price bin by its limits",
    "ingredient_count": "ingredients in the list",
    "health_label_count": "health labels in the list",
    "diet_label_count": "diet labels in the list",
    "recipe_name_length": "characters of the name",
    "description_length": "characters of the description",
}


@dataclass
class Run:
    """What each engineer did."""

    created: dict[str, list[str]] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def statistics(self) -> dict[str, float]:
        return {"features": sum(map(len, self.created.values())), "skipped": len(self.skipped), "failed": len(self.failed), "mean_seconds": sum(self.seconds.values()) / max(1, len(self.seconds))}

    def registry(self, search: str = "") -> list[dict[str, str]]:
        """The features as records, those whose name, engineer or description holds the text."""
        every = [{"feature": f, "engineer": e, "description": DESCRIPTIONS.get(f, "")} for e, fs in self.created.items() for f in fs]
        return [r for r in every if any(search.lower() in x.lower() for x in r.values())]

    def export(self, path: str) -> None:
        rows = self.registry()
        with open(path, "w") as f:
            f.write(json.dumps(rows, indent=2) if path.endswith(".json") else "\n".join(["| feature | engineer | description |", "|-|-|-|", *(f"| {r['feature']} | {r['engineer']} | {r['description']} |" for r in rows)]))


def engineer(df: DataFrame, settings: Settings | None = None, engineers: list[tuple[str, tuple[str, ...], Engineer]] | None = None) -> tuple[DataFrame, Run]:
    """``df`` with all features that its columns support. A feature named like an input column is an error."""
    settings, run, made, before = settings or Settings(), Run(), {}, set(df.columns)
    for name, required, build in engineers or ENGINEERS:
        began, missing = time.time(), [c for c in required if c not in before]
        if missing:
            run.skipped[name] = "missing " + ", ".join(missing)
            continue
        try:
            new = build(df, settings)
        except Exception as e:  # noqa: BLE001 - reported, the others go on
            run.failed[name] = str(e)
            continue
        clash = sorted(set(new) & before)
        if clash:
            raise ValueError(f"features named like input columns: {clash}")
        twice = sorted(set(new) & set(made))
        if twice:
            raise ValueError(f"features made twice: {twice}")
        made |= new
        run.created[name] = list(new)
        run.seconds[name] = time.time() - began
    return df.withColumns(made), run
