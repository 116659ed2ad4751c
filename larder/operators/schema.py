"""Schema mapping: any column names to the canonical ones.

All of it works on the list of names; the table itself is renamed once, without touching a row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Canonical field, its type, its aliases, in declaration order (the first field that has a name wins).
CANONICAL: dict[str, tuple[str, list[str]]] = {
    "recipe_name": ("str", ["recipe_name", "recipe", "dish_name", "dish", "title", "name", "item_name", "menu_item_name", "menu_item", "item", "product_name", "food_name", "menu_item_id"]),
    "item_type": ("str", ["item_type", "dish_category", "category_type", "type", "item_category"]),
    "description": ("str", ["description", "summary", "details"]),
    "meal_type": ("object", ["meal_type", "meal", "meal_category", "category"]),
    "dish_type": ("object", ["dish_type", "course", "food_type", "dish_category"]),
    "cuisine_type": ("object", ["cuisine", "cuisine_type", "origin"]),
    "ingredients": ("object", ["ingredients", "ingredient_lines", "ingredient_list"]),
    "servings": ("float", ["servings", "serves", "yield", "yield_count"]),
    "calories_per_serving": ("float", ["calories", "kcal", "energy", "energy_kcal", "calories_per_serving"]),
    "protein_g_per_serving": ("float", ["protein", "protein_g", "protein_grams", "proteingrams", "protein_per_serving"]),
    "carbs_g_per_serving": ("float", ["carbs", "carbohydrates", "carbohydrate", "carbs_g", "carbs_per_serving"]),
    "net_carbs_g_per_serving": ("float", ["net_carbs", "net_carbs_g", "net_carbs_per_serving"]),
    "fat_g_per_serving": ("float", ["fat", "fat_g", "total_fat", "fat_per_serving"]),
    "saturated_fat_g_per_serving": ("float", ["saturated_fat", "sat_fat", "saturated_fat_g"]),
    "trans_fat_g_per_serving": ("float", ["trans_fat", "trans_fat_g"]),
    "monounsaturated_fat_g_per_serving": ("float", ["monounsaturated_fat", "monounsaturated_fat_g"]),
    "polyunsaturated_fat_g_per_serving": ("float", ["polyunsaturated_fat", "polyunsaturated_fat_g"]),
    "fiber_g_per_serving": ("float", ["fiber", "fiber_g"]),
    "sugar_g_per_serving": ("float", ["sugar", "sugar_g"]),
    "added_sugar_g_per_serving": ("float", ["added_sugar", "added_sugar_g"]),
    "sodium_mg_per_serving": ("float", ["sodium", "sodium_mg"]),
    "cholesterol_mg_per_serving": ("float", ["cholesterol", "cholesterol_mg"]),
    "diet_labels": ("object", ["diet_labels", "diet", "diet_types"]),
    "health_labels": ("object", ["health_labels", "health", "health_tags"]),
    "cautions": ("object", ["cautions", "allergens", "warnings"]),
    "price": ("float", ["price", "cost", "menu_price"]),
    "currency": ("str", ["currency"]),
    "rating": ("float", ["rating", "stars", "score"]),
    "popularity": ("float", ["popularity", "orders", "likes"]),
    "preparation_time_minutes": ("float", ["prep_time", "preparation_time", "preparation_time_minutes", "cook_time"]),
    "image_url": ("str", ["image", "image_url", "photo"]),
    "url": ("str", ["url", "link"]),
    "source": ("str", ["source", "provider"]),
}


def normalise_name(name: str) -> str:
    """Trimmed and lower case; blanks and hyphens to one underscore; no parentheses."""
    out = re.sub(r"[\s-]+", "_", name.strip().lower())
    return re.sub(r"_+", "_", re.sub(r"[()]", "", out))


@dataclass
class MappingResult:
    """mapping: input name to new name; diagnostics: one record for every input column."""

    mapping: dict[str, str] = field(default_factory=dict)
    matched: list[str] = field(default_factory=list)
    unmatched: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    diagnostics: list[dict[str, str]] = field(default_factory=list)

    @property
    def coverage(self) -> float:
        """Percent of the columns that were mapped."""
        return round(100 * len(self.matched) / len(self.diagnostics), 2) if self.diagnostics else 0.0

    def export(self, path: str) -> None:
        """A report as .json, .csv or .txt. It has a line for each column of the schema, so the driver writes it."""
        kind = path.rsplit(".", 1)[-1].lower()
        if kind == "json":
            text = json.dumps({"coverage": self.coverage, "matched": self.matched, "unmatched": self.unmatched, "warnings": self.warnings, "diagnostics": self.diagnostics}, indent=2)
        elif kind == "csv":
            text = "\n".join(["original,mapped,status", *(f"{d['original']},{d['mapped']},{d['status']}" for d in self.diagnostics)])
        elif kind == "txt":
            text = "\n".join([f"Coverage: {self.coverage}%", *(f"{d['original']} -> {d['mapped']} [{d['status']}]" for d in self.diagnostics)])
        else:
            raise ValueError(f"unknown report format: {path}")
        with open(path, "w") as f:
            f.write(text + "\n")


class SchemaMapper:
    """Column matching with an alias table that can be extended."""

    def __init__(self, aliases: dict[str, Iterable[str]] | None = None):
        self.aliases = {k: list(v) for k, v in (aliases or {k: v for k, (_, v) in CANONICAL.items()}).items()}

    def _known(self, canonical: str) -> list[str]:
        if canonical not in self.aliases:
            raise ValueError(f"unknown canonical field {canonical!r}")
        return self.aliases[canonical]

    def add_alias(self, canonical: str, alias: str) -> None:
        known, name = self._known(canonical), normalise_name(alias)
        if name not in known:
            known.append(name)

    def remove_alias(self, canonical: str, alias: str) -> None:
        known, name = self._known(canonical), normalise_name(alias)
        if name in known:
            known.remove(name)

    def lookup(self, name: str) -> str | None:
        """The first canonical field that has this (normalised) name."""
        return next((k for k, v in self.aliases.items() if name in v), None)

    def match(self, columns: list[str]) -> MappingResult:
        """The first column to claim a field gets it; later ones and unknown ones keep their own normalised name."""
        out, claimed = MappingResult(), {}
        for original in columns:
            name = normalise_name(original)
            canonical = self.lookup(name)
            if canonical is None:
                out.unmatched.append(original)
                status, new = "UNKNOWN", name
            elif canonical in claimed:
                out.warnings.append(f"{original!r} also means {canonical!r}, which {claimed[canonical]!r} has")
                status, new = "REJECTED", name
            else:
                claimed[canonical] = original
                out.matched.append(original)
                status, new = "MAPPED", canonical
            out.mapping[original] = new
            out.diagnostics.append({"original": original, "mapped": new, "status": status})
        return out

    def fit_transform(self, df: DataFrame) -> tuple[DataFrame, MappingResult]:
        result = self.match(df.columns)
        return df.toDF(*(d["mapped"] for d in result.diagnostics)), result


def map_schema(df: DataFrame, mapper: SchemaMapper | None = None) -> tuple[DataFrame, MappingResult]:
    return (mapper or SchemaMapper()).fit_transform(df)
