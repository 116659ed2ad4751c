"""Text columns: sections of labelled fields, four renderers, templates and localisation, all as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import ARABIC, FRENCH

# Labels by key. Further languages are added with add_language().
ENGLISH = {
    "recipe_name": "Menu Item Name",
    "item_type": "Menu Item Category",
    "cuisine_type": "Cuisine Type",
    "meal_type": "Meal Type",
    "dish_type": "Dish Type",
    "description": "Description",
    "prep_notes": "Preparation Notes",
    "servings": "Serving Information",
    "servings_unit": "servings",
    "calories": "Calories",
    "protein": "Protein",
    "carbs": "Carbs",
    "fat": "Fat",
    "fiber": "Fiber",
    "sugar": "Sugar",
    "sodium": "Sodium",
    "nutrition_score": "Nutrition Score",
    "protein_calorie_ratio": "Protein Calorie Ratio",
    "protein_density": "Protein Density",
    "g_per_100_kcal": "g per 100 kcal",
    "diet_labels": "Diet Labels",
    "health_labels": "Health Labels",
    "dietary_attributes": "Dietary Attributes",
    "total_ingredients": "Total Ingredients",
    "price": "Price",
    "rating": "Rating",
    "source": "Source",
    "prep_time": "Preparation Time",
    "popularity": "Popularity",
    "minutes": "minutes",
    "nutrition_facts": "Nutrition Facts (per serving)",
    "dietary_profile": "Dietary & Health Profile",
    "ingredients": "Ingredients",
    "metadata": "Menu Item Metadata",
    "vegan": "Vegan",
    "vegetarian": "Vegetarian",
    "gluten_free": "Gluten-Free",
    "dairy_free": "Dairy-Free",
    "keto": "Keto-Friendly",
    "halal": "Halal",
    "low_calorie": "Low Calorie",
    "high_protein": "High Protein",
    "low_carb": "Low Carb",
    "low_fat": "Low Fat",
    "low_sodium": "Low Sodium",
    "high_fiber": "High Fiber",
}
LANGUAGES: dict[str, dict[str, str]] = {"en": ENGLISH, "ar": ARABIC, "fr": FRENCH}


def add_language(code: str, labels: dict[str, str]) -> None:
    LANGUAGES[code] = labels


def label(key: str, language: str = "en") -> str:
    """The label; of an unknown language the English one, of an unknown key the key."""
    return LANGUAGES.get(language, ENGLISH).get(key, key)


def present(df: DataFrame, name: str) -> Column:
    """Whether a cell holds something."""
    if name not in df.columns:
        return F.lit(False)
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.coalesce(F.trim(c) != "", F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull() & ~F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNotNull()


@dataclass(frozen=True)
class Field:
    """label, value (null: left out), bullet; items: a list column instead of a value."""

    label: str
    value: Column | None = None
    bullet: bool = False
    items: Column | None = None


@dataclass(frozen=True)
class Section:
    title: str | None
    fields: tuple[Field, ...]


def _joined(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.array_join(c, ", ") if isinstance(df.schema[name].dataType, T.ArrayType) else c.cast("string")


def _if(df: DataFrame, name: str, value: Callable[[], Column]) -> Column:
    return F.when(present(df, name), value()) if name in df.columns else F.lit(None).cast("string")


def fixed(x: Column, places: int) -> Column:
    """As Python formats it: halves to even on the exact binary value, no thousands separators."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * places if places else "0"))


def header(df: DataFrame, lang: str) -> Section:
    fields = [Field(label("recipe_name", lang), _if(df, "recipe_name", lambda: F.col("recipe_name")))]
    fields.append(Field(label("item_type", lang), _if(df, "item_type", lambda: F.initcap(F.replace(F.col("item_type"), F.lit("_"), F.lit(" "))))))
    fields += [Field(label(c, lang), _if(df, c, lambda c=c: _joined(df, c))) for c in ("cuisine_type", "meal_type", "dish_type")]
    return Section(None, tuple(fields))


def description(df: DataFrame, lang: str) -> Section:
    fields = [Field(label(c, lang), _if(df, c, lambda c=c: F.col(c).cast("string"))) for c in ("description", "prep_notes")]
    fields.append(Field(label("servings", lang), _if(df, "servings", lambda: F.concat(F.col("servings").cast("string"), F.lit(" " + label("servings_unit", lang))))))
    return Section(None, tuple(fields))


def nutrition(df: DataFrame, lang: str) -> Section:
    grams = lambda what, unit="g": _if(df, f"{what}_{unit}_per_serving", lambda: F.concat(F.col(f"{what}_{unit}_per_serving").cast("string"), F.lit(unit)))
    net = F.lit("")
    if {"carbs_g_per_serving", "fiber_g_per_serving"} <= set(df.columns):
        less = F.greatest(F.lit(0.0), F.col("carbs_g_per_serving").cast("double") - F.col("fiber_g_per_serving"))
        net = F.when(present(df, "fiber_g_per_serving"), F.concat(F.lit(" (Net Carbs: "), fixed(less, 1), F.lit("g)"))).otherwise("")
    parts = [
        ("calories", _if(df, "calories_per_serving", lambda: F.concat(F.col("calories_per_serving").cast("string"), F.lit(" kcal")))),
        ("protein", grams("protein")),
        ("carbs", F.concat(grams("carbs"), net)),
        ("fat", grams("fat")),
        ("fiber", grams("fiber")),
        ("sugar", grams("sugar")),
        ("sodium", grams("sodium", "mg")),
        ("nutrition_score", _if(df, "nutrition_score", lambda: fixed(F.col("nutrition_score"), 2))),
        ("protein_calorie_ratio", _if(df, "protein_calorie_ratio", lambda: F.concat(fixed(F.col("protein_calorie_ratio"), 2), F.lit(" " + label("g_per_100_kcal", lang))))),
        ("protein_density", _if(df, "protein_density", lambda: fixed(F.col("protein_density"), 4))),
    ]
    return Section(label("nutrition_facts", lang), tuple(Field(label(k, lang), v, True) for k, v in parts))


FLAGS = ("vegan", "vegetarian", "gluten_free", "dairy_free", "keto", "halal", "low_calorie", "high_protein", "low_carb", "low_fat", "low_sodium", "high_fiber")


def dietary(df: DataFrame, lang: str) -> Section:
    flags = [F.when(F.col(f"is_{f}"), F.lit(label(f, lang))) for f in FLAGS if f"is_{f}" in df.columns and isinstance(df.schema[f"is_{f}"].dataType, T.BooleanType)]
    joined = F.concat_ws(", ", *flags) if flags else F.lit("")
    fields = [Field(label(c, lang), _if(df, c, lambda c=c: _joined(df, c)), True) for c in ("diet_labels", "health_labels")]
    return Section(label("dietary_profile", lang), (*fields, Field(label("dietary_attributes", lang), F.when(joined != "", joined), True)))


def ingredients(df: DataFrame, lang: str) -> Section:
    c = F.col("ingredients")
    items = c.cast("array<string>") if isinstance(df.schema["ingredients"].dataType, T.ArrayType) else F.array(c.cast("string"))
    return Section(label("ingredients", lang), (Field("List", items=F.when(present(df, "ingredients"), items)), Field(label("total_ingredients", lang), _if(df, "ingredient_count", lambda: F.col("ingredient_count").cast("string")))))


def metadata(df: DataFrame, lang: str) -> Section:
    extra = [F.when(present(df, c), F.concat(F.lit(f"{name}: "), F.col(c))) for c, name in (("price_level", "Price level"), ("budget_category", "Category")) if c in df.columns]
    level = F.concat_ws(", ", *extra) if extra else F.lit("")
    shown = F.when(level != "", F.concat(F.lit(" ("), level, F.lit(")"))).otherwise("")
    share = lambda: F.when(F.col("popularity") <= 1, F.concat(fixed(F.col("popularity").cast("double") * 100, 0), F.lit("%"))).otherwise(F.concat(F.col("popularity").cast("string"), F.lit("%")))
    parts = [
        ("price", _if(df, "price", lambda: F.concat(F.lit("$"), fixed(F.col("price"), 2), shown))),
        ("rating", _if(df, "rating", lambda: F.concat(F.col("rating").cast("string"), F.lit(" / 5.0")))),
        ("source", _if(df, "source", lambda: F.col("source"))),
        ("prep_time", _if(df, "prep_time_minutes", lambda: F.concat(F.col("prep_time_minutes").cast("string"), F.lit(" " + label("minutes", lang))))),
        ("popularity", _if(df, "popularity", share)),
    ]
    return Section(label("metadata", lang), tuple(Field(label(k, lang), v, True) for k, v in parts))


def _lines(parts: list[Column]) -> Column:
    return F.concat_ws("\n", *parts)


def _plain(f: Field) -> Column:
    if f.items is not None:
        return F.array_join(F.transform(f.items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit(("- " if f.bullet else "") + f"{f.label}: "), f.value)


def _markdown(f: Field) -> Column:
    if f.items is not None:
        return F.array_join(F.transform(f.items, lambda x: F.concat(F.lit("* "), x)), "\n")
    return F.concat(F.lit(f"* **{f.label}**: "), f.value) if f.bullet else F.concat(F.lit(f"**{f.label}**: "), f.value, F.lit("  "))


def _some(s: Section) -> Column:
    out = F.lit(False)
    for f in s.fields:
        out = out | (f.items if f.items is not None else f.value).isNotNull()
    return out


def _html(s: Section) -> Column:
    """Bullets stand together in one list, as the built-in sections have them."""
    bullets = [F.concat(F.lit(f"  <li><strong>{f.label}</strong>: "), f.value, F.lit("</li>")) for f in s.fields if f.items is None and f.bullet]
    plain = []
    for f in s.fields:
        if f.items is not None:
            plain.append(F.concat(F.lit("<ul>\n"), F.array_join(F.transform(f.items, lambda x: F.concat(F.lit("  <li>"), x, F.lit("</li>"))), "\n"), F.lit("\n</ul>")))
        elif not f.bullet:
            plain.append(F.concat(F.lit(f"<p><strong>{f.label}</strong>: "), f.value, F.lit("</p>")))
    body = _lines(bullets) if bullets else F.lit("")
    listed = F.when(body != "", F.concat(F.lit("<ul>\n"), body, F.lit("\n</ul>")))
    return _lines([*([F.lit(f"<h3>{s.title}</h3>")] if s.title else []), *plain, *([listed] if bullets else [])])


def _json(s: Section) -> Column:
    fields = F.map_from_entries(F.array_compact(F.array(*(F.when(f.value.isNotNull(), F.struct(F.lit(f.label), f.value)) if f.items is None else F.when(f.items.isNotNull(), F.struct(F.lit(f.label), F.array_join(f.items, ", "))) for f in s.fields))))
    return F.to_json(F.struct(F.lit(s.title).cast("string").alias("title"), fields.alias("fields")), {"ignoreNullFields": "false"})


RENDERERS: dict[str, Callable[[Section], Column]] = {
    "plain": lambda s: _lines([*([F.lit(f"{s.title}:")] if s.title else []), *map(_plain, s.fields)]),
    "markdown": lambda s: _lines([*([F.lit(f"### {s.title}")] if s.title else []), *map(_markdown, s.fields)]),
    "html": _html,
    "json": _json,
}

#: section -> (builder, required columns)
SECTIONS: dict[str, tuple[Callable[[DataFrame, str], Section], tuple[str, ...]]] = {
    "header": (header, ("recipe_name",)),
    "description": (description, ()),
    "nutrition": (nutrition, ("calories_per_serving",)),
    "dietary": (dietary, ()),
    "ingredients": (ingredients, ("ingredients",)),
    "metadata": (metadata, ()),
}


@dataclass(frozen=True)
class Template:
    name: str
    target: str
    sections: tuple[str, ...]
    purpose: str = ""


TEMPLATES = [
    Template("search", "search_text", ("header", "nutrition", "dietary", "ingredients"), "embedding"),
    Template("chunk", "text_chunk", ("header", "description", "nutrition", "ingredients", "metadata"), "context"),
    Template("summary", "summary_text", ("header", "description"), "listing"),
]


def check_templates(templates: list[Template]) -> None:
    """One error that lists everything wrong."""
    wrong = [f"{t.name}: no sections" for t in templates if not t.sections]
    wrong += [f"{t.name}: a section twice" for t in templates if len(set(t.sections)) < len(t.sections)]
    for what in ("name", "target"):
        held = [getattr(t, what) for t in templates]
        wrong += [f"{what} {x!r} twice" for x in sorted({x for x in held if held.count(x) > 1})]
    if wrong:
        raise ValueError("; ".join(wrong))


def registry(templates: list[Template], search: str = "") -> list[dict[str, str]]:
    """Templates whose name, target or purpose holds the text."""
    return [{"name": t.name, "target": t.target, "purpose": t.purpose} for t in templates if any(search.lower() in x.lower() for x in (t.name, t.target, t.purpose))]


def build_text(df: DataFrame, language: str = "en", renderer: str = "plain", templates: list[Template] | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with a text column for each template, and warnings for the sections that its columns don't support."""
    templates = TEMPLATES if templates is None else templates
    check_templates(templates)
    made, warnings = {}, []
    for name in dict.fromkeys(s for t in templates for s in t.sections):
        build, required = SECTIONS[name]
        missing = [c for c in required if c not in df.columns]
        if missing:
            warnings.append(f"section {name} skipped, missing {', '.join(missing)}")
        else:
            section = build(df, language)
            made[name] = F.when(_some(section), RENDERERS[renderer](section))
    text = lambda t: [made[s] for s in t.sections if s in made]
    if renderer == "json":
        whole = lambda parts: F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    else:
        whole = lambda parts: F.concat_ws("\n\n", *parts) if parts else F.lit("")
    return df.withColumns({t.target: whole(text(t)) for t in templates}), warnings
