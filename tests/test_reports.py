"""Reports of capabilities, features and rankings."""

from __future__ import annotations

from larder.functions import features
from larder.operators import capability, prompts, ranking
from larder.operators.ranking import Config, Factor, Objective


def test_item_types_are_all_told(spark, monkeypatch):
    monkeypatch.setattr(capability, "SHOWN_TYPES", 3)
    df = spark.createDataFrame([(f"type {k % 7}",) for k in range(30)] + [(None,)], "item_type string")
    told = capability.report(df)
    assert told["n_item_types"] == 7 and told["item_types"] == ["type 0", "type 1", "type 2"]
    assert {r["item_type"]: r["n"] for r in capability.item_types(df).collect()} == {f"type {k}": 5 if k < 2 else 4 for k in range(7)}
    by = capability.Registry([capability.Capability("There", "x", ("item_type",)), capability.Capability("Odd", "x", ("item_type",), {"item_type": ("no",)}), capability.Capability("Not", "x", ("price",))]).by_status(df)
    assert by == {"ENABLED": ["There"], "PARTIAL": ["Odd"], "DISABLED": ["Not"]}


def test_every_feature_is_described(spark, tmp_path):
    columns = "recipe_name string, description string, calories_per_serving double, protein_g_per_serving double, carbs_g_per_serving double, fat_g_per_serving double, fiber_g_per_serving double, sodium_mg_per_serving double, price double"
    _, run = features.engineer(spark.createDataFrame([], columns))
    assert all(r["description"] for r in run.registry()) and len(run.registry()) == len(features.DESCRIPTIONS)
    assert {r["feature"] for r in run.registry("kilocalor")} >= {"protein_density", "is_low_calorie"}
    run.export(str(tmp_path / "f.md"))
    assert "| is_vegan | dietary |" in (tmp_path / "f.md").read_text()


def test_ranking_report(spark):
    df = spark.createDataFrame([(k, f"dish {k}", float(k), 10.0 - k, "a" if k < 3 else "b") for k in range(6)], "row_id long, recipe_name string, rating double, price double, category string")
    config = Config(objectives=(Objective("rating", weight=0.6), Objective("price", weight=0.4)))
    told = ranking.conflicts(df, config.objectives)
    text = ranking.report(ranking.rank(df, config), config, told)
    assert "ranking of 6 rows, objectives by weighted_sum" in text and "conflict: rating vs price" in text and "\n1. 5: 0.6000 (rating +0.6000, price +0.0000)" in text
    diverse = Config((Factor("RatingScore"),), diversity_column="category", diversity_weight=0.3)
    rows = {r["row_id"]: r["text"] for r in ranking.explanations(ranking.rank(df, diverse), diverse).collect()}
    assert rows[5] == "score 1.0000\n+1.0000 RatingScore (value 5.00, scaled 1.00, weight 1.00)"
    assert rows[4].endswith("\ndiversity -0.3000")


def test_languages_and_personas_can_be_added():
    prompts.register_language("Klingon", "Answer in Klingon.")
    prompts.register_persona("Pirate Cook", "Sound like a pirate.")
    try:
        s = prompts.Settings(language="klingon", persona="pirate cook")
        assert prompts.COMPONENTS["Language"](s, []).endswith("Answer in Klingon.") and prompts.COMPONENTS["Persona"](s, []).endswith("Sound like a pirate.")
    finally:
        prompts.LANGUAGES.pop("klingon")
        prompts.PERSONAS.pop("piratecook")
