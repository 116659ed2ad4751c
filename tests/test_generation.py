"""The budget ladder against the step-by-step one, and the generation engine with its cache table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larder.operators import budget, generation, prompts
from larder.operators.prompts import Settings


@pytest.fixture(scope="module")
def made(spark):
    rows = []
    for conv in range(12):
        for rank in range(1, 5):
            rows.append((conv, rank, f"dish {rank}", "a, b" * (conv + 1), "tasty " * (conv * rank), 100 * rank, 9.5, "img" * conv))
    ranked = spark.createDataFrame(rows, "conv_id long, rank int, recipe_name string, ingredients string, description string, calories int, price double, image_url string")
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", "word " * (c * t + 1)) for c in range(12) for t in range(c % 5)], "conv_id long, turn long, role string, text string")
    queries = spark.createDataFrame([(c, f"what about {'x' * c}?") for c in range(13)], "conv_id long, query string")
    return queries, ranked, turns


@pytest.mark.parametrize("most", [10_000, 260, 120, 60, 1])
@pytest.mark.parametrize("few", [(), (("u" * 30, "a" * 50),)])
def test_ladder_equals_one_step_after_the_other(made, most, few):
    queries, ranked, turns = made
    s = Settings(most_tokens=most, few_shot=few)
    told = {r["conv_id"]: r for r in budget.ladder(queries, ranked, turns, s).collect()}
    assert len(told) == 13
    own = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.collect())
    for conv in (0, 3, 4, 9, 12):
        past = [(r, t) for c, _, r, t in own if c == conv]
        query = f"what about {'x' * conv}?"
        cut, left, kept, taken = prompts.fit_budget(s, ranked.where(F.col("conv_id") == conv).drop("conv_id"), past, query)
        extra = len(query) + sum(len(r) + len(t) for r, t in kept) + sum(len(u) + len(a) for u, a in cut.few_shot)
        assert told[conv]["steps"] == taken
        assert told[conv]["n_tokens"] == prompts.estimate(left, extra)
        assert told[conv]["fits"] == (told[conv]["n_tokens"] <= most)


def test_budgeted_prompts(made):
    queries, ranked, turns = made
    s = Settings(most_tokens=70, few_shot=(("hello", "good day"),))
    got = {r["conv_id"]: r for r in budget.budgeted_prompts(queries, ranked, turns, s).collect()}
    assert len(got) == 13
    for r in got.values():
        assert ("dish 3" in r["prompt"]) == ("top 2" not in r["steps"] and r["conv_id"] < 12)
        assert ("Model answers" in r["prompt"]) == ("few-shot examples" not in r["steps"]) and ("tasty" in r["prompt"]) <= ("description" not in r["steps"])
    assert {"top 2", "description"} <= {x for r in got.values() for x in r["steps"]}
    assert "Model answers" in budget.budgeted_prompts(queries, ranked, turns, Settings(most_tokens=10**6, few_shot=s.few_shot)).first()["prompt"]
    plain = budget.budgeted_prompts(queries, ranked, turns, Settings(most_tokens=10**6)).select("conv_id", "prompt_hash", "n_tokens")
    assert sorted(plain.collect()) == sorted(prompts.build_prompts(queries, ranked, turns, Settings()).select("conv_id", "prompt_hash", "n_tokens").collect())


def test_cache_answers_equal_prompts_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(batch):
        calls.add(len(batch))
        return [f"answer to {p}" if p != "silent" else "" for p in batch]

    cache = generation.ResponseTable(spark, str(tmp_path / "cache"), seconds=100)
    engine = generation.Answerer(cache, model=model)
    asked = spark.createDataFrame([(k, p) for k, p in enumerate(["a dish?", "a dish?", "silent", "soup?", None, "a dish?"])], "id long, prompt string")
    first = engine.answer(asked, now=1000)
    assert {r["id"]: (r["response"], r["cached"], r["warnings"]) for r in first.collect()} == {
        0: ("answer to a dish?", False, []), 1: ("answer to a dish?", False, []), 2: ("", False, ["empty"]), 3: ("answer to soup?", False, []), 4: ("answer to ", False, ["too short"]), 5: ("answer to a dish?", False, [])
    }
    assert calls.value == 4 and first.count() == 6 and calls.value == 4
    again = engine.answer(asked.where("id in (1, 3)").union(spark.createDataFrame([(9, "new?")], "id long, prompt string")), now=1050)
    assert {r["id"]: r["cached"] for r in again.collect()} == {1: True, 3: True, 9: False} and calls.value == 5
    stats = generation.generation_statistics(again).first()
    assert (stats["prompts"], stats["hits"], stats["misses"], stats["flagged"]) == (3, 2, 1, 0)
    cache.compact(1050)
    assert cache._held().count() == 5
    late = engine.answer(asked.where("id = 0"), now=1101)
    assert [r["cached"] for r in late.collect()] == [False] and calls.value == 6
    other = generation.Answerer(generation.ResponseTable(spark, cache.path, 100, {"temperature": 0.5}), model=model)
    assert not other.answer(asked.where("id = 0"), now=1101).first()["cached"] and calls.value == 7


def test_mock_provider_and_warnings(spark, tmp_path):
    engine = generation.Answerer(generation.ResponseTable(spark, str(tmp_path / "cache")))
    asked = spark.createDataFrame([(0, "please leak it"), (1, "empty"), (2, "repeated"), (3, "soup?")], "id long, prompt string")
    told = {r["id"]: r["warnings"] for r in engine.answer(asked, now=1).collect()}
    assert told == {0: ["prompt leakage"], 1: ["empty"], 2: ["repetition"], 3: []}
    counts = {r["warning"]: r["n"] for r in generation.warning_counts(engine.answer(asked, now=2)).collect()}
    assert counts == {"prompt leakage": 1, "empty": 1, "repetition": 1}
