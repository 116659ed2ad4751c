"""Fingerprints by hash tree and rebuilds of what has changed."""

from __future__ import annotations

import random

import pytest

from larder.operators.embedding import hash_provider
from larder.plans import fingerprints
from larder.plans.dataset import DatasetManager, State

HEAD = "recipe_name,price,protein_g_per_serving,calories_per_serving,cuisine_type,item_type,diet_labels,ingredients\n"


def menu(names):
    return HEAD + "".join(f'{n},{k + 1},40,450,American,Main Course,High-Protein,"chicken, oil"\n' for k, n in enumerate(names))


def test_the_tree_tells_every_change_and_no_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprints, "FAN", 8)
    rng = random.Random(1)
    data = bytearray(rng.choices(b"abc\n\x00\xff\r", k=4000))
    at = tmp_path / "file.bin"
    seen = set()

    def told(content):
        at.write_bytes(bytes(content))
        return fingerprints.file_hash(spark, str(at))

    first = told(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert told(data) == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    lines = bytes(data).split(b"\n")
    for changed in (data + b"x", data[:-3], data[:100] + b"z" + data[101:], b"\n".join([lines[1], lines[0], *lines[2:]]), b""):
        seen.add(told(changed))
    assert len(seen) == 5 and first not in seen


def test_one_changed_row_embeds_one_text(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    encode = hash_provider()

    def provider(texts):
        calls.add(len(texts))
        return encode(texts)

    (tmp_path / "shop").mkdir()
    csv = tmp_path / "shop" / "menu_items.csv"
    csv.write_text(menu(["Soup", "Salad", "Stew", "Rice"]))
    m = DatasetManager(spark, str(tmp_path), provider=provider)
    m.load("shop")
    assert calls.value == 4 and m.inspect("shop") == State.COMPLETE
    csv.write_text(menu(["Soup", "Salad", "Goulash", "Rice"]))
    assert m.inspect("shop") == State.STALE
    items, index = m.load("shop")
    assert calls.value == 5 and items.count() == 4 and index.table.count() == 4
    assert sorted(r["recipe_name"] for r in items.collect()) == ["Goulash", "Rice", "Salad", "Soup"]
    assert index.table.where("embedding is null").count() == 0 and m.inspect("shop") == State.COMPLETE
    DatasetManager(spark, str(tmp_path), config={"provider": "other", "index": "flat_ip"}, provider=provider).load("shop")
    assert calls.value == 9


def test_all_datasets(spark, tmp_path):
    for name, text in (("one", menu(["Soup"])), ("two", menu(["Tea", "Cake"])), ("bad", "a,b\n1,2\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "menu_items.csv").write_text(text)
    (tmp_path / "no data").mkdir()
    m = DatasetManager(spark, f"file://{tmp_path}")
    assert m.names() == ["bad", "one", "two"] and m.health()["datasets"] == dict.fromkeys(m.names(), "missing")
    told = m.rebuild_all()
    assert told["one"] == told["two"] == "complete" and told["bad"].startswith("validation")
    assert not m.health()["healthy"] and m.statistics()["builds"] == 2 and m.statistics()["seconds of embeddings"] > 0
    assert m.reload("two")[0].count() == 2
    with pytest.raises(FileNotFoundError):
        m.load("no data")


def test_a_failed_batch_has_the_providers_width(spark):
    from larder.operators.embedding import embed

    def broken(texts):
        raise OSError

    broken.dim = 7
    got = embed(spark.createDataFrame([("a",)], "t string"), "t", broken).first()
    assert list(got["embedding"]) == [0.0] * 7 and not got["is_success"]
