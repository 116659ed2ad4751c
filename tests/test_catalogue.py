"""Schema mapping, validation, features, text, capabilities, search and the dataset's life."""

import pytest
from pyspark.sql import functions as F

from larder.functions import features, text, tokens
from larder.operators import capability, embedding, filtering, prompts, quality, ranking, schema, search
from larder.operators.filtering import Rule
from larder.plans.dataset import BuildError, DatasetManager, State
from larder.plans.pipeline import Pipeline, Sessions
from larder.sources import catalogue

MENU = """recipe_name,price,protein_g_per_serving,calories_per_serving,cuisine_type,item_type,diet_labels,ingredients
Grilled Chicken,180,40,450,American,Main Course,High-Protein,"chicken, oil"
Pasta Primavera,9,12,500,Italian,Main Course,Vegetarian,"wheat, tomato"
Protein Shake,120,35,220,American,Smoothie,High-Protein,"whey, banana"
Greek Salad,60,8,250,Greek,Salad,Vegetarian,"feta cheese, olive"
Diet Soda,20,0,5,American,Drink,Low-Calorie,"water, sweetener"
"""


@pytest.fixture()
def root(tmp_path):
    (tmp_path / "shop").mkdir()
    (tmp_path / "shop" / "menu_items.csv").write_text(MENU)
    return tmp_path


def test_names_and_mapping(spark, tmp_path):
    assert [schema.normalise_name(x) for x in (" Protein (g) ", "Menu-Price", "a  b__c")] == ["protein_g", "menu_price", "a_b_c"]
    mapper = schema.SchemaMapper()
    result = mapper.match(["Dish Name", "title", "Menu Price", "whatever"])
    assert result.mapping == {"Dish Name": "recipe_name", "title": "title", "Menu Price": "price", "whatever": "whatever"}
    assert [d["status"] for d in result.diagnostics] == ["MAPPED", "REJECTED", "MAPPED", "UNKNOWN"] and result.coverage == 50.0
    mapper.add_alias("price", "Whatever")
    assert mapper.lookup("whatever") == "price"
    with pytest.raises(ValueError):
        mapper.add_alias("nothing", "x")
    for kind in ("json", "csv", "txt"):
        result.export(str(tmp_path / f"r.{kind}"))
    with pytest.raises(ValueError):
        result.export("r.pdf")


def test_validation(spark):
    df = spark.createDataFrame([(1, "a", "x", -1.0, None), (2, None, "y", 3.0, None)], "row_id long, recipe_name string, ingredients string, price double, rating double")
    told = quality.validate(df)
    status = {c.validator: c.status for c in told.checks}
    assert not told.is_valid and status["rules"] == "FAILED" and status["missing values"] == "WARNING" and status["required columns"] == "PASSED"
    assert quality.validate(df.select("row_id", "price", "price")).checks[2].status == "FAILED"
    assert quality.validate(df.limit(0)).checks[3].status == "FAILED"
    assert quality.violations(df).first()["n_violations"] == 1


def test_features(spark):
    df = spark.createDataFrame([("Iced Latte", 400.0, 30.0, "milk; sugar", None, 10.0), ("Steak", 0.0, 5.0, None, "Vegan", None)], "recipe_name string, calories_per_serving double, protein_g_per_serving double, ingredients string, health_labels string, price double")
    out, run = features.engineer(df)
    a, b = out.collect()
    assert a["item_type"] == "coffee" and b["item_type"] == "drink"  # "steak" holds "tea"
    assert a["is_high_protein"] and not b["is_high_protein"] and b["protein_density"] == 0
    assert not a["is_vegan"] and a["is_vegetarian"] and b["is_vegan"] and not a["is_dairy_free"]
    assert (a["price_bucket"], b["price_bucket"]) == ("<=$10", "nan")
    assert "price" not in features.engineer(df.drop("price"))[1].created
    with pytest.raises(ValueError):
        features.engineer(df.withColumn("is_vegan", F.lit(True)))


def test_text_sections_and_languages(spark):
    text.add_language("xx", {"recipe_name": "Nom"})
    df = spark.createDataFrame([("Soup", "main_course", 2.675, ["a", "b"], None)], "recipe_name string, item_type string, price double, ingredients array<string>, description string")
    out, warnings = text.build_text(df, language="xx")
    row = out.first()
    assert row["summary_text"] == "Nom: Soup\nitem_type: Main Course"
    assert "- Price: $2.67" not in row["text_chunk"] and "- price: $2.67" in row["text_chunk"] and "- a\n- b" in row["text_chunk"]
    assert any("nutrition" in w for w in warnings)
    with pytest.raises(ValueError, match="twice"):
        text.build_text(df, templates=[text.Template("a", "t", ("header", "header")), text.Template("a", "t", ())])


def test_capabilities(spark):
    df = spark.createDataFrame([("Shake", "smoothie", "keto;low"), ("Cake", "Dessert", "KETO")], "recipe_name string, item_type string, diet_labels string")
    told = {r["name"]: r["status"] for r in capability.detect(df).collect()}
    assert len(told) == 24 and told["Drink Recommendation"] == "ENABLED" and told["Soup Recommendation"] == "PARTIAL" and told["Budget Filtering"] == "DISABLED" and told["Keto Recommendation"] == "ENABLED"


def test_search_ranks_thresholds_and_cells(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, embedding array<double>")
    got = search.search(df, x[7].tolist(), 5).orderBy("rank").collect()
    want = np.argsort(-(x @ x[7]))[:5]
    assert [r["row_id"] for r in got] == want.tolist() and got[0]["row_id"] == 7
    assert [r["rank"] for r in search.search(df, x[7].tolist(), 5, threshold=0.999).collect()] == [1]
    index = search.build_index(df, "ivf", nlist=4)
    assert index.kind == "ivf" and [r["row_id"] for r in index.search(x[7].tolist(), 5, nprobe=4).orderBy("rank").collect()] == np.argsort(((x - x[7]) ** 2).sum(1))[:5].tolist()
    hits = {r["row_id"] for r in index.search(x[7].tolist(), 10, nprobe=2).collect()} & set(np.argsort(((x - x[7]) ** 2).sum(1))[:10].tolist())
    assert len(hits) >= 5 and search.build_index(df.limit(50), "ivf", nlist=100).kind == "flat_l2"
    with pytest.raises(ValueError):
        search.build_index(df.limit(0))
    cache = search.VectorCache(2)
    for q in "abc":
        cache.set(q, [1.0])
    assert cache.get("a") is None and cache.get("c") == [1.0]


def test_hash_embedding(spark):
    encode = embedding.hash_provider(noise=0)
    bag = spark.createDataFrame([("Spicy spicy tofu_1",)], "t string").select(embedding.hash_bag(F.col("t"))).first()[0]
    import numpy as np

    want = np.bincount(bag, minlength=384)
    assert np.allclose(encode(["Spicy spicy tofu_1"])[0], want / np.linalg.norm(want), atol=1e-6)
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "row_id int, t string")
    out = embedding.embed(df, "t")
    assert embedding.statistics(out).first().asDict() == {"n": 3, "n_distinct": 2, "n_failed": 0, "dim": 384}

    def broken(texts):
        raise RuntimeError

    assert embedding.embed(df, "t", broken).where("is_success").isEmpty()


def test_prompts(spark):
    settings = prompts.Settings(few_shot=(("u", "a" * 400),), most_tokens=100)
    items = spark.createDataFrame([(i, f"dish {i}", "x" * 200, "y") for i in range(4)], "rank int, recipe_name string, description string, image_url string")
    fitted, left, turns, taken = prompts.fit_budget(settings, items, [("User", "hi")] * 5, "q")
    assert taken == ["few-shot examples", "last 2 turns", "metadata", "ingredients", "description"] and fitted.few_shot == () and len(turns) == 2 and "description" not in left.columns
    built = prompts.build_prompts(spark.createDataFrame([(1, "soup?")], "conv_id long, query string"), items.withColumn("conv_id", F.lit(1)), spark.createDataFrame([(1, 0, "User", "hello")], "conv_id long, turn long, role string, text string"), prompts.Settings()).first()
    assert built["prompt"].endswith("## So far\nUser: hello\n\nGuest asks: soup?") and built["n_tokens"] == -(-len(built["prompt"]) // 4)
    cache = prompts.ResponseCache(most=1)
    cache.set("p", "r", top_k=1)
    assert cache.get("p", top_k=1) == "r" and cache.get("p", top_k=2) is None
    rows = [("a b c a b c",), ("",), ("  ",), ("You are Bob and here to help",), ("fine and long enough",)]
    told = [r[0] for r in spark.createDataFrame(rows, "t string").select(tokens.response_warnings(F.col("t"), ["You are Bob."])).collect()]
    assert told == [["repetition"], ["empty"], ["whitespace only"], ["prompt leakage"], []]


def test_dataset_states(spark, root):
    m = DatasetManager(spark, str(root))
    assert m.inspect("shop") == State.MISSING
    items, index = m.load("shop")
    assert items.count() == 5 and m.inspect("shop") == State.COMPLETE and index.kind == "flat_ip"
    other = DatasetManager(spark, str(root), config={"provider": "other", "index": "flat_ip"})
    assert other.inspect("shop") == State.STALE_EMBEDDINGS
    other.load("shop")
    assert other.inspect("shop") == State.COMPLETE and m.inspect("shop") == State.STALE_EMBEDDINGS
    (root / "shop" / "menu_items.csv").write_text(MENU + "Tea,3,0,1,Asian,Drink,,water\n")
    assert other.inspect("shop") == State.STALE and other.load("shop")[0].count() == 6
    (root / "shop" / "artifacts" / "facts.json").write_text("{")
    assert other.inspect("shop") == State.CORRUPT
    (root / "shop" / "menu_items.csv").write_text("a,b\n1,2\n")
    with pytest.raises(BuildError):
        other.load("shop")
    with pytest.raises(FileNotFoundError):
        m.load("nowhere")


@pytest.mark.parametrize(
    "query,rules,want",
    [
        ("high protein under 150", [Rule("protein_g_per_serving", ">=", 30), Rule("price", "<=", 150)], "Protein Shake"),
        ("cheap dinner", [Rule("price", "<=", 10)], "Pasta Primavera"),
        ("diet drink", [Rule("item_type", "exact", "Drink")], "Diet Soda"),
    ],
)
def test_scenarios(spark, root, query, rules, want):
    df = catalogue.with_row_id(catalogue.read_csv(spark, str(catalogue.discover(catalogue.resolve(str(root), "shop")))))
    items = text.build_text(df)[0]
    vectors = embedding.embed(items.select("row_id", "search_text"), "search_text")
    found = search.attach(search.search(vectors, embedding.hash_provider()([query])[0].tolist(), 5).withColumnRenamed("score", "semantic_similarity").drop("rank"), df)
    top = ranking.rank(filtering.passed(found, rules), ranking.Config((ranking.Factor("SemanticScore", 0.4), ranking.Factor("PriceScore", 0.3, invert=True)), max_results=1))
    assert top.first()["recipe_name"] == want


def test_stages_and_sessions(spark):
    p, seen = Pipeline(), []
    p.register("double", lambda df: df.withColumn("x", F.col("x") * 2))
    p.register("broken", lambda df: df.select("no such column"))
    p.register("first", lambda df: df.withColumn("x", F.col("x") + 1), 0)
    p.events.on("stage_failed", lambda **k: seen.append(k["stage"]))
    assert p.run(spark.createDataFrame([(1,)], "x int")).first()["x"] == 4 and seen == ["broken"] and "broken" in p.failures
    p.remove("broken")
    p.replace("double", lambda df: df)
    assert p.names() == ["first", "double"]
    s = Sessions()
    s.append("a", "User", "hi")
    s.append("", "User", "lost")
    assert s.turns("a") == [("User", "hi")] and s.as_table(spark).count() == 1
