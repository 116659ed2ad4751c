"""Registered queries on sources, features, rules, texts and embeddings that the other modules' queries don't reach, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, metrics, predicates, text
from ..functions import vectors as V
from ..operators import capability, embedding, filtering, quality, ranking, schema, search
from ..operators.filtering import Config, Rule
from ..operators.ranking import Factor, Objective
from ..sources import catalogue
from ..sources.tables import shared_folder
from ..streaming.sessions import session_table
from .queries import FACTORS, ITEMS, NESTED, RULED, RULES, VEC, WEIGHTED, Query, _items, _vectors, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _place(s: SparkSession, what: str) -> str:
    return f"{shared_folder(s)}/{what}-{uuid.uuid4().hex}"


# ---- sources ---------------------------------------------------------------------------------------------------------
def _csv(s: SparkSession, d: str) -> DataFrame:
    """Conversations as CSV, texts with line ends and quotes, in several files, read back by splits."""
    at = _place(s, "csv")
    table(s, d, "conversations").repartition(3).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(at)
    return catalogue.read_csv(s, at, table(s, d, "conversations").schema)


_add("source_csv", _csv, "SELECT conv_id, turn, role, text FROM conversations")


def _stored_items(s: SparkSession, d: str) -> DataFrame:
    at = _place(s, "items")
    catalogue.write_items(_items(s, d), at)
    return catalogue.read_items(s, at).select("row_id", "recipe_name", "price")


_add("source_items", _stored_items, f"SELECT row_id, recipe_name, price FROM {ITEMS}")


def _stored_embeddings(s: SparkSession, d: str) -> DataFrame:
    at = _place(s, "embeddings")
    catalogue.write_embeddings(_vectors(s, d), at)
    vectors, facts = catalogue.read_embeddings(s, at)
    return vectors.select("row_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("square"), F.lit(facts["rows"]).alias("rows"), F.lit(facts["dim"]).alias("dim"))


_add("source_embeddings", _stored_embeddings, f"SELECT row_id, round(list_inner_product(v, v), 6) AS square, (SELECT count(*) FROM embeddings)::INT AS rows, (SELECT max(len(embedding)) FROM embeddings)::INT AS dim FROM {VEC}")
_add("source_row_ids", lambda s, d: catalogue.with_row_id(table(s, d, "lineitem").select("l_suppkey", "l_returnflag")).agg(F.count("*").alias("rows"), F.count_distinct("row_id").alias("ids")), "SELECT count(*) AS rows, count(*) AS ids FROM lineitem")


# ---- features --------------------------------------------------------------------------------------------------------
def _parts(s: SparkSession, d: str, **columns) -> DataFrame:
    """Columns of items, made of those of part: as SQL, or as columns."""
    return table(s, d, "part").select(F.col("p_partkey").alias("row_id"), *((F.expr(e) if isinstance(e, str) else e).alias(c) for c, e in columns.items()))


_key = lambda n, k=0: ((F.col("p_partkey") + k) % n).cast("double")
_add(
    "feature_sodium_score",
    lambda s, d: features.engineer(_parts(s, d, calories_per_serving=_key(600), sodium_mg_per_serving=_key(280), sugar_g_per_serving=_key(9), saturated_fat_g_per_serving=_key(7), fiber_g_per_serving=_key(11), protein_g_per_serving=_key(40)))[0].select("row_id", "is_low_sodium", "is_high_fiber", F.round("nutrition_score", 6).alias("nutrition_score")),
    "SELECT p_partkey AS row_id, p_partkey % 280 < 140 AS is_low_sodium, p_partkey % 11 >= 5 AS is_high_fiber, round(2.0 * (p_partkey % 11) + p_partkey % 40 - 0.05 * (p_partkey % 280) - p_partkey % 9 - 2 * (p_partkey % 7), 6)::DOUBLE AS nutrition_score FROM part",
)
_add(
    "feature_densities",
    lambda s, d: features.engineer(_items(s, d))[0].select("row_id", *(F.round(c, 6).alias(c) for c in ("carb_density", "fat_density", "fiber_density"))),
    f"SELECT row_id, round(coalesce(carbs / nullif(cal, 0), 0), 6) AS carb_density, round(coalesce(fat / nullif(cal, 0), 0), 6) AS fat_density, round(coalesce(fiber / nullif(cal, 0), 0), 6) AS fiber_density FROM {ITEMS}",
)
_DIETS = "CASE WHEN p_size % 4 = 0 THEN 'Keto, Paleo' WHEN p_size % 4 = 1 THEN 'Vegan' END"
_HEALTH = "CASE WHEN p_size % 5 = 0 THEN 'Vegan; Halal' WHEN p_size % 5 = 1 THEN 'Gluten-Free' WHEN p_size % 5 = 2 THEN 'Dairy Free, Vegetarian' END"
_add(
    "feature_labels",
    lambda s, d: features.engineer(_parts(s, d, diet_labels=_DIETS, health_labels=_HEALTH, carbs_g_per_serving=_key(50), protein_g_per_serving=_key(30)))[0].select("row_id", "is_vegan", "is_vegetarian", "is_gluten_free", "is_dairy_free", "is_halal", "is_keto", "is_high_protein"),
    "SELECT p_partkey AS row_id, h = 0 AS is_vegan, h IN (0, 2) AS is_vegetarian, h = 1 AS is_gluten_free, h = 2 AS is_dairy_free, h = 0 AS is_halal, p_size % 4 = 0 OR p_partkey % 50 < 20 AS is_keto, p_partkey % 30 >= 15 AS is_high_protein FROM (SELECT *, p_size % 5 AS h FROM part)",
)
_MEAL = "element_at(array('Tea time', 'SNACK', 'midday meal', 'Dessert', 'late night'), int(p_partkey % 5) + 1)"
_DISH = "element_at(array('Side Dish', 'apple pie', 'starter', 'soup', 'Pudding', 'main', 'cookie jar'), int(p_partkey % 7) + 1)"
_add(
    "feature_snack_dessert",
    lambda s, d: features.engineer(_parts(s, d, meal_type=_MEAL, dish_type=_DISH))[0].select("row_id", "is_snack", "is_dessert", "is_lunch", "is_dinner"),
    "SELECT p_partkey AS row_id, m IN (0, 1) OR k IN (0, 2) AS is_snack, m = 3 OR k IN (1, 4, 6) AS is_dessert, m = 2 AS is_lunch, m = 4 AS is_dinner FROM (SELECT *, p_partkey % 5 AS m, p_partkey % 7 AS k FROM part)",
)
_add(
    "feature_price_labels",
    lambda s, d: features.engineer(_parts(s, d, price=_key(40)))[0].select("row_id", "budget_category", "price_level", "price_bucket"),
    "SELECT p_partkey AS row_id, CASE WHEN p <= 10 THEN 'budget' WHEN p <= 25 THEN 'mid-range' ELSE 'premium' END AS budget_category, CASE WHEN p <= 10 THEN '$' WHEN p <= 25 THEN '$$' ELSE '$$$' END AS price_level, CASE WHEN p <= 10 THEN '<=$10' WHEN p <= 25 THEN '$10-$25' ELSE '>$25' END AS price_bucket FROM (SELECT *, p_partkey % 40 AS p FROM part)",
)
_add(
    "metric_lists_and_weights",
    lambda s, d: metrics.with_metrics(_parts(s, d, ingredients=F.split("p_name", " "), calories=F.col("p_size").cast("double"), weight_g=_key(300)), "ingredient_count", "calories_per_100g").select("row_id", F.col("ingredient_count").cast("long").alias("ingredient_count"), F.round("calories_per_100g", 6).alias("calories_per_100g")),
    "SELECT p_partkey AS row_id, len(string_split(p_name, ' ')) AS ingredient_count, round(CASE WHEN p_partkey % 300 = 0 THEN 0 ELSE p_size / (p_partkey % 300) END * 100, 6)::DOUBLE AS calories_per_100g FROM part",
)


def _custom_metric(s: SparkSession, d: str) -> DataFrame:
    """A metric and an operator of the user's own, in one rule."""
    metrics.register("price_per_letter", lambda df: F.col("price") / F.char_length("recipe_name"))
    predicates.register("divisible_by", lambda c, value, context: F.coalesce(F.floor(c) % value == 0, F.lit(False)))
    try:
        return filtering.passed(_items(s, d), [Rule("price_per_letter", "divisible_by", 7)]).select("row_id")
    finally:
        metrics.METRICS.pop("price_per_letter")
        predicates.PREDICATES.pop("divisible_by")


_add("filter_custom", _custom_metric, f"SELECT row_id FROM {ITEMS} WHERE floor(price / length(recipe_name))::INT % 7 = 0")

# ---- rules -----------------------------------------------------------------------------------------------------------
_add(
    "filter_schema_rules",
    lambda s, d: _items(s, d).select("row_id").join(filtering.passed(_items(s, d), [Rule("no_such_column", "not_exists"), Rule("price", "exists"), Rule("price", "<", 950)], Config(strict=True)).select("row_id", F.lit(True).alias("kept")), "row_id", "left").join(filtering.passed(_items(s, d), [Rule("price", "not_exists")]).select("row_id", F.lit(True).alias("none")), "row_id", "left").select("row_id", "kept", "none"),
    f"SELECT row_id, CASE WHEN price < 950 THEN true END AS kept, NULL::BOOLEAN AS none FROM {ITEMS}",
)
_add("filter_unknown_operator", lambda s, d: filtering.passed(_items(s, d), [Rule("price", "no such operator", 1), Rule("price", "<", 930)]).select("row_id"), f"SELECT row_id FROM {ITEMS} WHERE price < 930")
_add("filter_bad_threshold", lambda s, d: filtering.passed(_items(s, d), [Rule("price", "<", "cheap"), Rule("rating", ">", 4)]).select("row_id"), f"SELECT row_id FROM {ITEMS} WHERE rating > 4")
_add("filter_candidate_scores", lambda s, d: filtering.candidate_scores(filtering.apply_rules(_items(s, d), RULES)).select("row_id", F.col("soft_score").cast("double").alias("soft_score")), f"SELECT row_id, soft::DOUBLE AS soft_score FROM {RULED} WHERE r1 AND r2 AND g")
_add(
    "filter_json",
    lambda s, d: filtering.as_json(filtering.apply_rules(_items(s, d), [*RULES[:2], NESTED])).select(F.get_json_object("json", "$.row_id").cast("long").alias("row_id"), F.get_json_object("json", "$.hard_passed").cast("boolean").alias("hard_passed"), F.get_json_object("json", "$.rejection_reason").alias("reason"), F.get_json_object("json", "$.matched_rules[0]").alias("matched")),
    f"SELECT row_id, r1 AND r2 AND g AS hard_passed, CASE WHEN NOT r1 THEN 'Hard rule failed: calories_per_serving > 5' WHEN NOT r2 THEN 'Hard rule failed: price <= 960' WHEN NOT g THEN 'Hard group failed: cheap brass or good mid-size' END AS reason, CASE WHEN r1 THEN 'calories_per_serving' END AS matched FROM {RULED}",
)

# ---- search and embeddings -------------------------------------------------------------------------------------------
_add(
    "search_normalised_query",
    lambda s, d: search.search(_vectors(s, d), [3.0] + [1.0] * 63, 10, normalise=True).select("row_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")),
    f"SELECT row_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM (SELECT row_id, (2 * v[1] + list_sum(v)) / sqrt(9 + 63) / greatest(sqrt(list_inner_product(v, v)), 1e-9) AS score FROM {VEC}) ORDER BY score DESC, row_id LIMIT 10",
)
_add(
    "search_strategies",
    lambda s, d: (lambda index: search.STRATEGIES["exact"](index, [1.0] + [0.0] * 63, 5).select("row_id", F.lit("exact").alias("strategy")).unionByName(search.STRATEGIES["hybrid"](index, [1.0] + [0.0] * 63, 5).select("row_id", F.lit("hybrid").alias("strategy"))))(search.build_index(_vectors(s, d), "flat_ip")),
    f"SELECT row_id, unnest(['exact', 'hybrid']) AS strategy FROM (SELECT row_id FROM {VEC} ORDER BY v[1] DESC, row_id LIMIT 5)",
)
_add(
    "search_custom_step",
    lambda s, d: table(s, d, "benchmark").select("item_id", search.QuerySteps(most_chars=40).then(lambda c: F.regexp_replace(c, "the ", "")).apply(F.col("text")).alias("query")),
    "SELECT item_id, CASE WHEN q <> '' THEN q WHEN trim(coalesce(text, '')) <> '' THEN trim(text) ELSE 'unknown' END AS query FROM (SELECT *, regexp_replace(substr(lower(trim(text)), 1, 40), 'the ', '', 'g') AS q FROM benchmark)",
)
_HASHED = "(SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS w FROM benchmark)"
_DIGEST = "(SELECT item_id, sha256(w || '_' || k) AS h FROM " + _HASHED + ", range(8) AS r(k))"
_BYTE = lambda k: f"('0x' || h[{2 * k + 1}:{2 * k + 2}])::INT"
_DIM = f"(SELECT item_id, ({_BYTE(0)}::BIGINT + {_BYTE(1)} * 256::BIGINT + {_BYTE(2)} * 65536::BIGINT + {_BYTE(3)} * 16777216::BIGINT) % 384 AS dim, count(*) AS n FROM {_DIGEST} GROUP BY ALL)"
_add("embed_hash_dimensions", lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(embedding.hash_bag(F.col("text"))).alias("dim")).groupBy("item_id", "dim").agg(F.count("*").alias("n")), f"SELECT * FROM {_DIM}")
_add(
    "embed_texts_plain",
    lambda s, d: embedding.embed(table(s, d, "benchmark"), "text", embedding.hash_provider(noise=0.0)).select("item_id", F.posexplode("embedding").alias("dim", "value")).where("value <> 0").select("item_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 5).alias("value")),
    f"SELECT item_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 5)::DOUBLE AS value FROM {_DIM}",
)
_add(
    "embed_statistics",
    lambda s, d: embedding.statistics(embedding.embed(table(s, d, "benchmark"), "text", embedding.hash_provider(noise=0.0))),
    "SELECT count(*) AS n, count(DISTINCT trim(coalesce(text, ''))) AS n_distinct, 0::BIGINT AS n_failed, 384::INT AS dim FROM benchmark",
)


# ---- ranking ---------------------------------------------------------------------------------------------------------
def _custom_ranking(s: SparkSession, d: str) -> DataFrame:
    """A scorer and a normaliser of the user's own."""
    ranking.register_scorer("NameLength", lambda df, p: F.char_length("recipe_name") * p.get("times", 1))
    try:
        factors = (Factor("NameLength", 0.5, "identity", params={"times": 2}), Factor("RatingScore", 0.5, "own", custom=lambda c: c * c / 25))
        return ranking.rank_factors(_items(s, d), factors).select("row_id", F.round("final_score", 6).alias("final_score"))
    finally:
        ranking.SCORERS.pop("NameLength")


_add("rank_custom", _custom_ranking, f"SELECT row_id, round(0.5 * 2 * length(recipe_name) + 0.5 * rating * rating / 25, 6)::DOUBLE AS final_score FROM {ITEMS}")
_add(
    "rank_strategy_names",
    lambda s, d: (lambda one: one("ml").unionByName(one("hybrid")).unionByName(one("pareto", (Objective("rating"),))).groupBy("row_id", "final_score").agg(F.count("*").alias("n")))(lambda name, objectives=(): ranking.rank(_items(s, d), ranking.Config(FACTORS if not objectives else (), objectives=objectives, **({"optimizer": name} if objectives else {"strategy": name}))).select("row_id", F.round("final_score", 6).alias("final_score"))),
    f"SELECT row_id, final_score, count(*) AS n FROM (SELECT row_id, round({WEIGHTED}, 6) AS final_score FROM {ITEMS} UNION ALL SELECT row_id, round({WEIGHTED}, 6) FROM {ITEMS} UNION ALL SELECT row_id, round((rating - min(rating) OVER ()) / (max(rating) OVER () - min(rating) OVER ()), 6) FROM {ITEMS}) GROUP BY ALL",
)
_add(
    "objective_boolean_flags",
    lambda s, d: (lambda df: df.select("row_id", ranking.objective_value(df, Objective("flag", "boolean")).alias("yes"), ranking.objective_value(df, Objective("word", "boolean", target=False)).alias("no"), ranking.objective_value(df, Objective("words", "categorical", target=["red", "blue"])).alias("hit")))(_parts(s, d, flag=F.col("p_partkey") % 3 == 0, word="element_at(array('yes', 'TRUE', '1', 'no', '0'), int(p_partkey % 5) + 1)", words=F.split("p_name", " "))),
    "SELECT p_partkey AS row_id, (p_partkey % 3 = 0)::INT::DOUBLE AS yes, (p_partkey % 5 >= 3)::INT::DOUBLE AS no, list_has_any(string_split(p_name, ' '), ['red', 'blue'])::INT::DOUBLE AS hit FROM part",
)

# ---- texts -----------------------------------------------------------------------------------------------------------
_SHOWN = {"recipe_name": "p_name", "ingredients": "split(p_name, ' ')", "ingredient_count": "size(split(p_name, ' '))", "diet_labels": "p_type", "is_vegan": "p_size > 25", "is_halal": "p_size % 2 = 0"}
_WHOLE = [text.Template("own", "own_text", ("dietary", "ingredients"))]


def _language(name: str, language: str) -> None:
    of = lambda key: text.label(key, language).replace("'", "''")
    flags = f"concat_ws(', ', CASE WHEN p_size > 25 THEN '{of('vegan')}' END, CASE WHEN p_size % 2 = 0 THEN '{of('halal')}' END)"
    diet = f"concat_ws(chr(10), '{of('dietary_profile')}:', '- {of('diet_labels')}: ' || p_type, CASE WHEN {flags} <> '' THEN '- {of('dietary_attributes')}: ' || {flags} END)"
    parts = f"concat_ws(chr(10), '{of('ingredients')}:', '- ' || replace(p_name, ' ', chr(10) || '- '), '{of('total_ingredients')}: ' || len(string_split(p_name, ' ')))"
    _add(name, lambda s, d: text.build_text(_parts(s, d, **_SHOWN), language, templates=_WHOLE)[0].select("row_id", "own_text"), f"SELECT p_partkey AS row_id, concat_ws(chr(10) || chr(10), {diet}, {parts}) AS own_text FROM part")


for _name, _code in (("text_dietary_ingredients", "en"), ("text_french", "fr"), ("text_arabic", "ar")):
    _language(_name, _code)

# ---- quality, schema, capabilities -----------------------------------------------------------------------------------
_add(
    "profile_no_numbers",
    lambda s, d: quality.profile_missing(_parts(s, d, ratio=F.when(F.col("p_size") % 3 == 0, F.lit(float("nan"))).when(F.col("p_size") % 3 == 1, F.col("p_retailprice"))), ["ratio"]),
    "SELECT 'ratio' AS column_name, round(100.0 * count(*) FILTER (WHERE p_size % 3 <> 1) / count(*), 2)::DOUBLE AS missing_percent, round(100.0 * count(*) FILTER (WHERE p_size % 3 <> 1) / count(*), 2) > 50 AS warning FROM part",
)
_add("validate_rows", lambda s, d: quality.violating_rows(table(s, d, "customer"), "c_acctbal", quality.positive, "c_custkey").select("c_custkey", F.col("value").cast("double").alias("value")), "SELECT c_custkey, c_acctbal::DOUBLE AS value FROM customer WHERE c_acctbal < 0")
_STOCK = capability.Registry([capability.Capability("Clicks", "Event", ("event_type",), {"event_type": ("click",)}), capability.Capability("Stock", "Event", ("in_stock",)), capability.Capability("Odd", "Event", ("event_type",), {"event_type": ("no such event",)}), capability.Capability("Times", "Event", ("ts",))])
_add(
    "capability_share",
    lambda s, d: capability.score(capability.detect(table(s, d, "events"), _STOCK)),
    "SELECT 1 + c AS enabled, 2 - c AS partial, 1::BIGINT AS disabled, round(100.0 * (1 + c) / 4, 2)::DOUBLE AS score FROM (SELECT count(DISTINCT event_type) FILTER (WHERE lower(event_type) = 'click') AS c FROM events)",
)
_NAMED = "p_name || ' ' || element_at(array('Latte', 'cheesecake', 'lemonade', 'garden salad', 'x', 'Iced Tea'), int(p_partkey % 6) + 1)"
_NAMED_SQL = "p_name || ' ' || ['Latte', 'cheesecake', 'lemonade', 'garden salad', 'x', 'Iced Tea'][p_partkey % 6 + 1]"
_add(
    "capability_item_type_counts",
    lambda s, d: features.engineer(_parts(s, d, recipe_name=_NAMED))[0].groupBy("item_type").agg(F.count("*").alias("n")),
    "SELECT item_type, count(*) AS n FROM (SELECT CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in words) + f" THEN '{name}'" for name, words in features.ITEM_TYPES) + f" ELSE 'main_course' END AS item_type FROM (SELECT {_NAMED_SQL} AS t FROM part)) GROUP BY item_type",
)



def _aliases(s: SparkSession, d: str) -> DataFrame:
    """A column by an alias of the user's own, one whose field is taken, one that nothing knows; the report beside each row."""
    mapper = schema.SchemaMapper()
    mapper.add_alias("price", "Cost of It")
    df, told = mapper.fit_transform(table(s, d, "part").select(F.col("p_name").alias("Dish Name"), F.col("p_retailprice").alias("cost of it"), F.col("p_size").alias("Menu-Price"), F.col("p_type").alias("odd thing")))
    return df.withColumns({"coverage": F.lit(told.coverage), "statuses": F.lit(",".join(x["status"] for x in told.diagnostics))})


_add("schema_aliases", _aliases, "SELECT p_name AS recipe_name, p_retailprice AS price, p_size AS menu_price, p_type AS odd_thing, 50.0::DOUBLE AS coverage, 'MAPPED,MAPPED,REJECTED,UNKNOWN' AS statuses FROM part")

# ---- sessions: the turns of all conversations as one stream of events, a minute a turn
_add(
    "session_turns",
    lambda s, d: session_table(table(s, d, "events").select(F.col("user_id").cast("string").alias("conv_id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "purchase", "reset").otherwise("user").alias("role"), F.col("event_id").cast("string").alias("text")), 3600).groupBy("conv_id", "begun").agg(F.count("*").alias("turns"), F.max("turn").alias("last")).select("conv_id", F.unix_millis("begun").alias("begun"), "turns", "last"),
    """WITH e AS (SELECT user_id::VARCHAR AS conv_id, epoch_us(ts::TIMESTAMP) // 1000 AS t, event_type = 'purchase' AS reset, CASE WHEN event_type = 'purchase' THEN 'reset' ELSE 'user' END AS role, event_id::VARCHAR AS text FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    n AS (SELECT *, lag(CASE WHEN NOT reset THEN t END) OVER w AS before, coalesce(lag(reset) OVER w, true) AS fresh FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY t, role, text)),
    g AS (SELECT *, sum((reset OR fresh OR coalesce(t - before > 3600000, false))::INT) OVER (PARTITION BY conv_id ORDER BY t, role, text) AS session FROM n)
    SELECT conv_id, min(t) AS begun, count(*) AS turns, count(*) - 1 AS last FROM g WHERE NOT reset GROUP BY conv_id, session""",
)

# ---- SQL for queries of the first module that had none
SQL["embed_hash_bag"] = SQL["embed_hash_dimensions"]
SQL["capability_item_types"] = "SELECT item_type, count(*) AS n FROM (SELECT CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(p_name), '{w}')" for w in words) + f" THEN '{name}'" for name, words in features.ITEM_TYPES) + " ELSE 'main_course' END AS item_type FROM part) GROUP BY item_type"
_scale = lambda x: f"(({x}) - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())"
_each = [("RatingScore", f"0.5 * {_scale('rating')}"), ("PriceScore", f"0.3 * (1 - {_scale('price')})"), ("NutritionScore", f"0.2 * {_scale('1 / (1 + abs(cal - 20))')}")]
SQL["rank_explain"] = f"""WITH p AS (SELECT row_id, {WEIGHTED} AS s, {", ".join(f"{e} AS v{k}" for k, (_, e) in enumerate(_each))} FROM {ITEMS}),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, row_id) AS rank FROM p ORDER BY s DESC, row_id LIMIT 25),
    e AS (SELECT row_id, rank, unnest({[n for n, _ in _each]}) AS name, unnest([v0, v1, v2]) AS v FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, name DESC) AS place FROM e)
    SELECT row_id, rank, string_agg(name || ' ' || format('{{:+.4f}}', v), ', ' ORDER BY place) AS explanation FROM n WHERE place <= 2 GROUP BY row_id, rank"""
