"""The registered queries of the engine over the driver's tables, each with the SQL that tells the same.

Every query runs over its whole tables.  ``part`` stands in for a catalogue, ``embeddings`` for its vectors, ``documents`` and
``conversations`` for texts, ``events`` for instants.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, text, tokens
from ..functions import vectors as V
from ..functions.metrics import with_metrics
from ..operators import capability, embedding, filtering, prompts, quality, ranking, schema, search
from ..operators.filtering import Config, Group, Rule
from ..operators.ranking import Factor, Objective

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- one-rule filters ------------------------------------------------------------------------------------------------


def _filter(name: str, of: str, keys: list[str], rule: Rule, condition: str, prepare: Callable[[DataFrame], DataFrame] | None = None, source: str | None = None, config: Config | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, of)
        df = prepare(df) if prepare else df
        return filtering.passed(df, [rule], config).select(*keys)

    _add(name, run, f"SELECT {', '.join(keys)} FROM {source or of} WHERE {condition}")


LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
for op, name, sql in (("==", "eq", "="), ("!=", "neq", "<>"), (">", "gt", ">"), (">=", "gte", ">="), ("<", "lt", "<"), ("<=", "lte", "<=")):
    _filter(f"filter_numeric_{name}", "lineitem", LINE, Rule("l_quantity", op, 30), f"l_quantity {sql} 30" + (" OR l_quantity IS NULL" if name == "neq" else ""))
PART = ["p_partkey", "p_name", "p_retailprice"]
_filter("filter_approx_equal", "part", PART, Rule("p_retailprice", "approximately_equal", 950, tolerance=0.02), "abs(p_retailprice - 950) <= 0.02 * 950")
_filter("filter_between", "orders", ["o_orderkey", "o_totalprice"], Rule("o_totalprice", "between", [50000, 150000]), "o_totalprice BETWEEN 50000 AND 150000")
_filter("filter_outside", "orders", ["o_orderkey", "o_totalprice"], Rule("o_totalprice", "outside", [50000, 150000]), "o_totalprice < 50000 OR o_totalprice > 150000")
_filter("filter_text_contains", "part", PART, Rule("p_name", "contains", "re"), "contains(coalesce(p_name, 'nan'), 're')")
_filter("filter_text_icontains", "documents", ["doc_id", "source"], Rule("text", "icontains", "THE AND"), "contains(lower(coalesce(text, 'nan')), 'the and')")
_filter("filter_text_startswith", "part", PART, Rule("p_name", "startswith", "b"), "starts_with(coalesce(p_name, 'nan'), 'b')")
_filter("filter_text_endswith", "part", PART, Rule("p_name", "endswith", "t"), "ends_with(coalesce(p_name, 'nan'), 't')")
_filter("filter_text_exact", "part", ["p_partkey", "p_brand"], Rule("p_brand", "exact", "Brand#11"), "coalesce(p_brand, 'nan') = 'Brand#11'")
_filter("filter_regex", "part", PART, Rule("p_name", "regex", "^(red|blue) "), "regexp_matches(coalesce(p_name, 'nan'), '^(red|blue) ')")
_filter("filter_regex_invalid", "part", PART, Rule("p_name", "regex", "(["), "false")


def _words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", F.split("p_name", " "))


SPLIT = "string_split(p_name, ' ')"
_filter("filter_list_contains", "part", PART, Rule("words", "list_contains", "red"), f"list_contains({SPLIT}, 'red')", _words)
_filter("filter_list_any", "part", PART, Rule("words", "contains_any", ["red", "green"]), f"list_has_any({SPLIT}, ['red', 'green'])", _words)
_filter("filter_list_overlap", "part", PART, Rule("words", "overlap", ["blue"]), f"list_has_any({SPLIT}, ['blue'])", _words)
_filter("filter_list_all", "part", PART, Rule("words", "contains_all", ["red"]), f"list_has_all({SPLIT}, ['red'])", _words)
_filter("filter_list_subset", "part", PART, Rule("words", "subset", ["red", "blue", "green", "bolt", "nut", "ring"]), f"list_has_all(['red', 'blue', 'green', 'bolt', 'nut', 'ring'], {SPLIT})", _words)
_filter("filter_list_superset", "part", PART, Rule("words", "superset", ["green"]), f"list_has_all({SPLIT}, ['green'])", _words)
_filter("filter_bool_true", "labels", ["doc_id", "quality"], Rule("quality", "is_true"), "quality = 1")
_filter("filter_bool_false", "labels", ["doc_id", "toxic"], Rule("toxic", "is_false"), "coalesce(toxic <> 1, true)")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")


LABELLED = "documents LEFT JOIN labels USING (doc_id)"


def _on_labelled(name: str, rule: Rule, condition: str) -> None:
    _add(name, lambda s, d: filtering.passed(_labelled(s, d), [rule]).select("doc_id", "lang", "quality"), f"SELECT doc_id, lang, quality FROM {LABELLED} WHERE {condition}")


_on_labelled("filter_null", Rule("quality", "is_null"), "quality IS NULL")
_on_labelled("filter_not_null", Rule("quality", "not_null"), "quality IS NOT NULL")
_on_labelled("filter_in", Rule("quality", "in", [1, 5]), "coalesce(quality IN (1, 5), false)")
_on_labelled("filter_not_in", Rule("quality", "not_in", [1]), "coalesce(quality NOT IN (1), true)")
_on_labelled("filter_not_equal_missing", Rule("quality", "!=", 1), "quality IS NULL OR quality <> 1")
_on_labelled("filter_exists", Rule("quality", "exists"), "true")

NOW = dt.datetime(2024, 1, 15, 12)
EVENT = ["event_id", "event_type"]
for name, rule, condition in (
    ("before", Rule("ts", "before", "2024-01-10 00:00:00"), "ts < TIMESTAMP '2024-01-10 00:00:00'"),
    ("after", Rule("ts", "after", "2024-01-20T06:00:00"), "ts > TIMESTAMP '2024-01-20 06:00:00'"),
    ("between", Rule("ts", "between_dates", ["2024-01-10", "2024-01-12"]), "ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'"),
    ("today", Rule("ts", "today"), "CAST(ts AS DATE) = DATE '2024-01-15'"),
    ("last_days", Rule("ts", "last_days", 3), "ts >= TIMESTAMP '2024-01-12 12:00:00'"),
    ("next_days", Rule("ts", "next_days", 2), "ts <= TIMESTAMP '2024-01-17 12:00:00'"),
):
    _filter(f"filter_date_{name}", "events", EVENT, rule, condition, config=Config(now=NOW))

# ---- metrics, groups, hard and soft rules ----------------------------------------------------------------------------


def _items(spark: SparkSession, d: str) -> DataFrame:
    """part as a catalogue with the columns that metrics name."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("recipe_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").cast("double").alias("calories_per_serving"),
        F.pmod("p_partkey", F.lit(40)).cast("double").alias("protein_g_per_serving"),
        F.pmod("p_partkey", F.lit(7)).cast("double").alias("carbs_g_per_serving"),
        F.pmod("p_partkey", F.lit(5)).cast("double").alias("fat_g_per_serving"),
        F.pmod("p_partkey", F.lit(3)).cast("double").alias("fiber_g_per_serving"),
        F.pmod("p_partkey", F.lit(4)).cast("double").alias("servings"),
        (F.pmod("p_partkey", F.lit(50)) / 10).alias("rating"),
    )


ITEMS = "(SELECT p_partkey AS row_id, p_name AS recipe_name, p_type AS category, p_retailprice AS price, p_size::DOUBLE AS cal, (p_partkey % 40)::DOUBLE AS protein, (p_partkey % 7)::DOUBLE AS carbs, (p_partkey % 5)::DOUBLE AS fat, (p_partkey % 3)::DOUBLE AS fiber, (p_partkey % 4)::DOUBLE AS servings, (p_partkey % 50) / 10.0::DOUBLE AS rating FROM part)"
MACROS = "(protein + carbs + fat)"
METRIC_SQL = {
    "protein_to_calorie_ratio": "CASE WHEN cal = 0 THEN 0 ELSE protein / cal END",
    "net_carbs": "carbs - fiber",
    "fat_percentage": f"CASE WHEN {MACROS} = 0 THEN 0 ELSE fat / nullif({MACROS}, 0) END * 100",
    "carb_percentage": f"CASE WHEN {MACROS} = 0 THEN 0 ELSE carbs / nullif({MACROS}, 0) END * 100",
    "protein_percentage": f"CASE WHEN {MACROS} = 0 THEN 0 ELSE protein / nullif({MACROS}, 0) END * 100",
    "price_per_serving": "CASE WHEN servings = 0 THEN 0 ELSE price / nullif(servings, 0) END",
    "protein_per_dollar": "CASE WHEN price = 0 THEN 0 ELSE protein / price END",
    "rating_per_price": "CASE WHEN price = 0 THEN 0 ELSE rating / price END",
    "ingredient_count": "0",
    "calories_per_100g": "cal / 100 * 100",
}


def _metric(name: str, sql: str) -> None:
    _add(f"metric_{name}", lambda s, d: with_metrics(_items(s, d), name).select("row_id", F.round(F.col(name).cast("double"), 6).alias("value")), f"SELECT row_id, round(({sql})::DOUBLE, 6) AS value FROM {ITEMS}")


for _name, _sql in METRIC_SQL.items():
    _metric(_name, _sql)
_add("metric_filter", lambda s, d: filtering.passed(_items(s, d), [Rule("protein_per_dollar", ">", 0.02), Rule("net_carbs", "<=", 2)]).select("row_id"), f"SELECT row_id FROM {ITEMS} WHERE protein / price > 0.02 AND carbs - fiber <= 2")

NESTED = Group("OR", (Group("AND", (Rule("price", "<", 950), Rule("category", "icontains", "brass"))), Group("AND", (Rule("rating", ">=", 4), Rule("calories_per_serving", "between", [10, 30]), Rule("price", ">", 1, enabled=False)))), description="cheap brass or good mid-size")
_add("filter_group_and_or", lambda s, d: filtering.passed(_items(s, d), [NESTED]).select("row_id", "category"), f"SELECT row_id, category FROM {ITEMS} WHERE (price < 950 AND contains(lower(category), 'brass')) OR (rating >= 4 AND cal BETWEEN 10 AND 30)")
_add("filter_group_missing_column", lambda s, d: filtering.passed(_items(s, d), [Group("OR", (Rule("price", ">", 99999), Rule("no_such_column", "==", 1)))]).select("row_id"), f"SELECT row_id FROM {ITEMS}")
_add("filter_group_strict", lambda s, d: filtering.passed(_items(s, d), [Group("OR", (Rule("price", ">", 980), Rule("no_such_column", "==", 1)))], Config(strict=True)).select("row_id"), f"SELECT row_id FROM {ITEMS} WHERE price > 980")

RULES = [
    Rule("price", "<=", 960, priority=2),
    Rule("calories_per_serving", ">", 5, priority=1),
    NESTED,
    Rule("rating", ">=", 3, rule_type="SOFT", weight=2.0, reward=1.5, penalty=-0.5),
    Rule("protein_to_calorie_ratio", ">", 1, rule_type="SOFT", weight=1.0, reward=1.0, penalty=0.0),
]
NESTED_SQL = "((price < 950 AND contains(lower(category), 'brass')) OR (rating >= 4 AND cal BETWEEN 10 AND 30))"
SOFT_SQL = "(CASE WHEN rating >= 3 THEN 3.0 ELSE -1.0 END + CASE WHEN protein / cal > 1 THEN 1.0 ELSE 0.0 END)"
RULED = f"(SELECT *, cal > 5 AS r1, price <= 960 AS r2, {NESTED_SQL} AS g, {SOFT_SQL} AS soft FROM {ITEMS})"
_add(
    "filter_hard_soft_score",
    lambda s, d: filtering.apply_rules(_items(s, d), RULES).select("row_id", "hard_passed", F.col("soft_score").cast("double").alias("soft_score")),
    f"SELECT row_id, r1 AND r2 AND g AS hard_passed, CASE WHEN r1 AND r2 AND g THEN soft ELSE 0 END::DOUBLE AS soft_score FROM {RULED}",
)
_add(
    "filter_rejection_reason",
    lambda s, d: filtering.rejected(filtering.apply_rules(_items(s, d), RULES)).select("row_id", "rejection_reason"),
    f"SELECT row_id, CASE WHEN NOT r1 THEN 'Hard rule failed: calories_per_serving > 5' WHEN NOT r2 THEN 'Hard rule failed: price <= 960' ELSE 'Hard group failed: cheap brass or good mid-size' END AS rejection_reason FROM {RULED} WHERE NOT (r1 AND r2 AND g)",
)
_add(
    "filter_matched_failed",
    lambda s, d: filtering.apply_rules(_items(s, d), RULES).select("row_id", F.array_join("matched_rules", "|").alias("matched"), F.array_join("failed_rules", "|").alias("failed")),
    f"""SELECT row_id,
      concat_ws('|', CASE WHEN r1 THEN 'calories_per_serving' END, CASE WHEN r1 AND r2 THEN 'price' END, CASE WHEN r1 AND r2 AND g AND rating >= 3 THEN 'rating' END, CASE WHEN r1 AND r2 AND g AND protein / cal > 1 THEN 'protein_to_calorie_ratio' END) AS matched,
      concat_ws('|', CASE WHEN NOT r1 THEN 'calories_per_serving' END, CASE WHEN r1 AND NOT r2 THEN 'price' END, CASE WHEN r1 AND r2 AND g AND NOT rating >= 3 THEN 'rating' END, CASE WHEN r1 AND r2 AND g AND NOT protein / cal > 1 THEN 'protein_to_calorie_ratio' END) AS failed
    FROM {RULED}""",
)
_add(
    "filter_breakdown",
    lambda s, d: filtering.hard_breakdown(filtering.apply_rules(_items(s, d), RULES)),
    f"SELECT * FROM (SELECT 'calories_per_serving' AS rule_column, count(*) FILTER (WHERE NOT r1) AS n_failed FROM {RULED} UNION ALL SELECT 'price', count(*) FILTER (WHERE r1 AND NOT r2) FROM {RULED}) WHERE n_failed > 0",
)
_add(
    "filter_soft_breakdown",
    lambda s, d: filtering.soft_breakdown(filtering.apply_rules(_items(s, d), RULES)),
    f"""SELECT 'rating' AS rule_column, count(*) FILTER (WHERE rating >= 3) AS rewarded, count(*) FILTER (WHERE NOT rating >= 3) AS penalised, round(sum(CASE WHEN rating >= 3 THEN 3.0 ELSE -1.0 END)::DOUBLE, 4) AS total_delta FROM {RULED} WHERE r1 AND r2 AND g HAVING count(*) > 0
    UNION ALL SELECT 'protein_to_calorie_ratio', count(*) FILTER (WHERE protein / cal > 1), count(*) FILTER (WHERE NOT protein / cal > 1), round(sum(CASE WHEN protein / cal > 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 4) FROM {RULED} WHERE r1 AND r2 AND g HAVING count(*) > 0""",
)
_add(
    "filter_stats",
    lambda s, d: filtering.statistics(filtering.apply_rules(_items(s, d), RULES)),
    f"SELECT count(*) AS n_in, count(*) FILTER (WHERE p) AS n_passed, count(*) FILTER (WHERE NOT p) AS n_rejected, round(coalesce(avg(soft) FILTER (WHERE p), 0)::DOUBLE, 6) AS avg_soft, coalesce(max(soft) FILTER (WHERE p), 0)::DOUBLE AS max_soft, coalesce(min(soft) FILTER (WHERE p), 0)::DOUBLE AS min_soft FROM (SELECT *, r1 AND r2 AND g AS p FROM {RULED})",
)
_add("filter_explain_json", lambda s, d: filtering.as_json(filtering.apply_rules(_items(s, d), RULES)))

# ---- vectors ---------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "row_id")


VEC = "(SELECT vec_id AS row_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
QUERY0 = f"(SELECT v FROM {VEC} WHERE row_id = 0)"
IP = f"(SELECT row_id, label, v, list_inner_product(v, {QUERY0}) AS score FROM {VEC})"
L2 = f"(SELECT row_id, label, v, pow(list_distance(v, {QUERY0}), 2) AS score FROM {VEC})"
_top = lambda src, k, sort: f"SELECT row_id, round(score, 6) AS score, row_number() OVER (ORDER BY score {sort}, row_id) AS rank FROM {src} ORDER BY score {sort}, row_id LIMIT {k}"
_rounded = lambda df: df.select("row_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))
_add("vector_topk_ip", lambda s, d: _rounded(search.search_near(_vectors(s, d), 0, 20)), _top(IP, 20, "DESC"))
_add("vector_topk_l2", lambda s, d: _rounded(search.search_near(_vectors(s, d), 0, 20, "l2")), _top(L2, 20, "ASC"))
_add("vector_topk_threshold", lambda s, d: _rounded(search.search_near(_vectors(s, d), 0, 50, threshold=0.3)), f"SELECT * FROM ({_top(IP, 50, 'DESC')}) WHERE score >= 0.3")
_add(
    "vector_batch_topk",
    lambda s, d: search.batch_search(_vectors(s, d), _vectors(s, d).where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), "embedding"), 5).select("query_id", "row_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")),
    f"SELECT query_id, row_id, round(score, 6) AS score, rank FROM (SELECT q.row_id AS query_id, i.row_id, list_inner_product(i.v, q.v) AS score, row_number() OVER (PARTITION BY q.row_id ORDER BY list_inner_product(i.v, q.v) DESC, i.row_id) AS rank FROM {VEC} i, {VEC} q WHERE q.row_id % 50 = 0) WHERE rank <= 5",
)
_add(
    "vector_normalize",
    lambda s, d: _vectors(s, d).select("row_id", F.round(F.element_at(V.normalise(F.col("embedding")), 1), 6).alias("first"), F.round(V.norm(V.normalise(F.col("embedding"))), 6).alias("norm")),
    f"SELECT row_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(1.0::DOUBLE, 6) AS norm FROM {VEC}",
)
_add("vector_wide", lambda s, d: _vectors(s, d).select("row_id", *V.wide("embedding", 64)), "SELECT vec_id AS row_id, " + ", ".join(f"embedding[{i + 1}] AS dim_{i}" for i in range(64)) + " FROM embeddings")


def _ivf(s: SparkSession, d: str, nprobe: int) -> DataFrame:
    vectors = _vectors(s, d)
    query = [float(x) for x in vectors.where("row_id = 0").first()["embedding"]]
    return _rounded(search.build_index(vectors, "ivf", nlist=8).search(query, 20, nprobe=nprobe))


_add("vector_ivf_topk", lambda s, d: _ivf(s, d, 8), _top(L2, 20, "ASC"))
_add("vector_ivf_topk_probed", lambda s, d: _ivf(s, d, 4))
_add("topk_attach_metadata", lambda s, d: search.attach(_rounded(search.search_near(_vectors(s, d), 0, 10)), _vectors(s, d).select("row_id", "label")).select("row_id", "score", "rank", "label"), f"SELECT t.*, e.label FROM ({_top(IP, 10, 'DESC')}) t JOIN embeddings e ON e.vec_id = t.row_id")
_add(
    "query_normalize",
    lambda s, d: table(s, d, "documents").select("doc_id", search.QuerySteps(strip_punctuation=True).apply(F.col("text")).alias("query")),
    "SELECT doc_id, CASE WHEN q <> '' THEN q WHEN trim(coalesce(text, '')) <> '' THEN trim(text) ELSE 'unknown' END AS query FROM (SELECT doc_id, text, substr(trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 512) AS q FROM documents)",
)

# ---- ranking ---------------------------------------------------------------------------------------------------------


def _norm(name: str, normaliser: str, invert: bool, column: str, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = _items(s, d).withColumn("flat", F.lit(7.0)).select("row_id", F.col(column).alias("x"))
        return ranking.normalised(df, {"x": (normaliser, invert)}).select("row_id", F.round("norm_x", 6).alias("value"))

    _add(name, run, f"SELECT row_id, round(({sql})::DOUBLE, 6) AS value FROM {ITEMS}")


MINMAX = "(price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ())"
_norm("norm_minmax", "min_max", False, "price", MINMAX)
_norm("norm_invert", "min_max", True, "price", f"1 - {MINMAX}")
_norm("norm_zscore", "z_score", False, "price", "least(1, greatest(0, ((price - avg(price) OVER ()) / stddev_samp(price) OVER () + 3) / 6))")
_norm("norm_constant", "min_max", False, "flat", "1.0")


def _score(name: str, scorer: str, params: dict, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = _items(s, d)
        return df.select("row_id", F.round(ranking.scorer(scorer)(df, params).cast("double"), 6).alias("value"))

    _add(f"score_{name}", run, f"SELECT row_id, round(({sql})::DOUBLE, 6) AS value FROM {ITEMS}")


_score("nutrition_proximity", "NutritionScore", {"target": 20}, "1 / (1 + abs(cal - 20))")
_score("metadata_completeness", "MetadataScore", {"keys": ["recipe_name", "servings", "no_such_column"]}, "((recipe_name <> '')::INT + (servings <> 0)::INT) / 3.0")
_score("category_diversity", "DiversityScore", {"column": "category"}, "1.0 / count(*) OVER (PARTITION BY category)")
_score("rating", "RatingScore", {}, "coalesce(rating, 3)")
_score("price", "PriceScore", {}, "coalesce(price, 0)")
_score("penalty", "PenaltyScore", {"key": "servings"}, "coalesce(servings, 0)")
_add("score_popularity", lambda s, d: (lambda df: df.select("row_id", ranking.scorer("PopularityScore")(df, {}).alias("value")))(_sold(s, d)), "SELECT p_partkey AS row_id, coalesce(sum(l_quantity), 0)::DOUBLE AS value FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
_add(
    "score_freshness",
    lambda s, d: (lambda df: df.select("event_id", ranking.scorer("FreshnessScore")(df, {}).alias("value")))(table(s, d, "events").select("event_id", F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).alias("days_since_added"))),
    "SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01')::DOUBLE AS value FROM events",
)


def _sold(s: SparkSession, d: str) -> DataFrame:
    """Items with the quantity sold as order_count; lineitem is summed before the join."""
    sold = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("row_id")).agg(F.sum("l_quantity").alias("order_count"))
    return _items(s, d).join(sold, "row_id", "left")


FACTORS = (Factor("RatingScore", 0.5), Factor("PriceScore", 0.3, invert=True), Factor("NutritionScore", 0.2, params={"target": 20}))
_scored = lambda df: df.select("row_id", F.round("final_score", 6).alias("final_score"))
MM = lambda x: f"(({x}) - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())"
PROX = "1 / (1 + abs(cal - 20))"
WEIGHTED = f"0.5 * {MM('rating')} + 0.3 * (1 - {MM('price')}) + 0.2 * {MM(PROX)}"
_add("rank_weighted", lambda s, d: _scored(ranking.rank_factors(_items(s, d), FACTORS)), f"SELECT row_id, round({WEIGHTED}, 6) AS final_score FROM {ITEMS}")
_add("rank_missing_factor", lambda s, d: _scored(ranking.rank_factors(_items(s, d), (*FACTORS[:2], Factor("PopularityScore", 0.7)))), f"SELECT row_id, round(0.625 * {MM('rating')} + 0.375 * (1 - {MM('price')}), 6) AS final_score FROM {ITEMS}")
_add("rank_linear", lambda s, d: _scored(ranking.rank_factors(_items(s, d), FACTORS, linear=True)), f"SELECT row_id, round(({MM('rating')} + 1 - {MM('price')} + {MM(PROX)}) / 3, 6) AS final_score FROM {ITEMS}")
_add(
    "rank_top",
    lambda s, d: ranking.rank(_items(s, d), ranking.Config(FACTORS, max_results=25)).select("row_id", F.round("final_score", 6).alias("final_score"), F.col("rank").cast("bigint").alias("rank")),
    f"SELECT row_id, round(s, 6) AS final_score, row_number() OVER (ORDER BY s DESC, row_id) AS rank FROM (SELECT row_id, {WEIGHTED} AS s FROM {ITEMS}) ORDER BY s DESC, row_id LIMIT 25",
)
_add(
    "rank_diversity",
    lambda s, d: ranking.diversify(_items(s, d), "category", 0.5, [F.asc("row_id")], "rating").select("row_id", "category", F.round("adjusted_score", 6).alias("adjusted_score")),
    f"SELECT row_id, category, round(rating - 0.5 * (row_number() OVER (PARTITION BY category ORDER BY rating DESC, row_id) - 1), 6) AS adjusted_score FROM {ITEMS}",
)
OBJECTIVES = (Objective("rating", weight=0.6), Objective("price", weight=0.3, direction="minimize"), Objective("calories_per_serving", weight=0.1, target=25))
_add("rank_objectives_weighted", lambda s, d: _scored(ranking.rank_objectives(_items(s, d), OBJECTIVES)), f"SELECT row_id, round(0.6 * {MM('rating')} + 0.3 * (1 - {MM('price')}) + 0.1 * {MM('1 / (1 + abs(cal - 25))')}, 6) AS final_score FROM {ITEMS}")


def _objective(name: str, o: Objective, sql: str) -> None:
    _add(f"objective_{name}", lambda s, d: (lambda df: df.select("row_id", F.round(ranking.objective_value(df, o), 6).alias("value")))(_items(s, d)), f"SELECT row_id, round(({sql})::DOUBLE, 6) AS value FROM {ITEMS}")


_objective("target", Objective("price", target=950), "1 / (1 + abs(price - 950))")
_objective("categorical", Objective("category", "categorical", target=["PROMO BRUSHED BRASS", "STANDARD ANODIZED TIN"]), "category IN ('PROMO BRUSHED BRASS', 'STANDARD ANODIZED TIN')")
_objective("boolean", Objective("servings", "boolean", target=True), "servings::VARCHAR IN ('1', 'true', 'yes')")
_objective("computed", Objective("nutrition_score", "computed"), "CASE WHEN cal = 0 THEN 0 ELSE (protein + fiber) / cal END * 100")
_objective("value_score", Objective("customer_value_score", "computed"), "rating / price")
_add(
    "objective_conflicts",
    lambda s, d: ranking.conflicts(_sold(s, d).fillna(0), (Objective("price"), Objective("order_count"), Objective("rating", direction="minimize"), Objective("protein_g_per_serving"), Objective("net", column="calories_per_serving")), limit=0.0).select("one", "two", F.round("correlation", 6).alias("correlation")),
    f"""WITH i AS (SELECT price, coalesce(q, 0) AS order_count, rating, protein AS protein_g_per_serving, cal AS net FROM {ITEMS} t LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = row_id),
    c AS ("""
    + " UNION ALL ".join(f"SELECT '{a}' AS one, '{b}' AS two, corr({a}, {b}) AS c, {'true' if 'rating' not in (a, b) else 'false'} AS same FROM i" for k, a in enumerate(["price", "order_count", "rating", "protein_g_per_serving", "net"]) for b in ["price", "order_count", "rating", "protein_g_per_serving", "net"][k + 1 :])
    + ") SELECT one, two, round(c, 6) AS correlation FROM c WHERE CASE WHEN same THEN c < 0 ELSE c > 0 END",
)
_add("rank_stats", lambda s, d: ranking.statistics(ranking.rank_factors(_items(s, d), FACTORS)).withColumn("top_score", F.round("top_score", 6)), f"SELECT count(*) AS n, round(max(s), 6) AS top_score, round(avg(s), 6) AS avg_score FROM (SELECT {WEIGHTED} AS s FROM {ITEMS})")
_add("rank_factor_averages", lambda s, d: ranking.factor_averages(ranking.rank_factors(_items(s, d), FACTORS)), f"SELECT 'RatingScore' AS factor, round(avg(rating), 6) AS avg_raw FROM {ITEMS} UNION ALL SELECT 'PriceScore', round(avg(price), 6) FROM {ITEMS} UNION ALL SELECT 'NutritionScore', round(avg({PROX}), 6) FROM {ITEMS}")
_add("rank_explain", lambda s, d: ranking.explained(ranking.rank(_items(s, d), ranking.Config(FACTORS, max_results=25))))
_add(
    "rank_breakdown",
    lambda s, d: ranking.breakdown(ranking.rank_factors(_items(s, d), FACTORS)).select("row_id", F.col("breakdown")["ratingscore"].alias("rating"), "final_score"),
    f"SELECT row_id, round(0.5 * {MM('rating')}, 4) AS rating, round({WEIGHTED}, 4) AS final_score FROM {ITEMS}",
)

# ---- quality, capabilities, schema -----------------------------------------------------------------------------------
_missing = lambda c, src: f"SELECT '{c}' AS column_name, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2)::DOUBLE AS missing_percent, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) > 50 AS warning FROM {src}"
_add("profile_missing", lambda s, d: quality.profile_missing(_labelled(s, d)), " UNION ALL ".join(_missing(c, LABELLED) for c in ("doc_id", "lang", "n_chars", "quality", "toxic")))
_checked = lambda s, d, of, key, rules: quality.violations(table(s, d, of), rules, key)


def _violation(name: str, of: str, key: str, column: str, rule: str, broken, sql: str) -> None:
    _add(name, lambda s, d: quality.violations(table(s, d, of), {column: [(rule, broken)]}, key).drop("first_value"), f"SELECT '{column}' AS column_name, '{rule}' AS rule, count(*) FILTER (WHERE {sql}) AS n_violations, min({key}) FILTER (WHERE {sql}) AS first_key FROM {of}")


_violation("validate_positive", "customer", "c_custkey", "c_acctbal", "positive", quality.positive, "c_acctbal < 0")
_violation("validate_greater_than_zero", "part", "p_partkey", "p_size", "greater_than_zero", quality.greater_than_zero, "p_size <= 0")
_violation("validate_range", "part", "p_partkey", "p_retailprice", "range", quality.in_range(910, 990), "p_retailprice < 910 OR p_retailprice > 990")
_violation("validate_nonempty", "documents", "doc_id", "text", "non_empty", quality.non_empty, "text IS NULL OR trim(text) IN ('', 'nan')")
_add(
    "validate_schema",
    lambda s, d: (lambda df: df.sparkSession.createDataFrame([(c.validator, c.status) for c in quality.validate(df).checks], "validator string, status string"))(_items(s, d)),
    f"SELECT unnest(['required columns', 'recommended columns', 'duplicate columns', 'empty dataset', 'missing values', 'types', 'rules']) AS validator, unnest(['FAILED', 'WARNING', 'PASSED', CASE WHEN count(*) = 0 THEN 'FAILED' ELSE 'PASSED' END, 'PASSED', 'PASSED', CASE WHEN count(*) FILTER (WHERE servings <= 0 OR price < 0) > 0 THEN 'FAILED' ELSE 'PASSED' END]) AS status FROM {ITEMS}",
)
TYPES = capability.Registry([capability.Capability("Clicks", "Event", ("event_type",), {"event_type": ("click",)}), capability.Capability("Values", "Event", ("value",)), capability.Capability("Refunds", "Event", ("event_type",), {"event_type": ("no such event",)}), capability.Capability("Stock", "Event", ("in_stock",))])
_add(
    "capability_values",
    lambda s, d: capability.detect(table(s, d, "events"), TYPES).select("name", "status"),
    "SELECT 'Clicks' AS name, CASE WHEN bool_or(lower(event_type) = 'click') THEN 'ENABLED' ELSE 'PARTIAL' END AS status FROM events UNION ALL SELECT 'Values', 'ENABLED' UNION ALL SELECT 'Refunds', CASE WHEN bool_or(lower(event_type) = 'no such event') THEN 'ENABLED' ELSE 'PARTIAL' END FROM events UNION ALL SELECT 'Stock', 'DISABLED'",
)
_add("capability_score", lambda s, d: capability.score(capability.detect(_items(s, d))), "SELECT 7::BIGINT AS enabled, 0::BIGINT AS partial, 17::BIGINT AS disabled, round(700 / 24.0, 2)::DOUBLE AS score FROM part LIMIT 1")
_add(
    "capability_item_types",
    lambda s, d: features.engineer(_items(s, d).select("row_id", "recipe_name"))[0].groupBy("item_type").agg(F.count("*").alias("n")),
    None,
)


def _mapped(s: SparkSession, d: str) -> DataFrame:
    df, _ = schema.map_schema(table(s, d, "part").select(F.col("p_partkey").alias("Item Key"), F.col("p_name").alias("Dish Name"), F.col("p_retailprice").alias("Menu-Price"), F.col("p_size").alias("Calories"), F.col("p_type").alias("Category")))
    return df


_add("schema_map", _mapped, "SELECT p_partkey AS item_key, p_name AS recipe_name, p_retailprice AS price, p_size AS calories_per_serving, p_type AS meal_type FROM part")

# ---- features and text -----------------------------------------------------------------------------------------------
_add(
    "feature_price_bins",
    lambda s, d: _items(s, d).select("row_id", features.binned(F.col("price"), (930.0, 970.0), ("budget", "mid-range", "premium")).alias("budget_category")),
    f"SELECT row_id, CASE WHEN price IS NULL THEN 'nan' WHEN price <= 930 THEN 'budget' WHEN price <= 970 THEN 'mid-range' ELSE 'premium' END AS budget_category FROM {ITEMS}",
)
_add(
    "feature_density_flags",
    lambda s, d: features.engineer(_items(s, d))[0].select("row_id", F.round("protein_density", 6).alias("protein_density"), F.round("protein_calorie_ratio", 6).alias("protein_calorie_ratio"), "is_high_protein", "is_low_carb", "is_low_fat", "is_high_fiber", "is_low_calorie"),
    f"SELECT row_id, round(coalesce(protein / nullif(cal, 0), 0), 6) AS protein_density, round(coalesce(protein / nullif(cal, 0), 0) * 100, 6) AS protein_calorie_ratio, coalesce(protein * 4 / nullif(cal, 0) >= 0.2, false) AS is_high_protein, coalesce(carbs * 4 / nullif(cal, 0) <= 0.3, false) AS is_low_carb, coalesce(fat * 9 / nullif(cal, 0) <= 0.3, false) AS is_low_fat, fiber >= 5 AS is_high_fiber, cal < 150 AS is_low_calorie FROM {ITEMS}",
)
_add("feature_score", lambda s, d: features.engineer(_items(s, d))[0].select("row_id", F.round("nutrition_score", 6).alias("nutrition_score")), f"SELECT row_id, round(2 * fiber + protein, 6)::DOUBLE AS nutrition_score FROM {ITEMS}")
_has = lambda words: "(" + " OR ".join(f"contains(lower(p_name), '{w}')" for w in words) + ")"
_add(
    "feature_keyword_classify",
    lambda s, d: features.engineer(_items(s, d))[0].select("row_id", "item_type"),
    "SELECT p_partkey AS row_id, CASE " + " ".join(f"WHEN {_has(words)} THEN '{label}'" for label, words in features.ITEM_TYPES) + " ELSE 'main_course' END AS item_type FROM part",
)
_add(
    "feature_keyword_any",
    lambda s, d: (lambda df: df.select("row_id", features.list_holds_any(df, "ingredients", ["red", "bolt"]).alias("hit")))(table(s, d, "part").select(F.col("p_partkey").alias("row_id"), F.regexp_replace("p_name", " ", ", ").alias("ingredients"))),
    f"SELECT p_partkey AS row_id, {_has(['red', 'bolt'])} AS hit FROM part",
)
_add(
    "feature_dietary",
    lambda s, d: features.engineer(table(s, d, "documents").select("doc_id", F.col("text").alias("ingredients")))[0].select("doc_id", "is_vegan", "is_vegetarian", "is_gluten_free", "is_dairy_free", "is_halal"),
    "SELECT doc_id, "
    + ", ".join(f"text IS NOT NULL AND NOT ({' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)}) AS {name}" for name, words in (("is_vegan", features.ANIMAL), ("is_vegetarian", features.MEAT), ("is_gluten_free", features.GLUTEN), ("is_dairy_free", features.DAIRY), ("is_halal", features.HARAM)))
    + " FROM documents",
)
_add(
    "feature_meal",
    lambda s, d: features.engineer(table(s, d, "documents").select("doc_id", F.col("text").alias("meal_type")))[0].select("doc_id", "is_breakfast", "is_lunch", "is_dinner"),
    "SELECT doc_id, " + ", ".join("coalesce(" + " OR ".join(f"contains(lower(text), '{w}')" for w in features.MEALS[f]["meal_type"]) + f", false) AS {f}" for f in ("is_breakfast", "is_lunch", "is_dinner")) + " FROM documents",
)
_add("feature_lengths", lambda s, d: features.engineer(table(s, d, "documents").select("doc_id", F.col("text").alias("description")))[0].select("doc_id", "description_length"), "SELECT doc_id, coalesce(length(text), 0)::INTEGER AS description_length FROM documents")
_add(
    "feature_counts",
    lambda s, d: features.engineer(table(s, d, "part").select(F.col("p_partkey").alias("row_id"), F.split("p_name", " ").alias("ingredients"), F.col("p_type").alias("diet_labels")))[0].select("row_id", "ingredient_count", "diet_label_count"),
    "SELECT p_partkey AS row_id, coalesce(len(string_split(p_name, ' ')), 0)::INTEGER AS ingredient_count, 0 AS diet_label_count FROM part",
)


def _text(name: str, renderer: str, sql: str | None) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = table(s, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("recipe_name"), F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))).alias("item_type"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("description"), F.col("p_size").alias("calories_per_serving"))
        return text.build_text(df, renderer=renderer)[0].select("row_id", "search_text", "text_chunk", "summary_text")

    _add(name, run, sql)


HEAD = ["Menu Item Name", "p_name"], ["Menu Item Category", "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"]
DESC = (["Description", "p_brand"],)
NUTR = (["Calories", "p_size || ' kcal'"],)
META = (["Price", "'$' || printf('%.2f', p_retailprice)"],)


def _section(fields, line: str, title: str | None, head: str, open_: str = "", close: str = "") -> str:
    lines = [f"'{head.format(title)}'"] if title else []
    lines += [f"'{open_}'"] if open_ else []
    lines += ["'" + line.split("{}")[0].replace("@", label) + "' || " + value + (" || '" + line.split("{}")[1] + "'" if line.split("{}")[1] else "") for label, value in fields]
    lines += [f"'{close}'"] if close else []
    return f"concat_ws(chr(10), {', '.join(lines)})"


def _text_sql(line: str, bullet: str, head: str, open_: str = "", close: str = "") -> str:
    h, de = _section(HEAD, line, None, head), _section(DESC, line, None, head)
    n, m = (_section(f, bullet, t, head, open_, close) for f, t in ((NUTR, "Nutrition Facts (per serving)"), (META, "Menu Item Metadata")))
    sep = "chr(10) || chr(10)"
    return f"SELECT p_partkey AS row_id, concat_ws({sep}, {h}, {n}) AS search_text, concat_ws({sep}, {h}, {de}, {n}, {m}) AS text_chunk, concat_ws({sep}, {h}, {de}) AS summary_text FROM part"


_text("text_plain", "plain", _text_sql("@: {}", "- @: {}", "{}:"))
_text("text_markdown", "markdown", _text_sql("**@**: {}  ", "* **@**: {}", "### {}"))
_text("text_html", "html", _text_sql("<p><strong>@</strong>: {}</p>", "  <li><strong>@</strong>: {}</li>", "<h3>{}</h3>", "<ul>", "</ul>"))
_text("text_json", "json", None)

# ---- embedding, prompts, conversations -------------------------------------------------------------------------------
_add("embed_hash_bag", lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(embedding.hash_bag(F.col("text"))).alias("dim")).groupBy("item_id", "dim").agg(F.count("*").alias("n")))
_add(
    "embed_hash_words",
    lambda s, d: table(s, d, "benchmark").select("item_id", F.size(embedding.hash_bag(F.col("text"))).cast("bigint").alias("n_hashes")),
    "SELECT item_id, 8 * len(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS n_hashes FROM benchmark",
)
_add("embed_texts", lambda s, d: embedding.embed(table(s, d, "benchmark"), "text").select("item_id", "text_hash", "embedding"))
CACHED = "doc_id % 2 = 0"
_add(
    "embed_cache_split",
    lambda s, d: embedding.cache_split(table(s, d, "documents"), "text", table(s, d, "documents").where(CACHED).select(F.sha2(embedding.sanitised(F.col("text")), 256).alias("text_hash"))),
    f"WITH t AS (SELECT sha256(trim(coalesce(text, ''))) AS h, {CACHED} AS c FROM documents), g AS (SELECT h, count(*) AS n, bool_or(c) AS hit FROM t GROUP BY h) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, count(*) FILTER (WHERE hit) AS n_hits, count(*) FILTER (WHERE NOT hit) AS n_misses FROM g",
)
_add("token_estimate", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", tokens.token_estimate(F.col("text")).alias("n_tokens")), "SELECT conv_id, turn, ceil(length(text) / 4.0)::BIGINT AS n_tokens FROM conversations")
_add(
    "prompt_history_window",
    lambda s, d: prompts.history_window(table(s, d, "conversations"), 2).select("conv_id", "turn", "role"),
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) WHERE n <= 2",
)
_add(
    "prompt_budget_topk",
    lambda s, d: ranking.rank(_items(s, d), ranking.Config(FACTORS, max_results=5)).where("rank <= 2").select("row_id", F.col("rank").cast("bigint").alias("rank")),
    f"SELECT row_id, row_number() OVER (ORDER BY s DESC, row_id) AS rank FROM (SELECT row_id, {WEIGHTED} AS s FROM {ITEMS}) ORDER BY s DESC, row_id LIMIT 2",
)
_add("prompt_hash", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.sha2(F.col("text"), 256).alias("prompt_hash"), F.char_length("text").cast("bigint").alias("n_chars")), "SELECT conv_id, turn, sha256(text) AS prompt_hash, length(text)::BIGINT AS n_chars FROM conversations")


def _prompts(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations")
    asked = turns.where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("query"))
    top = ranking.rank(_items(s, d), ranking.Config(FACTORS, max_results=3)).select("rank", "recipe_name", "price", "calories_per_serving")
    shown = asked.select("conv_id").join(F.broadcast(top.agg(F.collect_list(F.struct("*")).alias("top")))).select("conv_id", F.inline("top"))
    return prompts.build_prompts(asked, shown, turns)


_add("prompt_build", _prompts)
LAST = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
SQL_WORDS = f"CASE WHEN {LAST} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({LAST}, '\\s+') END"
SQL_REPEATS = "coalesce(len(list_filter(range(1, greatest(len(w) - 4, 1)), lambda i: w[i:i+2] = w[i+3:i+5])) > 0, false)"
_add("response_repetition", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", tokens.repeats_trigram(F.col("text")).alias("repeats")), f"SELECT conv_id, turn, {SQL_REPEATS} AS repeats FROM (SELECT *, {SQL_WORDS} AS w FROM conversations)")
_add(
    "response_checks",
    lambda s, d: table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.array_join(tokens.response_warnings(F.col("text"), prompts.system_parts("the restaurant's assistant")), "|").alias("warnings")),
    f"""SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN s = '' THEN 'whitespace only' ELSE concat_ws('|', CASE WHEN contains(text, chr(65533)) THEN 'invalid characters' END, CASE WHEN length(s) < 10 THEN 'too short' END, CASE WHEN length(text) > 10000 THEN 'too long' END, CASE WHEN {SQL_REPEATS} THEN 'repetition' END,
      CASE WHEN contains(q, 'your role: the restaurant''s assistant') OR contains(q, 'you help guests to choose from the menu') OR contains(q, 'speak of no dish that is missing from the list below') OR contains(q, 'take every fact from that list and from nowhere else') THEN 'prompt leakage' END) END AS warnings
    FROM (SELECT *, {SQL_WORDS} AS w, {LAST} AS s, string_split(lower(text), 'the query was:')[1] AS q FROM conversations WHERE role = 'assistant')""",
)
_add(
    "session_history",
    lambda s, d: prompts.history(table(s, d, "conversations")),
    "SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, 'User') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS history FROM conversations GROUP BY conv_id",
)


def _end_to_end(s: SparkSession, d: str) -> DataFrame:
    """Search, then rules on what was found, then weighted and diverse ranking: the online query in one plan."""
    vectors = _vectors(s, d)
    found = search.attach(search.search_near(vectors, 0, 50).withColumnRenamed("rank", "search_rank"), vectors.select("row_id", "label")).withColumnRenamed("score", "semantic_similarity")
    ruled = filtering.apply_rules(found, [Rule("label", "in", [0, 1, 2, 3, 4, 5]), Rule("semantic_similarity", ">=", 0.2, rule_type="SOFT", reward=1.0, penalty=-0.5)])
    config = ranking.Config((Factor("SemanticScore", 0.7), Factor("SoftRuleScore", 0.3)), diversity_column="label", diversity_weight=0.1, max_results=10)
    return ranking.rank(ruled.where("hard_passed"), config, "search_rank").select("row_id", "label", F.round("final_score", 6).alias("final_score"), F.col("rank").cast("bigint").alias("rank"))


_add(
    "search_filter_rank_e2e",
    _end_to_end,
    f"""WITH top AS (SELECT row_id, label, score, row_number() OVER (ORDER BY score DESC, row_id) AS r FROM {IP} ORDER BY score DESC, row_id LIMIT 50),
    f AS (SELECT *, CASE WHEN score >= 0.2 THEN 1.0 ELSE -0.5 END AS soft FROM top WHERE label IN (0, 1, 2, 3, 4, 5)),
    n AS (SELECT *, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) WHEN min(score) OVER () > 0 THEN 1.0 ELSE 0.5 END AS a, CASE WHEN max(soft) OVER () > min(soft) OVER () THEN (soft - min(soft) OVER ()) / (max(soft) OVER () - min(soft) OVER ()) WHEN min(soft) OVER () > 0 THEN 1.0 ELSE 0.5 END AS b FROM f),
    w AS (SELECT *, 0.7 * a + 0.3 * b AS s FROM n),
    v AS (SELECT *, s - 0.1 * (row_number() OVER (PARTITION BY label ORDER BY s DESC, r) - 1) AS t FROM w)
    SELECT row_id, label, round(t, 6)::DOUBLE AS final_score, row_number() OVER (ORDER BY t DESC, r) AS rank FROM v ORDER BY t DESC, r LIMIT 10""",
)
