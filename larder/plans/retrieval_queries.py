"""Registered queries over stored indexes, keyword search and choices among many objectives, with their SQL.

An index is built from the whole given table into the shared folder and searched from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, fronts, graph_index, keywords, ranking, search
from ..operators.ranking import Objective
from ..sources.tables import shared_folder
from .queries import FACTORS, IP, ITEMS, L2, VEC, WEIGHTED, Query, _items, _rounded, _sold, _top, _vectors, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), "embedding")


_add(
    "rank_full",
    lambda s, d: ranking.rank(_items(s, d), ranking.Config(FACTORS)).select("row_id", F.round("final_score", 6).alias("final_score"), "rank"),
    f"SELECT row_id, round(s, 6) AS final_score, row_number() OVER (ORDER BY s DESC, row_id) AS rank FROM (SELECT row_id, {WEIGHTED} AS s FROM {ITEMS})",
)
DIVERSE = f"(SELECT row_id, category, s, s - 0.05 * (row_number() OVER (PARTITION BY category ORDER BY s DESC, row_id) - 1) AS t FROM (SELECT row_id, category, {WEIGHTED} AS s FROM {ITEMS}))"
_add(
    "rank_full_diverse",
    lambda s, d: ranking.rank(_items(s, d), ranking.Config(FACTORS, diversity_column="category", diversity_weight=0.05)).select("row_id", F.round("final_score", 6).alias("final_score"), F.round("penalty", 6).alias("penalty"), "rank"),
    f"SELECT row_id, round(t, 6)::DOUBLE AS final_score, round(s - t, 6)::DOUBLE AS penalty, row_number() OVER (ORDER BY t DESC, row_id) AS rank FROM {DIVERSE}",
)


# ---- stored indexes --------------------------------------------------------------------------------------------------
def _stored_cells(s: SparkSession, d: str) -> cells.CellIndex:
    path = _place(s, "cells")
    cells.build_cells(_vectors(s, d), path, 16, metric="l2")
    return cells.load_cells(s, path)


def _cells_topk(s: SparkSession, d: str) -> DataFrame:
    """All cells: equal to the exact search."""
    found = _stored_cells(s, d).search(_vectors(s, d).where("row_id = 0").select(F.col("row_id").alias("query_id"), "embedding"), 20, nprobe=16)
    return _rounded(found)


def _recall(s: SparkSession, d: str, found: DataFrame) -> DataFrame:
    vectors = _vectors(s, d)
    told = cells.recall(found, search.batch_search(vectors, _asked(vectors), 10, "l2"))
    return told.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("recalled"))


RECALLED = "SELECT count(*) FILTER (WHERE vec_id % 50 = 0) AS queries, count(*) FILTER (WHERE vec_id % 50 = 0) * least(10, count(*)) AS neighbours, true AS recalled FROM embeddings"
_add("vector_cells_topk", _cells_topk, _top(L2, 20, "ASC"))
_add("vector_cells_recall", lambda s, d: _recall(s, d, _stored_cells(s, d).search(_asked(_vectors(s, d)), 10, nprobe=10)), RECALLED)


def _graph_recall(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "graph")
    graph_index.build_graph(_vectors(s, d), path, degree=16)
    return _recall(s, d, graph_index.load_graph(s, path).search(_asked(_vectors(s, d)), 10, width=64))


_add("vector_graph_recall", _graph_recall, RECALLED)

# ---- keywords --------------------------------------------------------------------------------------------------------
WORDS = ["thed", "tion", "thly", "nd"]


def _keywords(s: SparkSession, d: str) -> keywords.Keywords:
    path = _place(s, "postings")
    return keywords.build_keywords(table(s, d, "documents").select(F.col("doc_id").alias("row_id"), "text"), path, span=64)


BM25 = f"""WITH t AS (SELECT doc_id AS row_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
    n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    f AS (SELECT row_id, len(w) AS len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, (SELECT unnest({WORDS!r}) AS term)),
    df AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY term),
    b AS (SELECT row_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM f JOIN df USING (term), n WHERE tf > 0 GROUP BY row_id)"""
_add("keywords_topk", lambda s, d: _rounded(_keywords(s, d).search(" ".join(WORDS), 25)), f"{BM25} SELECT row_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM b ORDER BY score DESC, row_id LIMIT 25")


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(s, d)
    near = search.search_near(vectors, 0, 200)
    return _rounded(keywords.fused(near, _keywords(s, d).search(" ".join(WORDS), 200), 20))


_add(
    "hybrid_topk",
    _hybrid,
    f"""{BM25}, near AS (SELECT row_id, score FROM {IP} ORDER BY score DESC, row_id LIMIT 200), words AS (SELECT row_id, score / max(score) OVER () AS score FROM (SELECT * FROM b ORDER BY score DESC, row_id LIMIT 200)),
    mixed AS (SELECT row_id, 0.7 * coalesce(near.score, 0) + 0.3 * coalesce(words.score, 0) AS score FROM near FULL JOIN words USING (row_id))
    SELECT row_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM mixed ORDER BY score DESC, row_id LIMIT 20""",
)

# ---- many objectives -------------------------------------------------------------------------------------------------
CHOICE = (Objective("rating", weight=0.5), Objective("price", weight=0.3, direction="minimize"), Objective("protein_g_per_serving", weight=0.2))
GOOD = ("rating", "-price", "protein")
_add(
    "pareto_front",
    lambda s, d: fronts.pareto_front(_items(s, d), CHOICE).select("row_id", "rating", "price"),
    f"SELECT row_id, rating, price FROM {ITEMS} a WHERE NOT EXISTS (SELECT 1 FROM {ITEMS} b WHERE b.rating >= a.rating AND b.price <= a.price AND b.protein >= a.protein AND (b.rating > a.rating OR b.price < a.price OR b.protein > a.protein))",
)
_size = lambda x: f"sqrt(sum(pow({x}, 2)) OVER ())"
_away = lambda end: "sqrt(" + " + ".join(f"pow({w} * ({x} - {end}({x}) OVER ()) / {_size(x)}, 2)" for x, w in zip(GOOD, (0.5, 0.3, 0.2), strict=True)) + ")"
_add(
    "rank_topsis",
    lambda s, d: fronts.topsis(_items(s, d), CHOICE).select("row_id", F.round("final_score", 6).alias("final_score")),
    f"SELECT row_id, round(w / (b + w), 6) AS final_score FROM (SELECT row_id, {_away('max')} AS b, {_away('min')} AS w FROM {ITEMS})",
)
_flow = " + ".join(f"{w} * (rank() OVER (ORDER BY {x}) - rank() OVER (ORDER BY {x} DESC))" for x, w in zip(GOOD, (0.5, 0.3, 0.2), strict=True))
_add(
    "rank_promethee",
    lambda s, d: fronts.promethee(_items(s, d), CHOICE).select("row_id", F.round("final_score", 6).alias("final_score")),
    f"SELECT row_id, round(({_flow}) / (count(*) OVER () - 1), 6)::DOUBLE AS final_score FROM {ITEMS}",
)
# quantity sold has gaps and ties: places by its sorted distinct values
_add(
    "promethee_sold",
    lambda s, d: fronts.promethee(_sold(s, d).fillna(0, ["order_count"]), (Objective("order_count"),)).select("row_id", F.round("final_score", 6).alias("final_score")),
    "SELECT p_partkey AS row_id, round((rank() OVER (ORDER BY q) - rank() OVER (ORDER BY q DESC)) / (count(*) OVER () - 1)::DOUBLE, 6) AS final_score FROM (SELECT p_partkey, coalesce(sum(l_quantity), 0) AS q FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)",
)


def _explained(s: SparkSession, d: str) -> DataFrame:
    config = ranking.Config(objectives=CHOICE, max_results=25)
    items = _items(s, d)
    return ranking.explanations(ranking.rank(items, config), config, ranking.conflicts(items, CHOICE, limit=-1.0)).select("row_id", F.col("rank").cast("long").alias("rank"), "text")


_SCALED = "(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())"
_parts = [("rating", "rating", 0.5, False), ("price", "price", 0.3, True), ("protein_g_per_serving", "protein", 0.2, False)]
_scaled = lambda c, low: ("1 - " if low else "") + "(" + _SCALED.replace("x", "{c}").replace("ma{c}", "max").format(c=c) + ")"
_pairs = [(a, b) for i, a in enumerate(_parts) for b in _parts[i + 1 :]]
_conflict = lambda a, b: f"SELECT '{a[0]} vs {b[0]} (Correlation: ' || format('{{:+.2f}}', corr({a[1]}, {b[1]})) || ')' AS label, corr({a[1]}, {b[1]}) AS c, {'true' if a[3] == b[3] else 'false'} AS same FROM {ITEMS}"
_add(
    "rank_explanations",
    _explained,
    f"""WITH n AS (SELECT row_id, rating, price, protein, {", ".join(f"{_scaled(c, low)} AS n{k}" for k, (_, c, _, low) in enumerate(_parts))} FROM {ITEMS}),
    s AS (SELECT *, {" + ".join(f"{w} * n{k}" for k, (_, _, w, _) in enumerate(_parts))} AS score FROM n), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM s ORDER BY score DESC, row_id LIMIT 25),
    e AS (SELECT row_id, rank, score, unnest({[p[0] for p in _parts]}) AS name, unnest([{", ".join(f"{w} * n{k}" for k, (_, _, w, _) in enumerate(_parts))}]) AS part, unnest([{", ".join(f"{c}::DOUBLE" for _, c, _, _ in _parts)}]) AS raw, unnest([n0, n1, n2]) AS scaled, unnest({[p[2] for p in _parts]}::DOUBLE[]) AS weight FROM r),
    l AS (SELECT string_agg('conflict: ' || label, chr(10) ORDER BY label) AS conflicts FROM ({" UNION ALL ".join(_conflict(a, b) for a, b in _pairs)}) WHERE CASE WHEN same THEN c < 1.0 ELSE c > -1.0 END)
    SELECT row_id, rank, concat_ws(chr(10), format('score {{:.4f}}', score), string_agg(format('{{:+.4f}} {{}} (value {{:.2f}}, scaled {{:.2f}}, weight {{:.2f}})', part, name, raw, scaled, weight), chr(10) ORDER BY part DESC, name), conflicts) AS text FROM e, l GROUP BY row_id, rank, score, conflicts""",
)
