"""Registered queries on prompts, budgets and answers over ``conversations``, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import budget, generation, prompts
from ..operators.prompts import Settings
from ..sources.tables import shared_folder
from .queries import LAST, SQL_REPEATS, SQL_WORDS, Query, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


# ---- the budget ladder: every conversation asks with its first turn about the turns of a user, of which the longest come first
SETTINGS = Settings(most_tokens=300, few_shot=(("Is there soup?", "Yes, a lentil soup."),))


def _ladder_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = table(s, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    asked = turns.groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("query"))
    ranked = turns.select("conv_id", (F.col("turn") + 1).cast("int").alias("rank"), F.substring("text", 1, 20).alias("recipe_name"), F.substring("text", 21, 40).alias("ingredients"), F.substring("text", 61, 60).alias("description"), F.col("turn").cast("int").alias("calories"), F.col("role").alias("image_url"))
    return asked, ranked, turns


_add("prompt_budget_ladder", lambda s, d: budget.ladder(*_ladder_inputs(s, d), SETTINGS).select("conv_id", F.col("level").cast("long").alias("level"), F.array_join("steps", "|").alias("steps"), "n_tokens", "fits"), "")
_columns = {"rank": "rank", "recipe_name": "substr(text, 1, 20)", "ingredients": "substr(text, 21, 40)", "description": "substr(text, 61, 60)", "calories": "turn::INT", "image_url": "role"}
_json = lambda gone: "length(to_json(struct_pack(" + ", ".join(f"{c} := {e}" for c, e in _columns.items() if c not in gone) + ")))"
_cut = [((), ""), (("image_url",), ""), (("image_url", "ingredients"), ""), (("image_url", "ingredients", "description"), ""), (("image_url", "ingredients", "description"), " FILTER (WHERE rank <= 2)"), (("image_url", "ingredients", "description", "calories"), " FILTER (WHERE rank <= 2)")]
_names = ["few-shot examples", "last 2 turns", "metadata", "ingredients", "description", "top 2", "nutrition"]
_shots = sum(len(u) + len(a) for u, a in SETTINGS.few_shot)
SQL["prompt_budget_ladder"] = f"""WITH t AS (SELECT *, turn + 1 AS rank, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    s AS (SELECT conv_id, length(arg_min(text, turn)) AS q, count(*) AS n, sum(length(role) + length(text)) AS every, sum(length(role) + length(text)) FILTER (WHERE back <= 2) AS last, {", ".join(f"coalesce(sum({_json(gone)}){keep}, 0) AS c{k}" for k, (gone, keep) in enumerate(_cut))} FROM t GROUP BY conv_id),
    r AS (SELECT conv_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS level, unnest([true, true, n > 2, true, true, true, true, true]) AS has,
        unnest([q + every + {_shots} + c0, q + every + c0, q + last + c0, {", ".join(f"q + last + c{k}" for k in range(1, 6))}]) AS chars FROM s),
    p AS (SELECT conv_id, coalesce(min(level) FILTER (WHERE has AND ceil(chars / 4) <= {SETTINGS.most_tokens}), 7) AS level FROM r GROUP BY conv_id)
    SELECT conv_id, p.level::BIGINT AS level, (SELECT coalesce(string_agg(name, '|' ORDER BY k), '') FROM (SELECT unnest({_names}) AS name, unnest(range(1, 8)) AS k) x WHERE x.k <= p.level AND (x.k <> 2 OR s.n > 2)) AS steps,
        ceil(r.chars / 4)::BIGINT AS n_tokens, ceil(r.chars / 4) <= {SETTINGS.most_tokens} AS fits
    FROM p JOIN s USING (conv_id) JOIN r ON r.conv_id = p.conv_id AND r.level = p.level"""

# ---- answers: what the even conversations asked is in the cache, that of every sixth too old; the provider gives back a few of the prompt's characters
ECHO = "substr(prompt, 7, length(prompt) % 20)"


def _answers(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("Guest: "), F.coalesce("text", F.lit(""))).alias("prompt"))
    cache = generation.ResponseTable(s, f"{shared_folder(s)}/answers-{uuid.uuid4().hex}", seconds=100)
    stored = asked.where("conv_id % 2 = 0").select(cache.key(F.col("prompt")).alias("cache_key"), F.concat(F.lit("stored: "), F.substring("prompt", 8, 30)).alias("response"), F.when(F.col("conv_id") % 6 == 0, 10.0).otherwise(950.0).alias("created_at"))
    cache.put(stored)
    return generation.Answerer(cache, provider=lambda prompt: F.expr(ECHO)).answer(asked, now=1000)


_P = "(SELECT conv_id, turn, 'Guest: ' || coalesce(text, '') AS prompt FROM conversations WHERE role = 'user')"
_A = f"(SELECT conv_id, turn, prompt, h IS NOT NULL AS cached, coalesce(h, {ECHO}) AS text FROM {_P} LEFT JOIN (SELECT prompt AS p, max('stored: ' || substr(prompt, 8, 30)) AS h FROM {_P} WHERE conv_id % 2 = 0 AND conv_id % 6 <> 0 GROUP BY prompt) ON p = prompt)"
_leak = "contains(lower(text), 'your role: the restaurant''s assistant')"
_warned = f"(SELECT *, CASE WHEN text = '' THEN 'empty' WHEN s = '' THEN 'whitespace only' ELSE concat_ws('|', CASE WHEN contains(text, chr(65533)) THEN 'invalid characters' END, CASE WHEN length(s) < 10 THEN 'too short' END, CASE WHEN length(text) > 10000 THEN 'too long' END, CASE WHEN {SQL_REPEATS} THEN 'repetition' END, CASE WHEN {_leak} THEN 'prompt leakage' END) END AS warnings FROM (SELECT *, {SQL_WORDS} AS w, {LAST} AS s FROM {_A}))"
_add("generate_answers", lambda s, d: _answers(s, d).select("conv_id", "turn", "response", "cached", F.array_join("warnings", "|").alias("warnings")), f"SELECT conv_id, turn, text AS response, cached, warnings FROM {_warned}")
_add(
    "generate_statistics",
    lambda s, d: generation.generation_statistics(_answers(s, d)),
    f"SELECT count(*) AS prompts, count(*) FILTER (WHERE cached) AS hits, count(*) FILTER (WHERE NOT cached) AS misses, count(*) FILTER (WHERE warnings <> '') AS flagged, coalesce(sum(ceil(length(prompt) / 4)), 0)::BIGINT AS prompt_tokens, coalesce(sum(ceil(length(text) / 4)), 0)::BIGINT AS response_tokens FROM {_warned}",
)
_add("generate_warnings", lambda s, d: generation.warning_counts(_answers(s, d)), f"SELECT warning, count(*) AS n FROM (SELECT unnest(string_split(warnings, '|')) AS warning FROM {_warned}) WHERE warning <> '' GROUP BY warning")


# ---- whole prompts: the second to last turn was suggested before, the last is a question to go on with
DEBUG = Settings(template="Debug")


def _whole(s: SparkSession, d: str) -> DataFrame:
    asked, ranked, turns = _ladder_inputs(s, d)
    ranked = ranked.where("rank <= 2").select("conv_id", "rank", "recipe_name", "ingredients")
    lines = lambda at: turns.where(f"turn = {at}").select("conv_id", F.col("turn").alias("n"), F.substring("text", 1, 15).alias("text"))
    return prompts.build_prompts(asked, ranked, turns.where("turn < 2"), DEBUG, previous=lines(2).unionByName(lines(3)), follow_ups=lines(4))


_system = "\n".join(prompts.system_parts(DEBUG.assistant)).replace("'", "''")
_list = lambda title, where: f"(SELECT conv_id, '## {title}' || chr(10) || '- ' || string_agg(substr(text, 1, 15), chr(10) || '- ' ORDER BY turn) || chr(10) || chr(10) AS block FROM c WHERE {where} GROUP BY conv_id)"
_add(
    "prompt_whole",
    lambda s, d: _whole(s, d).select("conv_id", "prompt", F.col("n_tokens").alias("n_tokens")),
    f"""WITH c AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    q AS (SELECT conv_id, arg_min(text, turn) AS query FROM c GROUP BY conv_id),
    k AS (SELECT conv_id, '## Candidates' || chr(10) || string_agg('- ' || substr(text, 1, 20) || chr(10) || '  ingredients: ' || substr(text, 21, 40), chr(10) ORDER BY turn) AS block FROM c WHERE turn < 2 GROUP BY conv_id),
    h AS (SELECT conv_id, '## So far' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) || chr(10) AS block FROM c WHERE turn < 2 GROUP BY conv_id),
    w AS (SELECT conv_id, concat_ws(chr(10) || chr(10), '{_system}', k.block, coalesce(h.block, '') || coalesce(p.block, '') || coalesce(n.block, '') || 'Guest asks: ' || query) AS prompt
        FROM q LEFT JOIN k USING (conv_id) LEFT JOIN h USING (conv_id) LEFT JOIN {_list("Suggested before", "turn IN (2, 3)")} p USING (conv_id) LEFT JOIN {_list("Could be asked next", "turn = 4")} n USING (conv_id))
    SELECT conv_id, prompt, ceil(length(prompt) / 4)::BIGINT AS n_tokens FROM w""",
)
