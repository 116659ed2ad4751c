"""The token budget of prompts, decided for a whole table of prompts in one pass.

Every prompt has a ladder of cuts: no few-shot examples, the last two turns only, then candidates with fewer columns and fewer of them.  One
aggregation sums a prompt's characters on every step of the ladder; the first step whose estimate fits is taken, the last one if none does.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prompts import NUTRITION, SECONDARY, Settings, build_prompts, history_window

#: Steps that drop candidates' columns or candidates, in order; what a step drops stays dropped.
CUTS: list[tuple[str, list[str], int | None]] = [
    ("metadata", SECONDARY, None),
    ("ingredients", ["ingredients"], None),
    ("description", ["description", "ingredients"], None),
    ("top 2", [], 2),
    ("nutrition", NUTRITION, None),
]
FEW_SHOT, LAST_TURNS, TURNS = "few-shot examples", "last 2 turns", 2


def _steps() -> list[tuple[str, set[str], int | None]]:
    """Name, all columns gone and the candidates left after each of CUTS, the uncut candidates first."""
    out, gone, most = [("", set(), None)], set(), None
    for name, columns, top in CUTS:
        gone, most = gone | set(columns), top or most
        out.append((name, set(gone), most))
    return out


def _chars(columns: list[str]) -> Column:
    return F.char_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)))) if columns else F.lit(2)


def ladder(queries: DataFrame, ranked: DataFrame, turns: DataFrame | None = None, settings: Settings | None = None, key: str = "conv_id") -> DataFrame:
    """key, level, steps, n_tokens, fits for each row (key, query) of ``queries``: how far its prompt is cut, and the estimate then.

    A step that has nothing to cut (no few-shot examples, two turns or fewer) is passed over.
    """
    s = settings or Settings()
    own = [c for c in ranked.columns if c != key]
    sizes = [F.coalesce(F.sum(F.when(F.col("rank") <= most, c) if most else c), F.lit(0)) for _, gone, most in _steps() for c in [_chars([c for c in own if c not in gone])]]
    candidates = ranked.groupBy(key).agg(F.array(*sizes).alias("__candidates"))
    none = F.array(*[F.lit(0).cast("long")] * len(sizes))
    told = queries.select(key, F.coalesce(F.char_length("query"), F.lit(0)).alias("__query")).join(candidates, key, "left").withColumn("__candidates", F.coalesce("__candidates", none))
    if turns is not None:
        size = F.coalesce(F.char_length("role"), F.lit(0)) + F.coalesce(F.char_length("text"), F.lit(0))
        every = turns.groupBy(key).agg(F.sum(size).alias("__turns"), F.count("*").alias("__n"))
        last = history_window(turns, TURNS, conv=key).groupBy(key).agg(F.sum(size).alias("__last"))
        told = told.join(every, key, "left").join(last, key, "left")
    else:
        told = told.withColumns({c: F.lit(0) for c in ("__turns", "__n", "__last")})
    zero = F.lit(0)
    turns_all, turns_last = F.coalesce("__turns", zero), F.when(F.coalesce("__n", zero) > TURNS, F.col("__last")).otherwise(F.coalesce("__turns", zero))
    shots = sum(len(u) + len(a) for u, a in s.few_shot)
    first = F.col("__candidates")[0]
    rungs = [
        (F.lit(True), "", F.col("__query") + turns_all + shots + first),
        (F.lit(bool(s.few_shot)), FEW_SHOT, F.col("__query") + turns_all + first),
        (F.coalesce("__n", zero) > TURNS, LAST_TURNS, F.col("__query") + turns_last + first),
        *((F.lit(True), name, F.col("__query") + turns_last + F.col("__candidates")[k]) for k, (name, _, _) in enumerate(_steps()) if k),
    ]
    entries = F.array(*(F.struct(F.lit(k).alias("level"), has.alias("has"), F.lit(name).alias("name"), F.ceil(chars / 4).cast("long").alias("tokens")) for k, (has, name, chars) in enumerate(rungs)))
    fitting = F.filter("__rungs", lambda r: r["has"] & (r["tokens"] <= s.most_tokens))
    told = told.withColumn("__rungs", entries).withColumn("__taken", F.coalesce(F.get(fitting, F.lit(0)), F.element_at("__rungs", -1)))
    level = F.col("__taken.level")
    steps = F.transform(F.filter("__rungs", lambda r: r["has"] & (r["level"] > 0) & (r["level"] <= level)), lambda r: r["name"])
    return told.select(key, level.alias("level"), steps.alias("steps"), F.col("__taken.tokens").alias("n_tokens"), (F.col("__taken.tokens") <= s.most_tokens).alias("fits"))


def budgeted_prompts(queries: DataFrame, ranked: DataFrame, turns: DataFrame | None = None, settings: Settings | None = None, key: str = "conv_id") -> DataFrame:
    """What ``build_prompts`` returns, each prompt cut as its ladder tells, with the steps taken."""
    s = settings or Settings()
    levels = ladder(queries, ranked, turns, s, key)
    told = ranked.join(levels.select(key, "level"), key)
    shown = told
    for k, (_, gone, most) in enumerate(_steps()):
        at = k + 2  # after the steps on few-shot examples and turns
        if k and most and most != _steps()[k - 1][2]:
            shown = shown.where((F.col("level") < at) | (F.col("rank") <= most))
        if k:
            shown = shown.withColumns({c: F.when(F.col("level") < at, F.col(c)) for c in gone - _steps()[k - 1][1] if c in shown.columns})
    left = None
    if turns is not None:
        dealt = turns.join(levels.select(key, "level"), key)
        left = dealt.where("level < 2").drop("level").unionByName(history_window(dealt.where("level >= 2").drop("level"), TURNS, conv=key))
    asked = queries.join(levels.select(key, "level"), key)
    parts = []
    for few, condition in ((s.few_shot, "level < 1"), ((), "level >= 1")):
        if few or not s.few_shot:
            parts.append(build_prompts((asked.where(condition) if s.few_shot else asked).drop("level"), shown.drop("level"), left, replace(s, few_shot=few), key))
            if not s.few_shot:
                break
        else:
            parts.append(build_prompts(asked.where(condition).drop("level"), shown.drop("level"), left, replace(s, few_shot=()), key))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(levels.select(key, "steps"), key)
