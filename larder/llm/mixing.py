"""Mixing sources to target weights, by DataFrame functions alone.

Method: temperature mixing.  Token shares p of the sources are raised to an exponent, w ~ p^a; the exponent is
bisected until the mixture's entropy meets a target, or no source is repeated more than a limit.  The weights are then
realised under a token budget by block permutations: every pass over a source walks its blocks in a seeded order, and the
documents of a block in a seeded order; a document copy is kept while the source's running tokens stay within its budget.

A source of n documents has about sqrt(n) blocks, so the running sum of a hot source is taken in two levels, within blocks
and over block totals, and no task holds a source.  What the driver sees are a few sums for each step of the bisection.

Defined cases: a text of any length counts whole, as one row; a null source is a source of its own; null and empty texts have no tokens and stay with the first pass of
their source's order as far as its budget reaches; ties and repeated rows are ordered by all their values and kept or left each by itself; with no tokens at all
the weights are zero; an empty table gives an empty table; input columns named like the outputs are replaced, others kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, hashable, written

STEPS = 40
#: Passes over a source that a row is copied for at a time, and sources whose plan is broadcast.
STRETCH, MANY_SOURCES = 1000, 100_000


def words(text: Column) -> Column:
    """Tokens of a text as its runs of characters other than ASCII blanks."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _key15(*parts: Column) -> Column:
    """60 bits of an MD5 as a long: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def exponent(shares: DataFrame, entropy: float | None = None, entropy_part: float | None = None, most_repeats: float | None = None, budget_part: float | None = None) -> float:
    """The exponent in [0, 1] for ``shares`` (column p): the largest whose entropy reaches the target, or the smallest at which
    no source is repeated more than ``most_repeats`` times.

    entropy_part places the target between the entropies at 1 and at 0.  budget_part is the budget over all tokens; None
    means as many tokens as it takes to use every source at least once.
    """
    live = shares.where("p > 0")
    tell = live.agg(F.count("*"), F.coalesce(F.sum(-F.col("p") * F.ln("p")), F.lit(0.0)), F.min("p"), F.max("p")).first()
    if tell[0] < 2:
        return 1.0
    if most_repeats is not None:

        def fits(a: float) -> bool:
            z = live.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
            repeats = tell[2] ** (a - 1) * (tell[3] ** (1 - a) if budget_part is None else budget_part / z)
            return repeats <= most_repeats
    else:
        target = entropy if entropy is not None else tell[1] + (math.log(tell[0]) - tell[1]) * entropy_part

        def fits(a: float) -> bool:
            z, s = live.agg(F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.ln("p"))).first()
            return math.log(z) - a * s / z <= target

    low, high = 0.0, 1.0
    if fits(0.0):
        return 0.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def mix(df: DataFrame, source: str = "source", tokens: Column | None = None, key: str = "doc_id", seed: int = 7, entropy: float | None = None, entropy_part: float | None = None, most_repeats: float | None = None, budget: int | None = None, cover: bool = False) -> DataFrame:
    """``df``'s rows as often as the mixture takes them, with n_tokens, weight, epoch (pass over the source, from 0), block
    (place of the row's block in that pass) and upto (the source's running tokens in that pass).

    budget: tokens of the whole mixture, by default as many as ``df`` has; with ``cover`` as many as use every source once.
    """
    made = ("n_tokens", "weight", "epoch", "block", "upto")
    kept = [c for c in df.columns if c not in made]
    n_tokens = words(F.col("text")) if tokens is None else tokens
    df = df.select(*map(col, kept), n_tokens.alias("n_tokens")).withColumn("__of", F.coalesce(F.concat(F.lit("s"), col(source)), F.lit("")))
    sources = written(df.groupBy("__of").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), "sources")
    total = sources.agg(F.sum("t")).first()[0] or 0
    shares = sources.withColumn("p", F.when(F.lit(total > 0), F.col("t") / F.lit(float(max(total, 1)))).otherwise(F.lit(0.0)))
    a = exponent(shares, entropy, entropy_part, most_repeats, None if cover else (budget if budget is not None else total) / max(total, 1))
    raised = F.when(F.col("p") > 0, F.pow("p", F.lit(a))).otherwise(0.0)
    z, largest = shares.agg(F.coalesce(F.sum(raised), F.lit(0.0)), F.coalesce(F.max("p"), F.lit(0.0))).first()
    weight = F.round(raised / F.lit(z or 1.0), 9)
    whole = F.ceil(F.lit(total * largest) / F.lit((largest**a if largest else 1.0) / (z or 1.0))) if cover else F.lit(total if budget is None else budget)
    tokens_of = F.floor(weight * whole).cast("long")
    tokens_of = F.greatest(tokens_of, F.col("t")) if cover else tokens_of
    plan = shares.select("__of", weight.alias("weight"), tokens_of.alias("__budget"), F.col("t").alias("__t"), F.ceil(F.sqrt("n")).cast("long").alias("__blocks"))

    order = F.col(key).cast("string")
    tie = F.xxhash64(*map(col, hashable(df.select(*map(col, kept)))))
    seeded = F.lit(str(seed))
    passes = F.when(F.col("__t") > 0, F.floor(F.col("__budget") / F.col("__t"))).otherwise(F.lit(0)).cast("long")
    most = plan.agg(F.max(passes)).first()[0] or 0

    def in_epochs(rows: DataFrame, by: list[Column]) -> DataFrame:
        """A row for each pass. Many passes are first dealt over tasks in stretches, so that no array and no task holds them all."""
        stretches = rows.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), passes, F.lit(STRETCH).cast("long")))) if most >= STRETCH else rows.withColumn("__from", F.lit(0).cast("long"))
        stretches = stretches.repartition(*by, "__from") if most >= STRETCH else stretches
        return stretches.withColumn("epoch", F.explode(F.sequence(F.col("__from"), F.least(passes, F.col("__from") + STRETCH - 1)))).drop("__from")

    df = df.join(F.broadcast(plan) if plan.count() <= MANY_SOURCES else plan, "__of").withColumn("__block", F.pmod(_key15(seeded, F.coalesce(order, F.lit(""))), F.col("__blocks")))
    dealt = in_epochs(df, [F.coalesce(order, F.lit(""))])
    dealt = dealt.withColumn("__at", _key15(seeded, F.col("epoch").cast("string"), F.coalesce(order, F.lit("")))).withColumn("__tie", tie)
    blocks = df.groupBy("__of", "__block").agg(F.sum("n_tokens").alias("__n"), F.first("__budget").alias("__budget"), F.first("__t").alias("__t"))
    blocks = in_epochs(blocks, [F.col("__of"), F.col("__block")]).withColumn("__order", _key15(seeded, F.lit("block"), F.col("epoch").cast("string"), F.col("__of"), F.col("__block").cast("string")))
    over = Window.partitionBy("__of", "epoch").orderBy("__order", "__block")
    blocks = blocks.select("__of", "epoch", "__block", F.row_number().over(over).alias("block"), (F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    within = Window.partitionBy("__of", "epoch", "__block").orderBy("__at", F.col(key).asc_nulls_first(), "n_tokens", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("__run", F.sum("n_tokens").over(within)).join(blocks, ["__of", "epoch", "__block"])
    upto = F.col("__before") + F.col("__run")
    return placed.where(F.col("epoch") * F.col("__t") + upto <= F.col("__budget")).select(*map(col, kept), "n_tokens", "weight", "epoch", "block", upto.alias("upto"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, weight, epoch, block, upto of every copy in the mixture: half-way from the natural entropy to the even one, at as many tokens as there are."""
    counted = written(docs.select("doc_id", "source", words(F.col("text")).alias("__words")), "words")  # the texts are read once
    return mix(counted, tokens=F.col("__words"), entropy_part=0.5).select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "upto")


_WORDS = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT"
_KEY15 = "('0x' || substr(md5({}), 1, 15))::BIGINT"

SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, '') AS o, {_WORDS} AS n_tokens FROM documents),
s AS (SELECT o, sum(n_tokens)::BIGINT AS t, count(*) AS n FROM d GROUP BY o),
p AS (SELECT o, t, n, coalesce(t::DOUBLE / nullif((SELECT sum(t) FROM s), 0)::DOUBLE, 0) AS p FROM s),
g AS (SELECT sum(-p * ln(p)) + (ln(count(*)) - sum(-p * ln(p))) * 0.5 AS target FROM p WHERE p > 0),
b(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN fits THEN lo ELSE (lo + hi) / 2 END, CASE WHEN fits THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) <= (SELECT target FROM g) FROM p WHERE p > 0) AS fits FROM b WHERE i < {STEPS})
),
w AS (SELECT o, t, n, round(CASE WHEN p > 0 THEN pow(p, (SELECT hi FROM b WHERE i = {STEPS})) ELSE 0 END / (SELECT sum(pow(p, (SELECT hi FROM b WHERE i = {STEPS}))) FROM p WHERE p > 0), 9) AS weight FROM p),
plan AS (SELECT o, t, weight, floor(weight * (SELECT sum(t) FROM s)::DOUBLE)::BIGINT AS budget, ceil(sqrt(n))::BIGINT AS blocks FROM w),
e AS (SELECT doc_id, source, d.o, n_tokens, weight, budget, t, {_KEY15.format("'7|' || coalesce(doc_id::VARCHAR, '')")} % blocks AS blk, unnest(range(0, CASE WHEN t > 0 THEN budget // t ELSE 0 END + 1)) AS epoch FROM d JOIN plan ON d.o = plan.o),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY o, epoch, blk ORDER BY {_KEY15.format("'7|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')")}, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM e),
k AS (SELECT o, epoch, blk, sum(n_tokens) AS nb, {_KEY15.format("'7|block|' || epoch || '|' || o || '|' || blk")} AS ord FROM e GROUP BY o, epoch, blk),
kk AS (SELECT o, epoch, blk, row_number() OVER (PARTITION BY o, epoch ORDER BY ord, blk) AS block, sum(nb) OVER (PARTITION BY o, epoch ORDER BY ord, blk ROWS UNBOUNDED PRECEDING) - nb AS before FROM k)
SELECT doc_id, source, n_tokens, weight, r.epoch::BIGINT AS epoch, block::INTEGER AS block, (before + run)::BIGINT AS upto
FROM r JOIN kk ON r.o = kk.o AND r.epoch = kk.epoch AND r.blk = kk.blk
WHERE r.epoch * t + before + run <= budget
"""
