"""Uniform shuffle into shards of exact size.

Method: the rows lie in source blocks; a hypergeometric communication matrix says how many rows of each block go to each
destination bin.  Every task draws only the matrix rows of its own blocks, by walking one seeded binary tree over the
blocks: at each node the destination counts of a range are split between its halves by a multivariate hypergeometric
draw, so all rows together have exact margins and the matrix exists nowhere as a whole.  Rows are permuted within
their block, dealt to bins by these counts, exchanged, and permuted again within the bin.  A bin is an equal slice of a
shard, so that a shard of any size is ordered by many tasks.

A block is a hash of the whole row, not a physical partition: a task that is run again after a lost executor meets the
same rows with the same ranks whatever the layout was.  Law ``rows``: shard sizes differ by one row at most.

Defined cases: nulls are hashed like any value; repeated rows are interchangeable and each gets a slot of its own; an
empty table gives an empty table; columns named ``shard`` or ``slot`` are replaced, others kept.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, hashable

#: Rows of a block or bin that are aimed at, and the most blocks or bins: what the driver holds is one count per block.
ROWS_PER_BLOCK = 1024
MOST_BLOCKS = 8192


def bin_sizes(n: int, n_shards: int, per_shard: int) -> np.ndarray:
    """Sizes of the shards' bins: shards near equal, and bins near equal within their shard."""
    shard = n // n_shards + (np.arange(n_shards) < n % n_shards)
    part = np.arange(per_shard)
    return (shard[:, None] // per_shard + (part[None, :] < shard[:, None] % per_shard)).reshape(-1).astype(np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """One exact draw; beyond numpy's limit of 10^9 by inversion around the mode."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    n = good + bad
    spread = int(12 * math.sqrt(max(1.0, drawn * (good / n) * (bad / n) * (n - drawn) / max(1, n - 1)))) + 8
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)  # ratio of the weights of k + 1 and k
    step = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], "right"))


def split_counts(rng: np.random.Generator, colors: np.ndarray, drawn: int) -> np.ndarray:
    if colors.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(colors, drawn, method="marginals")
    out, rest = np.zeros_like(colors), int(colors.sum())
    for i, c in enumerate(colors.tolist()):
        rest -= c
        out[i] = hypergeometric(rng, c, rest, drawn)
        drawn -= int(out[i])
    return out


def matrix_row(block: int, ends: np.ndarray, bins: np.ndarray, seed: int) -> np.ndarray:
    """The counts by which one block's rows go to the bins. ends: rows before each block, and the total."""
    lo, hi, counts = 0, len(ends) - 1, bins
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_counts(np.random.default_rng([seed, lo, hi]), counts, int(ends[mid] - ends[lo]))
        lo, hi, counts = (lo, mid, left) if block < mid else (mid, hi, counts - left)
    return counts


def shard(df: DataFrame, n_shards: int, seed: int = 20240501) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard), uniformly shuffled."""
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(*map(col, kept)).withColumn("__key", F.xxhash64(F.lit(seed), *map(col, hashable(df.select(*map(col, kept))))))
    n = df.count()
    n_blocks = min(MOST_BLOCKS, max(1, -(-n // ROWS_PER_BLOCK)))
    per_shard = max(1, min(MOST_BLOCKS // n_shards, -(-n // (n_shards * ROWS_PER_BLOCK))))
    df = df.withColumn("__block", F.pmod("__key", F.lit(n_blocks)).cast("int"))
    counts = np.zeros(n_blocks, np.int64)
    for r in df.groupBy("__block").count().collect():  # MOST_BLOCKS rows at most
        counts[r[0]] = r[1]
    ends, bins = np.concatenate([[0], np.cumsum(counts)]), bin_sizes(n, n_shards, per_shard)

    @F.pandas_udf("int")
    def deal(block: pd.Series, rank: pd.Series) -> pd.Series:
        row = functools.lru_cache(64)(lambda b: np.cumsum(matrix_row(b, ends, bins, seed)))
        b, r = block.to_numpy(), rank.to_numpy()
        out = np.empty(len(b), np.int32)
        for x in np.unique(b):
            at = b == x
            out[at] = np.searchsorted(row(int(x)), r[at] - 1, "right")
        return pd.Series(out)

    local = Window.partitionBy("__block").orderBy(F.xxhash64("__key", F.lit("local")), "__key")
    final = Window.partitionBy("__bin").orderBy(F.xxhash64("__key", F.lit("final")), "__key")
    size = F.lit(n // n_shards) + (F.col("shard") < n % n_shards).cast("long")
    part = F.pmod("__bin", F.lit(per_shard)).cast("long")
    return (
        df.withColumn("__rank", F.row_number().over(local))
        .withColumn("__bin", deal("__block", "__rank"))
        .withColumn("__at", F.row_number().over(final))
        .withColumn("shard", F.floor(F.col("__bin") / per_shard).cast("int"))
        .withColumn("slot", part * F.floor(size / per_shard) + F.least(part, F.pmod(size, F.lit(per_shard).cast("long"))) + F.col("__at") - 1)
        .select(*map(col, kept), "shard", F.col("slot").cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard(docs.select("doc_id", "text"), n_shards).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
