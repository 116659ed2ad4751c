"""Embedding of a text column, with a provider interface and a cache by text hash."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], np.ndarray]

DIM, HASHES, NOISE = 384, 8, 0.05


def sanitised(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def hash_bag(text: Column, dim: int = DIM, hashes: int = HASHES) -> Column:
    """The dimensions that the text's words fall on, ``hashes`` for each occurrence: the hash embedding without noise, as an array of longs."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z0-9_]+)"), F.lit(1))
    digests = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda k: F.sha2(F.concat(w, F.lit("_"), k.cast("string")), 256))))
    first = lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.transform(digests, lambda h: F.pmod(F.conv(first(h), 16, 10).cast("bigint"), F.lit(dim)))


def hash_provider(dim: int = DIM, noise: float = NOISE) -> Provider:
    """Words hashed into dimensions, a little noise seeded by the text, unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in re.findall(r"[a-zA-Z0-9_]+", text.lower()):
                for k in range(HASHES):
                    out[i, int.from_bytes(hashlib.sha256(f"{word}_{k}".encode()).digest()[:4], "little") % dim] += 1
            if noise:
                seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "little")
                out[i] += noise * np.random.default_rng(seed).random(dim)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    encode.dim = dim
    return encode


def embed(df: DataFrame, text: str, provider: Provider | None = None, cache: DataFrame | None = None, batch: int = 64, out: str = "embedding") -> DataFrame:
    """``df`` with an embedding and text_hash; each distinct text is encoded once, and not if the cache (text_hash, embedding) has it.

    A batch that fails gives zero vectors, as long as the provider's attribute ``dim`` says, and is_success false.
    """
    encode = provider or hash_provider()
    width = getattr(encode, "dim", DIM)
    hashed = df.withColumn("__text", sanitised(F.col(text))).withColumn("text_hash", F.sha2(F.col("__text"), 256))
    wanted = hashed.select("text_hash", "__text").dropDuplicates(["text_hash"])
    if cache is not None:
        wanted = wanted.join(cache.select("text_hash"), "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                try:
                    vectors, ok = [v.tolist() for v in encode(part["__text"].tolist())], True
                except Exception:  # noqa: BLE001 - the batch is marked
                    vectors, ok = [[0.0] * width] * len(part), False
                yield pd.DataFrame({"text_hash": part["text_hash"], out: vectors, "is_success": ok})

    made = wanted.mapInPandas(run, f"text_hash string, {out} array<float>, is_success boolean")
    if cache is not None:
        made = made.unionByName(cache.select("text_hash", F.col("embedding").cast("array<float>").alias(out), F.lit(True).alias("is_success")))
    return hashed.drop("__text").join(made, "text_hash", "left")


def cache_split(df: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """n_rows, n_distinct, n_hits, n_misses of the table's distinct texts against a cache."""
    hashed = df.select(F.sha2(sanitised(F.col(text)), 256).alias("text_hash"))
    distinct = hashed.groupBy("text_hash").agg(F.count("*").alias("n"))
    known = distinct.join(cache.select("text_hash").distinct().withColumn("hit", F.lit(True)), "text_hash", "left")
    return known.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.count_if("hit").alias("n_hits"), F.count_if(F.col("hit").isNull()).alias("n_misses"))


def statistics(embedded: DataFrame, out: str = "embedding") -> DataFrame:
    return embedded.agg(F.count("*").alias("n"), F.countDistinct("text_hash").alias("n_distinct"), F.count_if(~F.col("is_success")).alias("n_failed"), F.max(F.size(out)).alias("dim"))
