"""Answers for a table of prompts: cache, provider, checks, statistics.

The cache is a Parquet table of responses by everything that shapes them.  Prompts with equal keys are answered once: the keys that no fresh
response has are found by an anti-join, and only those go to the provider.  What it answered is appended to the table, and all prompts get
their answers from there.  A response is fresh for ``seconds``; of several the youngest counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import response_warnings, token_estimate
from .prompts import generate, mock_response, system_parts

#: A provider is a function of the prompt column, or of a list of prompts (which gets them in Arrow batches).
Provider = Callable[[Column], Column]
SCHEMA = "cache_key string, response string, created_at double"


@dataclass
class ResponseTable:
    """Responses below a folder."""

    spark: SparkSession
    path: str
    seconds: float = 3600.0
    options: dict = field(default_factory=dict)

    def key(self, prompt: Column) -> Column:
        """SHA-256 of the prompt and of the options that shape a response."""
        return F.sha2(F.concat_ws("\u0000", F.lit(json.dumps(self.options, sort_keys=True)), F.coalesce(prompt, F.lit(""))), 256)

    def _held(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        reader = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True)
        return reader.parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def fresh(self, now: float) -> DataFrame:
        """cache_key, response of the youngest response of each key, if it isn't older than ``seconds``."""
        young = self._held().where((F.col("created_at") > now - self.seconds) & (F.col("created_at") <= now))
        return young.groupBy("cache_key").agg(F.max_by("response", F.struct("created_at", "response")).alias("response"))

    def put(self, responses: DataFrame) -> None:
        """Append cache_key, response, created_at; each batch of them is a folder that appears when it is whole."""
        responses.select("cache_key", "response", "created_at").write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")

    def compact(self, now: float) -> None:
        """Leave one fresh response for each key: written beside, then put in place."""
        kept = self.fresh(now).withColumn("created_at", F.lit(float(now)))
        held = self._held().groupBy("cache_key").agg(F.max("created_at").alias("created_at"))
        kept.drop("created_at").join(held, "cache_key").write.parquet(f"{self.path}-next")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = fs_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.delete(fs_path(self.path), True)
        files.mkdirs(fs_path(self.path))
        files.rename(fs_path(f"{self.path}-next"), fs_path(f"{self.path}/batch-{uuid.uuid4().hex}"))


class Answerer:
    """Prompts in, answers out: looks up, asks, checks and counts."""

    def __init__(self, cache: ResponseTable, provider: Provider | None = None, model: Callable[[list[str]], list[str]] | None = None, leaks: Iterable[str] | None = None):
        self.cache, self.model = cache, model
        self.provider = provider or mock_response
        self.leaks = list(leaks) if leaks is not None else system_parts("the restaurant's assistant")

    def answer(self, prompts: DataFrame, now: float) -> DataFrame:
        """``prompts`` (with a column prompt) and response, cached, warnings, prompt_tokens, response_tokens.

        The provider's work is done and stored before this returns, so reading the result twice asks nobody again.
        """
        keyed = prompts.withColumn("cache_key", self.cache.key(F.col("prompt")))
        known = self.cache.fresh(now)
        missing = keyed.groupBy("cache_key").agg(F.min("prompt").alias("prompt")).join(known, "cache_key", "left_anti")
        asked = generate(missing, self.model) if self.model else missing.withColumn("response", self.provider(F.col("prompt")))
        self.cache.put(asked.select("cache_key", F.coalesce("response", F.lit("")).alias("response"), F.lit(float(now)).alias("created_at"), F.lit(True).alias("new")).drop("new"))
        held = self.cache._held().where(F.col("created_at") <= now)
        youngest = held.where(F.col("created_at") > now - self.cache.seconds).groupBy("cache_key").agg(F.max_by("response", F.struct("created_at", "response")).alias("response"), (F.max("created_at") < now).alias("cached"))
        out = keyed.join(youngest, "cache_key")
        warnings = response_warnings(F.col("response"), self.leaks)
        return out.select(*(f"`{c}`" for c in prompts.columns), "response", "cached", warnings.alias("warnings"), token_estimate(F.coalesce("prompt", F.lit(""))).alias("prompt_tokens"), token_estimate(F.col("response")).alias("response_tokens"))


def generation_statistics(answers: DataFrame) -> DataFrame:
    """One row: prompts, how many were answered from the cache and how many not, flagged answers, tokens in and out."""
    return answers.agg(
        F.count("*").alias("prompts"),
        F.count_if("cached").alias("hits"),
        F.count_if(~F.col("cached")).alias("misses"),
        F.count_if(F.size("warnings") > 0).alias("flagged"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("response_tokens"), F.lit(0)).alias("response_tokens"),
    )


def warning_counts(answers: DataFrame) -> DataFrame:
    """warning, n: how many answers have each warning."""
    return answers.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))
