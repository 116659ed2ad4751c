"""A corpus from raw documents to token ids, in five stages; each result is written as Parquet (the last by its stage) and read by the next stage.

The operators and their defined cases (nulls, empty and long texts, repeated rows, empty tables) are described in their modules in
larder/llm.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, jaccard, langid, lines, mixing
from larder.llm.common import arrow_rows, ship, written

#: A document whose corrected hit rate in its best language is lower isn't in any of the learned languages.
LEAST_LANGUAGE_SCORE = 0.2
#: Copies of a document in the mixture at most.
MOST_REPEATS = 2.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null texts, texts without letters and unknown languages go."""
    ship(spark)
    told = langid.predict(docs, langid.fit(docs), out="__lang", score="__score")
    return told.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur, equally or nearly, earlier in the corpus; a document of which nothing is left goes."""
    ship(spark)
    done = lines.dedup(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.where(~((F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", "\\s+", " ")) == ""))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a Jaccard similarity of 0.8 or more."""
    ship(spark)
    return jaccard.keep_one(docs, n=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more: small sources are repeated, none more than MOST_REPEATS times over the largest."""
    ship(spark)
    return mixing.mix(docs, most_repeats=MOST_REPEATS, cover=True).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every document, and whether the ids decode to its text."""
    ship(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    # executed here, where batches are small: JVM and Python hold several of each task at once
    with arrow_rows(spark, bpe.TRIP_ROWS):
        return written(both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip")), "token-ids")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: Byte-pair merges and links of similar lines can't be told in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = done if hasattr(done, "larder_path") else written(done, f"stage-{k}")
    return docs
