"""The queries of this subpackage, each over its whole table, and their SQL where SQL can tell the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vectors

    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    return lines.deduped_documents(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mixed_documents(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import isomedia

    return isomedia.documents_as_media(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair

    return repair.repaired_conversations(_table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import phrases

    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.nearest(_table(spark, sf_dir, "embeddings"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after the package is known to the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_byte_bpe, op2_licenses, op3_sharding, op4_embedding_dedup, op5_language_id, op6_lines, op7_mixing, op8_warc, op9_media, op10_ngram_jaccard, op11_conversation_repair, op12_phrase_collocations, op13_exact_topk)
    return {f.__name__: _shipped(f) for f in own}


def oracle_sql() -> dict[str, str]:
    from . import licenses, mixing, phrases, repair, topk, warc

    return {"op2_licenses": licenses.sql(), "op7_mixing": mixing.SQL, "op8_warc": warc.SQL, "op11_conversation_repair": repair.SQL, "op12_phrase_collocations": phrases.SQL, "op13_exact_topk": topk.SQL}
