"""Fingerprints of files by a hash tree.

The leaves are the SHA-256s of a file's lines, told by many tasks; FAN leaves that follow each other make a node, and so on up to one.
Only digests are shuffled, no node has more than FAN of them, and a file of any size has many tasks.  The tree doesn't depend on how a file is split.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Files
from ..sources.tables import forget, written

FAN = 4096


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """file, at (a line's number in its file), hash of every line of every file below ``path``."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    told = written(lines.select(F.sha2("value", 256).alias("hash"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id")), "lines")
    splits = told.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("id").alias("low"))  # a row for each split
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")
    placed = told.join(F.broadcast(splits.select("file", "split", "low", before.alias("before"))), ["file", "split"])
    out = placed.select("file", (F.col("before") + F.col("id") - F.col("low")).alias("at"), "hash")
    out.larder_lines = told
    return out


def roots(spark: SparkSession, path: str) -> dict[str, str]:
    """name: root of the tree of each file below ``path``. Empty files have the hash of nothing."""
    level = leaves(spark, path)
    lines, table = level.larder_lines, level
    most = table.agg(F.max("at")).first()[0]
    while most:
        up = table.groupBy("file", F.floor(F.col("at") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("under"))
        table = up.select("file", F.col("up").alias("at"), F.sha2(F.array_join(F.transform("under", lambda x: x["hash"]), ""), 256).alias("hash"))
        most //= FAN
    told = {r["file"].rsplit("/", 1)[1]: r["hash"] for r in table.select("file", "hash").collect()}  # a row for each file
    forget(lines)
    return told


def file_hash(spark: SparkSession, path: str) -> str:
    """Of a file, or of all files below a folder, in name order."""
    told = roots(spark, path)
    if Files(spark).is_file(path):
        return next(iter(told.values()), hashlib.sha256().hexdigest())
    return hashlib.sha256(json.dumps(sorted(told.items())).encode()).hexdigest()
