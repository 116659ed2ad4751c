"""Catalogue files and versioned folders."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import wide
from .csv_splits import read_split_csv

CSV_NAMES = ("menu_items.csv", "recipes.csv")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """A CSV with a header. NaN in numeric columns counts as missing; give a schema to spare the pass that infers one.

    Cells with line ends need ``multiline``; large files are split over tasks with it, too.
    """
    if multiline:
        return missing_as_null(read_split_csv(spark, path, schema))
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return missing_as_null(df)


def missing_as_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(df.schema[c].dataType)) for c in floats}) if floats else df


def resolve(root: str, name: str, version: str | None = None) -> Path:
    """``root/name/version`` if it is there, else ``root/name``."""
    base = Path(root) / name
    folder = base / version if version and (base / version).is_dir() else base
    if not folder.is_dir():
        raise FileNotFoundError(f"no dataset {name!r} below {root}")
    return folder


def discover(folder: str | Path) -> Path:
    """The folder's catalogue: menu_items.csv before recipes.csv."""
    for name in CSV_NAMES:
        if (Path(folder) / name).is_file():
            return Path(folder) / name
    raise FileNotFoundError(f"none of {', '.join(CSV_NAMES)} in {folder}")


def with_row_id(df: DataFrame, by: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """A row id that doesn't depend on partitions: a hash of the row's values (or of ``by``) and of its number among equal rows."""
    values = [F.col(f"`{c}`") for c in by or df.columns]
    hashed = df.withColumn("__hash", F.xxhash64(*values))
    nth = F.row_number().over(Window.partitionBy("__hash").orderBy("__hash"))
    return hashed.withColumn("__nth", nth).withColumn(name, F.when(F.col("__nth") == 1, F.col("__hash")).otherwise(F.xxhash64("__hash", "__nth"))).drop("__hash", "__nth")


def write_items(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_embeddings(df: DataFrame, path: str, key: str = "row_id", vector: str = "embedding") -> None:
    """key, vector as Parquet, with a JSON of facts beside it."""
    df.select(key, vector).write.mode("overwrite").parquet(f"{path}/vectors")
    facts = df.agg(F.count("*").alias("rows"), F.max(F.size(vector)).alias("dim")).select(F.to_json(F.struct("rows", "dim")).alias("value"))
    facts.coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def read_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The vectors and their facts; either missing is an error."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    return spark.read.parquet(f"{path}/vectors"), facts


def widened(df: DataFrame, vector: str, dim: int, key: str = "row_id") -> DataFrame:
    return df.select(key, *wide(vector, dim))


def save_json(value: dict, path: str) -> None:
    """JSON, or YAML by suffix."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = yaml.safe_dump(value, sort_keys=True)
    else:
        text = json.dumps(value, indent=2, sort_keys=True)
    Path(path).write_text(text)


def load_json(path: str, required: tuple[str, ...] = ()) -> dict:
    """A JSON object that has the required keys."""
    return checked_json(Path(path).read_text(), path, required)


def checked_json(text: str, path: str, required: tuple[str, ...] = ()) -> dict:
    """The JSON object in the text of ``path``, which has the required keys."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no JSON") from e
    missing = [k for k in required if k not in value]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return value
