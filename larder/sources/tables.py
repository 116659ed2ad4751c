"""Intermediate tables in the folder that driver and executors share, and this package on the executors."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where neither that setting nor a checkpoint folder exists (tests, a single machine) a temporary one is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larder-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get()
    return folder.rstrip("/")


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.larder_path = path
    for held in _SCRATCH:
        held.append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch(*kept: str):
    """Deletes the tables written inside when it ends without an error, but for those whose names are ``kept``: a result still reads them."""
    held: list[DataFrame] = []
    _SCRATCH.append(held)
    try:
        yield
    finally:
        _SCRATCH.remove(held)
    for table in held:
        if table.larder_path.rsplit("/", 1)[1][:-33] not in kept:
            forget(table)


def forget(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written` that no later step reads."""
    path = getattr(df, "larder_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: only then Spark deletes the shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: list = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="larder-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(x for x in root.rglob("*") if x.suffix in (".py", ".txt")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.append(app)
