"""CSV files with line ends inside quotes, read by several tasks a file.

A line can't tell alone whether it begins inside quotes.  So every split's quotes are counted first; the parity of all quotes of a file before a split, an XOR over
the splits before it, tells whether the split begins inside quotes.  In the second pass each split puts its lines together to
records.  A record that crosses the end of a split leaves a piece in each split it touches; these few pieces are put together by file.

Quotes inside cells are doubled, and cells with quotes are quoted, as RFC 4180 has it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What columns are tried as, in this order, where no schema is given; a column with another value in it is a string.
KINDS = ("int", "bigint", "double", "date", "timestamp", "boolean")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, at (its place in the file's order), record: the CSV records, header lines included."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    odd = lines.groupBy("file", "split").agg((F.sum(quotes) % 2).cast("int").alias("odd"))  # a row for each split
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("split")) - F.col("odd")
    begins = odd.select("file", "split", (before % 2 == 1).alias("inside"))
    placed = lines.join(F.broadcast(begins), ["file", "split"])

    def joined(batches: Iterator) -> Iterator:
        """Records of a task's splits; whole, or pieces: 0 the end of one begun before, 1 nothing but a middle, 2 the beginning of one."""
        import pyarrow as pa

        names = ["file", "split", "nth", "piece", "record"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.large_string()]
        place, held, open_, cut, nth, out = None, [], False, False, 0, []

        def closed(last: bool) -> None:
            nonlocal nth
            if held:
                piece = (1 if open_ and last else 0) if cut else (2 if open_ and last else None)
                out.append((*place, nth, piece, "\n".join(held)))
                nth += 1

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

        for rows in batches:
            for file, split, value, inside in zip(*(rows.column(c).to_pylist() for c in ("file", "split", "value", "inside")), strict=True):
                if (file, split) != place:
                    closed(True)
                    place, held, open_, cut, nth = (file, split), [], inside, inside, 0
                held.append(value)
                if value.count('"') % 2:
                    open_ = not open_
                if not open_:
                    closed(False)
                    held, cut = [], False
            if len(out) >= 1024:
                yield batch()
                out = []
        closed(True)
        if out:
            yield batch()

    told = placed.select("file", "split", "value", "inside").mapInArrow(joined, "file string, split long, nth long, piece int, record string")
    whole = told.where("piece is null").select("file", "split", "nth", "record")
    # pieces of one record: a beginning, middles, an end, in the order of the splits
    pieces = told.where("piece is not null")
    number = F.sum(F.when(F.col("piece") == 2, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("split", "nth"))
    parts = F.array_sort(F.collect_list(F.struct("split", "nth", "record")))
    mended = pieces.withColumn("of", number).groupBy("file", "of").agg(parts.alias("p")).select("file", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["nth"].alias("nth"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    every = whole.unionByName(mended)
    return every.select("file", F.struct("split", "nth").alias("at"), F.regexp_replace("record", "\r$", "").alias("record"))


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of the first file's first record."""
    first = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    return first.columns


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header, or a folder of them with equal ones. Equal to the reader that takes a file as one task.

    Without a schema one more pass finds the kind of each column.
    """
    names = header(spark, path)
    rows = records(spark, path)
    heads = rows.groupBy("file").agg(F.min("at").alias("at"))  # a row for each file
    body = rows.join(F.broadcast(heads), ["file", "at"], "left_anti").where(F.col("record") != "")
    own = schema or T.StructType([T.StructField(n, T.StringType()) for n in names])
    told = body.select(F.from_csv("record", ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in own.fields), {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    return told if schema else told.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds_of(told).items()))


def kinds_of(df: DataFrame) -> dict[str, str]:
    """The first of KINDS that takes all of a string column's values: one aggregation for all columns and kinds."""
    fails = {(c, kind): F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kind).isNull()) for c in df.columns for kind in KINDS}
    dots = {c: F.count_if(F.col(f"`{c}`").rlike("[.eE]")) for c in df.columns}
    told = df.agg(*(F.count(f"`{c}`").alias(f"n{k}") for k, c in enumerate(df.columns)), *(x.alias(f"f{k}") for k, x in enumerate(fails.values())), *(x.alias(f"d{k}") for k, x in enumerate(dots.values()))).first()
    out = {}
    for k, c in enumerate(df.columns):
        good = [kind for j, (name, kind) in enumerate(fails) if name == c and told[f"f{j}"] == 0]
        good = [kind for kind in good if not (told[f"d{k}"] and kind in ("int", "bigint"))]
        out[c] = good[0] if good and told[f"n{k}"] else "string"
    return out
