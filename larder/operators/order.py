"""Places in a sorted table of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Ranges whose counts are broadcast to their rows at most; with more of them the join shuffles.
MOST_BROADCAST = 100_000


def numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "rank", first: int = 1) -> DataFrame:
    """``df`` with the place of each row in ``order``, from ``first``, apart for each value of the columns ``by``.

    The rows are dealt into sorted ranges once and written with their place in their range.  The counts that are added to it
    come from that written table, so both always speak of the same ranges.  No window holds the rows: a value of ``by``
    lies in as many ranges as its rows need.  Of rows that tie any may be first.
    """
    keys = [*(F.col(f"`{c}`").asc() for c in by), *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = written(ranged.withColumn("__id", F.monotonically_increasing_id()), "ranged")
    named = [F.col(f"`{c}`").alias(f"__by{k}") for k, c in enumerate(by)]
    counts = table.select(*named, F.shiftright("__id", 33).alias("__range"), "__id").groupBy(*(f"__by{k}" for k in range(len(by))), "__range").agg(F.count("*").alias("n"), F.min("__id").alias("__low"))
    before = F.sum("n").over(Window.partitionBy(*(f"__by{k}" for k in range(len(by)))).orderBy("__range")) - F.col("n")
    counts = written(counts.withColumn("__before", before), "range-counts")
    if counts.count() <= MOST_BROADCAST:
        counts = F.broadcast(counts)
    same = F.shiftright(table["__id"], 33) == counts["__range"]
    for k, c in enumerate(by):
        same &= table[f"`{c}`"].eqNullSafe(counts[f"__by{k}"])
    place = F.col("__before") + F.col("__id") - F.col("__low") + F.lit(first)
    made = table.join(counts, same).select(*(table[f"`{c}`"] for c in df.columns if c != out), place.cast("long").alias(out))
    made.larder_tables = (table, counts)
    return made
