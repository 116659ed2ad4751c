"""Connected components and bucketed linking, on Spark tables only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES_ONLY, forget, small, written

#: Buckets of up to this many rows are joined with themselves directly.
FEW = 32
#: A key is hot if it has so many rows among one of SAMPLE ids. What the sample misses is still joined, by its shuffle.
SAMPLE, SAMPLED = 16, 32


def components(links: DataFrame) -> DataFrame:
    """id and label (the smallest id reachable) of every id in ``links`` (long columns a, b).

    Alternating large and small stars: each round hangs a node's larger neighbours, then its smaller ones, on its least
    neighbour.  Every round is written, and the loop ends when a round changes no edge.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(hung.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(edges)
        edges = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (id, label) after further ``links`` (a, b): only the components that they join are run through again."""
    known = small(found)
    told = links.join(known.toDF("a", "label_a"), "a", "left").join(known.toDF("b", "label_b"), "b", "left")
    tops = written(components(told.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))), "tops")
    every = found.unionByName(tops.select("id", F.col("id").alias("label"))).distinct()
    return written(every.join(small(tops).toDF("label", "top"), "label", "left").select("id", F.coalesce("top", "label").alias("label")), "labels")


def link_buckets(keys: DataFrame, sizes: str, verify: Callable[[DataFrame], DataFrame], rests: str = "true", group_rests: str | None = None, two: str = "true", within: Callable[[DataFrame], DataFrame] | None = None, shared: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Components of all links between ids that share a key, without comparing all pairs of a bucket.

    keys (a plan that is cheap to run again): long key, long id, int n (a size; may be left out), long rest (a bound or a code); sizes: condition on na, nb that any
    linked pair meets, and nearer sizes rather; rests: condition on na, nb, ra, rb that some shared key of any linked pair meets; group_rests: the same for
    two groups, by their smallest sizes and largest rests (by default rests, which smaller sizes and larger rests must meet rather);
    two: condition on both, the XOR of the rests in a bucket of two, that a linked pair meets; verify: table of distinct pairs (a, b) to a
    written table of the linked ones; within: written table of all rows (key, id, n, rest, label) of the buckets of more than FEW rows and several labels to a
    table of pairs (a, b) that has every linked pair of different labels that shares a key (by default a join of the labels, then of their rows);
    shared: is given the written table of all rows in buckets of several ids before any pair is verified.

    Three rounds, each leaving out pairs that the links so far have joined, as they could not change the result.  In
    the first every id is compared with the least id of its buckets, which joins a large group of copies in as many pairs as it
    has rows; in the second with the least ids of its other buckets; in the third with all that share a bucket and are in another component, whatever the bucket's size.
    Returns id, label.

    Hot keys, found in a sample of the keys, have their rows joined where they lie: a bucket of any size is never in one task.
    """
    group_rests = rests if group_rests is None else group_rests
    fits = f"{sizes} and {rests}"
    sized = "n" in keys.columns
    keys = keys.select("key", "id", *(["n"] if sized else []), F.col("rest").cast("long").alias("rest"))
    seen = keys.where(f"pmod(xxhash64(id), {SAMPLE}) = 0").groupBy("key").count().where(f"count >= {SAMPLED}")
    hot = small(written(seen.select("key"), "hot"))
    dealt = keys.join(hot, "key", "left_anti").repartition("key")
    # all columns are used on both sides, so that one exchange serves both
    told = (F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("of"), F.expr("bit_xor(rest)").alias("both"), *([F.max("n").alias("most")] if sized else []))
    fit = f"lead != last and (of > 2 or {two} and coalesce(both, 0) is not null)" + (" and coalesce(most, 0) >= 0" if sized else "")
    heads = dealt.groupBy("key").agg(*told).where(fit).select("key", "lead", "of")
    multi = dealt.join(heads.hint("shuffle_hash"), "key")  # what is hashed are the keys of several ids
    warm = written(keys.join(hot, "key", "left_semi"), "hot-rows")
    multi = multi.unionByName(warm.join(small(written(warm.groupBy("key").agg(*told).where(fit).select("key", "lead", "of"), "hot-heads")), "key"))
    multi = written(multi if sized else multi.withColumn("n", F.lit(0)), "buckets", **HASHES_ONLY)
    if shared is not None:
        shared(multi)
    leads = multi.where("id = lead").select("key", F.col("lead").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra")).dropDuplicates(["key"])
    stars = multi.where("id != lead").select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb")).join(leads, "key").where(fits)
    stars = written(stars.select("a", "b").distinct(), "stars", **HASHES_ONLY)
    found = written(components(verify(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))), "labels")

    more = verify(_apart(stars, found).select("a", "b"))
    forget(stars)
    if not more.isEmpty():
        found = merged(found, more)

    # what is left: buckets of three and more, without their least ids, in more than one component
    rest = multi.where("id != lead and of > 2").join(small(found), "id", "left").select("key", "id", "n", "rest", "of", F.coalesce("label", "id").alias("label"))
    own = ["key", "id", "n", "rest", "label"]
    rest = written(rest, "rest", **HASHES_ONLY)
    forget(multi)
    few = rest.where(f"of <= {FEW}").select(*own).repartition("key")  # one exchange for both sides
    x, y = few.toDF("key", "x", "na", "ra", "label"), few.toDF("key", "y", "nb", "rb", "other")
    last = x.join(y, "key").where("x < y and label != other").where(fits).select(F.col("x").alias("a"), F.col("y").alias("b"))
    large = rest.where(f"of > {FEW}").select(*own)
    # buckets of one component have nothing to compare
    mixed = written(large.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key"), "mixed-keys")
    large = written(large.join(small(mixed), "key", "left_semi"), "mixed")
    more = verify(last.unionByName(_large_buckets(large, sizes, rests, group_rests) if within is None else within(large)).distinct())
    return found if more.isEmpty() else merged(found, more)


def cells(rows: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Any two of ``rows`` (long key, id, label, size and others) that have the same key and different labels share a cell.

    The rows of a key are dealt into blocks of about ``most`` rows and ``most_bytes`` by their sizes, those of a label that needs several blocks apart from the others;
    a cell has the rows of two blocks of a key (side 0 and 1), or of one (side 2).  No cell has twice the same label's own blocks.
    Returns the rows with cell (a struct of numbers) and side.
    """
    parts = F.greatest(F.ceil(F.sum("of") / most), F.ceil(F.sum("held") / most_bytes), F.lit(1)).cast("int").alias("parts")
    labels = rows.groupBy("key", "label").agg(F.count("*").alias("of"), F.sum("size").alias("held")).withColumn("own", F.when(F.expr(f"of > {most} or held > {most_bytes}"), F.col("label")))
    labels = written(labels, "cell-labels")
    blocks = written(labels.groupBy("key", "own").agg(parts), "cell-blocks")
    labels = labels.join(small(blocks), (labels["key"] == blocks["key"]) & labels["own"].eqNullSafe(blocks["own"])).select(labels["key"], "label", labels["own"], "parts")
    block = F.struct(F.col("own").isNotNull().alias("pure"), F.coalesce("own", F.lit(0)).alias("own"), F.col("part").cast("int").alias("part"))
    each = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", block.alias("block"))
    meet = each.toDF("key", "one").join(each.toDF("key", "two"), "key").where("one <= two and not (one.pure and two.pure and one.own = two.own)")
    side = lambda k, name: F.struct(F.lit(k).alias("side"), F.col(name).alias("block"))
    sides = meet.select("key", F.struct("one", "two").alias("cell"), F.explode(F.when(F.expr("one = two"), F.array(side(2, "one"))).otherwise(F.array(side(0, "one"), side(1, "two")))).alias("at"))
    sides = written(sides.select("key", "cell", "at.side", "at.block"), "cell-sides")
    dealt = rows.join(small(written(labels, "cell-parts")), ["key", "label"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("block", block)
    return dealt.join(small(sides), ["key", "block"]).select(*rows.columns, "cell", "side")


def _large_buckets(rest: DataFrame, sizes: str, rests: str, group_rests: str) -> DataFrame:
    """Fitting pairs (a, b) of different labels within buckets of any size: pairs of labels first, then of their members,
    so that a bucket of many rows in few components costs no comparison of all its rows."""
    mixed = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    rest = written(rest.join(mixed, "key", "left_semi"), "mixed")
    groups = rest.groupBy("key", "label").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("most"), F.count("*").alias("of"))
    one, two = groups.toDF("key", "label", "low", "high", "most", "of"), groups.toDF("key", "other", "low2", "high2", "most2", "of2")
    # the groups' sizes overlap, or the ends that face each other fit
    near = f"(low <= high2 and low2 <= high or {renamed(sizes, na='high', nb='low2')} or {renamed(sizes, na='low', nb='high2')}) and {renamed(group_rests, na='low', nb='low2', ra='most', rb='most2')}"
    # the smaller group first: its rows are what the first of the two joins multiplies
    ordered = (F.col("of") < F.col("of2")) | (F.col("of") == F.col("of2")) & (F.col("label") < F.col("other"))
    apart = one.join(two, "key").where(ordered & F.expr(near)).select("key", "label", "other")
    of_one = rest.select("key", "label", F.col("id").alias("x"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    of_two = rest.select("key", F.col("label").alias("other"), F.col("id").alias("y"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    return apart.join(of_one, ["key", "label"]).join(of_two, ["key", "other"]).where(f"{sizes} and {rests}").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    found = small(found)
    told = pairs.join(found.toDF("a", "label_a"), "a", "left").join(found.toDF("b", "label_b"), "b", "left")
    return told.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))


def renamed(condition: str, **names: str) -> str:
    """A SQL condition with other expressions for some of its columns."""
    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: f"({names[m[1]]})", condition)
