"""Exact Jaccard join of documents' word n-grams.

Method: token-combination prefixes.  A document's tokens, here its distinct n-word shingles, stand in one global order: by
frequency class, rare classes first, then by hash.  Of two sets with overlap O, the first |x| - O + k tokens of each
share at least k.  So documents with long sets index each token of the plain prefix (k = 1); documents with short sets
extend it by one token (k = 2) and index rare tokens singly and frequent ones by 2-token combinations: of two shared tokens one is
rare, or both are frequent and their combination is shared.  Sets near the border between long and short are indexed
both ways.  Candidates that share a key pass a length filter, a positional filter (see index_keys and its use) and a parity-bitmap
filter, all lossless, and are verified on their sets.  Frequency classes only order the tokens: they are counted over all documents, and a token left out of them is rare.

Equal sets are one node, so that copies of any number cost one row each.  Returned are components: see graph.link_buckets
for what is not compared because it couldn't change them.

Shingles are 64-bit hashes: within a pair of sets of 10^4 two different ones collide with odds of 10^-11.

Defined cases: null or blank texts have an empty set and link with nothing; rows with a null id take no part, their component is null;
rows that share an id are one document; a single word up to n - 1 words are one shingle, unequal to all longer ones; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import arrow_rows, col, ends_of, lookup, slices, small, written

#: Sets of at most this size (and somewhat beyond) are indexed by combinations of frequent tokens.
SHORT = 100
#: Tokens a task counts at once, and the count in such a batch, and in all, from which a token can be frequent.
COUNTED, LOCAL, FREQUENT = 2_000_000, 2, 4
#: Frequent tokens whose class is told to all tasks. Others count as rare: this bounds the broadcast and changes no result.
CLASSES = 1 << 20
BITS = 512

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; words are runs without ASCII blanks, A-Z lower-cased."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=len(words) + 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = _mix(out * _A + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def least_overlap(n: int, percent: int) -> int:
    """Of a set of n tokens, how many any linked set shares."""
    return -(-n * percent // 100)


def classes_of(tokens: np.ndarray, known: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Frequency class of each token, 0 for rare ones."""
    if not len(known):
        return np.zeros(len(tokens), np.int8)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, level[at], 0).astype(np.int8)


def index_keys(tokens: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set is indexed, and how many tokens follow each one's place in the order (for a
    combination: its last token's place, less the one shared before it)."""
    n = len(tokens)
    if n < 2:  # a set of one token links with equal sets only
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    order = np.lexsort((tokens, level))
    plain, keys, rest = n - least_overlap(n, percent) + 1, [], []
    if n >= SHORT:
        keys.append(_mix(tokens[order[:plain]] + _A))
        rest.append(n - 1 - np.arange(plain))
    if n * percent <= SHORT * 100:
        first = order[: plain + 1]
        rare = int((level[first] == 0).sum())  # they come first
        keys.append(_mix(tokens[first[:rare]] + _B))
        rest.append(n - 1 - np.arange(rare))
        i, j = np.triu_indices(len(first) - rare, 1)
        frequent = tokens[first[rare:]]
        keys.append(_mix(_mix(frequent[i] + _C) * _A + frequent[j]))
        rest.append(n - rare - j)
    return np.concatenate(keys), np.concatenate(rest).astype(np.int32)


def parity(tokens: np.ndarray) -> bytes:
    """Bit i: whether an odd number of tokens falls on i. Two sets differ in at least as many tokens as their bitmaps in bits."""
    width = BITS
    while width < len(tokens) // 2 and width < 1 << 16:
        width *= 2
    return np.packbits((np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(na: np.ndarray, a: list[bytes], nb: np.ndarray, b: list[bytes], percent: int) -> np.ndarray:
    """Whether the bitmaps allow the overlap that a link needs."""
    total = na + nb
    most = total - 2 * (-(-total * percent // (100 + percent)))
    out = np.zeros(len(na), bool)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        while len(p) > len(q):
            p = p[: len(p) // 2] ^ p[len(p) // 2 :]
        while len(q) > len(p):
            q = q[: len(q) // 2] ^ q[len(q) // 2 :]
        out[i] = int(np.bitwise_count(p ^ q).sum()) <= most[i]
    return out


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many documents hold, sorted, and their classes: powers of two of the documents counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(t[c >= LOCAL].view(np.int64)), pa.array(c[c >= LOCAL].astype(np.int64))], names=["token", "n"])

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                held.append(shingles(t, n))
                size += len(held[-1])
                if size >= COUNTED:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = counted.orderBy(F.desc("n"), "token").limit(CLASSES).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(np.maximum(top["n"].to_numpy(np.int64), 1)).astype(np.int8)[order]


def components(df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every row; rows link when 100 * intersection >= percent * union of their shingle sets."""
    spark = df.sparkSession
    docs = df.select(col(key).cast("long").alias("id"), col(text).alias("text"))
    known = spark.sparkContext.broadcast(_frequent(docs, n))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            sizes, sigs, bits, keys, rests = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, n)
                sizes.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                bits.append(parity(s))
                key, rest = index_keys(s, classes_of(s, *known.value), percent)
                keys.append(key.view(np.int64))
                rests.append(rest)
            ends = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, kind), *x]))) for x, kind in ((keys, np.int64), (rests, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(bits, pa.binary()), *lists], names=["id", "n", "sig", "bits", "keys", "rests"])

    table = written(docs.mapInArrow(index, "id long, n int, sig binary, bits binary, keys array<long>, rests array<int>"), "sets")
    sets = table.where("id is not null and n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    sets = written(sets, "reps")
    several = sets.where("copies > 1").select("sig", "rep", "copies")
    copies = written(lookup(table.select("id", "sig"), several, "sig", F.col("id"), "copies").where("id != rep").select("id").distinct(), "copies")
    nodes = table.where("id is not null and n > 1").join(small(copies), "id", "left_anti")
    keys = nodes.select(F.explode(F.arrays_zip("keys", "rests")).alias("k"), "id", "n").select(F.col("k.keys").alias("key"), "id", "n", F.col("k.rests").alias("rest"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        info = written(table.select("id", "n", "bits").join(small(ends_of(pairs)), "id", "left_semi").dropDuplicates(["id"]), "info")
        a, b = info.toDF("a", "na", "bits_a"), info.toDF("b", "nb", "bits_b")

        @F.pandas_udf("boolean")
        def maybe(na: pd.Series, x: pd.Series, nb: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(may_link(na.to_numpy(np.int64), list(x), nb.to_numpy(np.int64), list(y), percent))

        likely = written(pairs.join(a, "a").join(b, "b").where(maybe("na", "bits_a", "nb", "bits_b")).select("a", "b"), "likely")

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, n).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "set"])

        whole = written(docs.join(small(ends_of(likely)), "id", "left_semi").mapInArrow(of, "id long, set binary").dropDuplicates(["id"]), "whole")

        @F.pandas_udf("boolean")
        def linked(x: pd.Series, y: pd.Series) -> pd.Series:
            def one(p: bytes, q: bytes) -> bool:
                s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                return 100 * both >= percent * (len(s) + len(t) - both)

            return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

        both = likely.join(whole.toDF("a", "set_a"), "a").join(whole.toDF("b", "set_b"), "b")
        with arrow_rows(spark, 128):
            return written(both.where(linked("set_a", "set_b")).select("a", "b"), "linked")

    # sizes fit; and if the key is the pair's first shared one, as many tokens follow on both sides as the overlap still needs
    rests = f"{100 + percent} * (1L + least(ra, rb)) >= {percent} * (na + nb)"
    found = graph.link_buckets(keys, f"100 * least(na, nb) >= {percent} * greatest(na, nb)", verify, rests)
    of_set = sets.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("sig", F.coalesce("label", "rep").alias("label"), "copies", "rep").where("copies > 1 or label != rep")
    of_set = written(of_set.select("sig", "label", "copies"), "labels-of-sets")
    return lookup(table.select("id", "n", "sig"), of_set, "sig", F.col("id"), "copies").select(
        F.col("id").cast(df.schema[key].dataType).alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("label", "id")).otherwise(F.col("id")).alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; documents without an id or without words stay."""
    gone = written(components(docs, n, percent).where("doc_id != component_id").select("doc_id").distinct(), "copies")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
