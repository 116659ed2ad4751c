"""Keyword search by BM25 over a stored postings table, and its fusion with vector scores.

A span is up to SPAN documents that were read one after the other; a document is known by its span and its place there.  ``path/postings`` has a row for each
term in each span: the places of its documents, the term's weight in each (all of BM25 but the inverse frequency), and the largest of them, sorted by
term and span, so that files are pruned by term.  ``path/documents`` has the key of each place, ``path/terms`` the number of documents of each term.

While it is built a document's words are counted where it is read.  What is shuffled is a row for each term in each batch of documents, five bytes a document; texts and
single postings are not.  The counts are written before, so that every document has one place, also if tasks run again.

A search sums the largest weights of its terms for each span: no document of a span can score more.  The spans with the highest bounds are scored
first; their k-th best score then skips every span whose bound is lower.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import forget, ship, written

K1, B = 1.2, 0.75
#: Documents of a span, and spans scored before others are skipped.
SPAN, FIRST = 1024, 4
#: The vector score's part in a fused score.
VECTOR_WEIGHT = 0.7
#: Scores are sums of doubles in any order: a bound must be lower by this.
SLACK = 1e-9
#: Words of a batch of documents whose terms are counted at a time, about, and documents of it at most.
BATCH_WORDS, BATCH_DOCS = 1 << 22, 1 << 16
#: Spans that are named in the filter that finds the keys of a search's documents; with more of them all are read.
NAMED_SPANS = 1000
#: A document in a row of the shuffle: its place in the batch, the term's count and the document's length.
NARROW, WIDE = (np.dtype([("at", "<u2"), ("n", n), ("length", length)]) for n, length in (("u1", "<u2"), ("<u4", "<u4")))


def terms_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


@dataclass
class Keywords:
    """A stored postings table."""

    spark: SparkSession
    path: str
    key: str
    span: int = SPAN

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def bounds(self, terms: list[str]) -> DataFrame:
        """span, bound: more than any document of the span scores."""
        return self._read("postings").select("term", "span", "most").where(F.col("term").isin(terms)).join(F.broadcast(self._idf(terms)), "term").groupBy("span").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))

    def _idf(self, terms: list[str]) -> DataFrame:
        return self._read("terms").where(F.col("term").isin(terms)).select("term", "idf")  # a query's terms

    def scores(self, terms: list[str], spans: DataFrame | None = None) -> DataFrame:
        """span, at, score of the documents that have one of the terms, in some spans or all; equal documents have equal scores."""
        found = self._read("postings").where(F.col("term").isin(terms)).select("term", "span", "at", "weight")
        if spans is not None:
            found = found.join(spans.select("span"), "span", "left_semi")
        each = found.join(F.broadcast(self._idf(terms)), "term").select("span", "term", "idf", F.explode(F.arrays_zip("at", "weight")).alias("p"))
        parts = each.groupBy("span", "p.at").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("idf") * F.col("p.weight")).alias("part")))).alias("parts"))  # a query's terms
        return parts.select("span", "at", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))

    def kept_spans(self, terms: list[str], k: int) -> DataFrame:
        """The spans that can hold one of the k best documents."""
        bounds = written(self.bounds(terms), "bounds")
        first = bounds.orderBy(F.desc("bound"), "span").limit(FIRST)
        last = self.scores(terms, F.broadcast(first)).orderBy(F.desc("score")).limit(k).agg(F.when(F.count("*") == k, F.min("score")).alias("last"))  # one row
        return bounds.join(F.broadcast(last)).where(F.col("last").isNull() | (F.col("bound") >= F.col("last") - SLACK)).select("span", "bound")

    def search(self, query: str, k: int) -> DataFrame:
        """key, score, rank of the k best documents for the words of ``query``; documents with none of them aren't found."""
        terms = _terms(self.spark, query)
        if not terms:
            return self._read("documents").limit(0).select(F.col("id").alias(self.key), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        scored = written(self.scores(terms, self.kept_spans(terms, k)), "scores")
        last = scored.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("last"))  # one row
        best = written(scored.join(F.broadcast(last)).where(F.col("score") >= F.col("last")).select("span", "at", "score"), "best")  # k rows, and more that tie with the last
        forget(scored)
        keys, named = self._read("documents"), [r[0] for r in best.select("span").distinct().limit(NAMED_SPANS + 1).collect()]
        if len(named) <= NAMED_SPANS:
            keys = keys.where(F.col("span").isin(named))
        top = keys.join(best, ["span", "at"]).orderBy(F.desc("score"), "id").limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select(F.col("id").alias(self.key), "score", "rank")  # k rows


def _terms(spark: SparkSession, query: str) -> list[str]:
    return sorted(set(spark.range(1).select(terms_of(F.lit(query))).first()[0]))


def _counted(span: int):
    """Batches of id, terms as rows (term, span, docs, wide) for each term of a batch, ``span`` being its first one, and one with the ids and the number of words."""
    most = BATCH_DOCS // span * span or span

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            words, lo = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while lo < batch.num_rows:
                before = words[lo - 1] if lo else 0
                high = max(int(np.searchsorted(words, before + BATCH_WORDS, "right")), lo + 1)
                if high < batch.num_rows:  # whole spans
                    high = max(high - (high - lo) % span, min(lo + span, batch.num_rows))
                some = batch.slice(lo, min(high, lo + most) - lo)
                yield from rows(some, number)
                number += -(-some.num_rows // span)
                lo += some.num_rows

    def rows(some: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
        ids, terms, n = some.column("id"), some.column("terms"), some.num_rows
        lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        names = ["term", "span", "docs", "wide", "ids", "words"]
        held = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([number]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_()), held, pa.array([int(lengths.sum())])], names=names)
        coded = terms.flatten().dictionary_encode()
        if not len(coded):
            return
        key, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
        code, at = key // n, key % n
        wide = bool(counts.max() > 255 or lengths.max() > 65535 or n > 65536)
        docs = np.empty(len(key), WIDE if wide else NARROW)
        docs["at"], docs["n"], docs["length"] = at, counts, lengths[at]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        ends = (np.append(first, len(key)) * docs.itemsize).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(docs)])
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])).cast(pa.string()), pa.array(np.full(len(first), number)), packed, pa.array(np.full(len(first), wide)), pa.nulls(len(first), held.type), pa.nulls(len(first), pa.int64())], names=names)

    return told


def _weighed(span: int, mean: float):
    """Rows (term, span, docs, wide) as postings: term, span, most, at, weight."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = batch.column("docs")
            kinds = batch.column("wide").to_numpy(zero_copy_only=False).astype(bool)
            each = pc.binary_length(packed).to_numpy() // np.where(kinds, WIDE.itemsize, NARROW.itemsize)
            if kinds.any():
                docs = np.concatenate([np.frombuffer(x.as_buffer(), WIDE if w else NARROW).astype(WIDE) for x, w in zip(packed, kinds, strict=True)])
            else:
                ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
                docs = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(NARROW)
            row, at, n = np.repeat(np.arange(len(each)), each), docs["at"].astype(np.int64), docs["n"].astype(np.int64)
            weight = n * (K1 + 1) / (n + K1 * (1 - B + B * docs["length"].astype(np.int64) / mean))
            own = at // span
            first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
            of, ends = row[first], pa.array(np.append(first, len(row)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("term").take(pa.array(of)), pa.array(batch.column("span").to_numpy()[of] + own[first]), pa.array(np.maximum.reduceat(weight, first)), pa.ListArray.from_arrays(ends, pa.array((at % span).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight))],
                names=["term", "span", "most", "at", "weight"],
            )

    return told


def build_keywords(docs: DataFrame, path: str, key: str = "row_id", text: str = "text", span: int = SPAN) -> Keywords:
    """Store the postings of ``docs`` below ``path``. Keys are taken to be unique; null and empty texts have no words but count as documents."""
    spark = docs.sparkSession
    ship(spark)
    ids = docs.select(F.col(key).alias("id"), terms_of(F.col(text)).alias("terms"))
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("span", T.LongType()), T.StructField("docs", T.BinaryType()), T.StructField("wide", T.BooleanType()), T.StructField("ids", T.ArrayType(ids.schema["id"].dataType)), T.StructField("words", T.LongType())])
    counted = written(ids.mapInArrow(_counted(span), schema), "term-counts")
    batches = counted.where(F.col("term").isNull()).select("span", "ids", "words")
    total, words = batches.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    placed = batches.select("span", F.posexplode("ids").alias("pos", "id"))
    placed.select((F.col("span") + F.floor(F.col("pos") / span)).alias("span"), (F.col("pos") % span).alias("at"), "id").write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/documents")
    ranged = counted.where(F.col("term").isNotNull()).select("term", "span", "docs", "wide").repartitionByRange("term", "span").sortWithinPartitions("term", "span")
    ranged.mapInArrow(_weighed(span, words / total if words else 1.0), "term string, span long, most double, at array<int>, weight array<double>").write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/postings")
    forget(counted)
    df = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df.select("term", "df", idf.alias("idf")).repartitionByRange("term").sortWithinPartitions("term").write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/terms")
    return Keywords(spark, path, key, span)


def load_keywords(spark: SparkSession, path: str, key: str = "row_id") -> Keywords:
    return Keywords(spark, path, key)


def fused(vector_scores: DataFrame, keyword_scores: DataFrame, k: int, key: str = "row_id", weight: float = VECTOR_WEIGHT) -> DataFrame:
    """key, score, rank of the k best by ``weight`` times the vector score and the rest times the keyword score, which is taken relative to its best.

    A row that one of the searches didn't find has a score of 0 there.
    """
    best = keyword_scores.agg(F.max("score").alias("best"))  # one row
    words = keyword_scores.join(F.broadcast(best)).select(key, F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0).alias("words"))
    both = vector_scores.select(key, F.col("score").alias("near")).join(words, key, "full")
    total = weight * F.coalesce("near", F.lit(0.0)) + (1 - weight) * F.coalesce("words", F.lit(0.0))
    top = both.select(key, total.alias("score")).orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


def hybrid_search(index: Keywords, items: DataFrame, query: str, query_vector: list[float], k: int, key: str = "row_id", vector: str = "embedding", weight: float = VECTOR_WEIGHT, deep: int = 10) -> DataFrame:
    """The k best by both scores, among the ``deep`` * k best of each search."""
    from .search import search

    return fused(search(items, query_vector, deep * k, key=key, vector=vector), index.search(query, deep * k), k, key, weight)
