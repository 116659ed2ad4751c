"""Language identification by language-bitmask n-gram filters.

Method: a bit-sliced Bloom filter, one position of the table holding a bit for every language.  The positions of an
n-gram, AND-ed, give at once all languages whose filter contains it.  A text's n-grams are looked up, the hits of
each language counted (popcounts), corrected for the false positives that the language's filling of the filter
predicts, and the largest corrected rate decides.

Training is on a bounded sample of labelled rows: about ``docs_per_language`` whole texts a language, chosen by a hash
of the text, all of them where a language has fewer.  Prediction covers every row and reads the text alone.

Defined cases: null text or one without a letter: ``und`` with score 0; letters but no known n-gram: the commonest
label with score 0; no labelled row: ``und``; equal rates: the first language in name order; repeated rows are predicted each;
an empty table gives an empty table; columns named like the outputs are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, released

#: Bound of the training sample for each language.
DOCS_PER_LANGUAGE = 3000
N = 4
TABLE = 1 << 20
HASHES = 3
#: An n-gram belongs to a language if seen this often there, at this part at least of its rate in its best language.
LEAST_COUNT, LEAST_RATE = 3, 0.25

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str | None) -> np.ndarray:
    """Hashes of the character n-grams of a text's letters; runs of all else are one blank. Empty without a letter."""
    if not text:
        return np.empty(0, np.uint64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, np.uint64)
    code = np.where(letter, code, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = code[keep].astype(np.uint64)
    blank = np.full(N - 1, 32, np.uint64)
    code = np.concatenate([blank[:1], code[1:] if code[0] == 32 else code, blank[: max(1, N - 1 - len(code))]])
    h = np.zeros(len(code) - N + 1, np.uint64)
    for i in range(N):
        h = h * _A + code[i : len(code) - N + 1 + i]
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def positions(h: np.ndarray) -> list[np.ndarray]:
    """The table positions of each n-gram."""
    mask = np.uint64(TABLE - 1)
    return [((h >> np.uint64(20 * k)) & mask).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filter:
    """languages; table: a row of bitmask bytes for each position; noise: false-positive rate of each language."""

    languages: list[str]
    table: np.ndarray
    noise: np.ndarray
    common: int

    def rates(self, text: str | None) -> tuple[int, np.ndarray]:
        """n-grams of the text, and each language's corrected share of them."""
        h = grams(text)
        if not len(h) or not self.languages:
            return len(h), np.zeros(len(self.languages))
        at, found = positions(h), np.zeros(len(self.languages))
        for w in range(self.table.shape[1]):
            column = self.table[:, w]
            hit = column[at[0]]
            for p in at[1:]:
                hit = hit & column[p]
            bits = (np.bincount(hit, minlength=256) @ ((np.arange(256)[:, None] >> np.arange(8)) & 1))[: len(found) - 8 * w]
            found[8 * w : 8 * w + len(bits)] = bits
        return len(h), np.clip((found / len(h) - self.noise) / (1 - self.noise), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        n, rate = self.rates(text)
        if not n or not self.languages:
            return "und", 0.0
        best = int(rate.argmax())
        return (self.languages[best], float(rate[best])) if rate[best] > 0 else (self.languages[self.common], 0.0)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Filter:
    """Learn from the rows whose label and text are not null."""
    rows = labelled.where(col(label).isNotNull() & col(text).isNotNull()).select(col(label).alias("label"), col(text).alias("text"))
    sizes = dict(rows.groupBy("label").count().collect())
    languages = sorted(sizes)
    if not languages:
        return Filter([], np.zeros((TABLE, 1), np.uint8), np.zeros(0), 0)
    index = {x: i for i, x in enumerate(languages)}
    share = F.create_map(*(F.lit(v) for x in languages for v in (x, docs_per_language / sizes[x])))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(share, F.col("label")) * float(1 << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, t in zip(batch["label"], batch["text"], strict=True):
                seen.setdefault(lang, []).append(grams(t))
            for lang, parts in seen.items():
                if parts:
                    g, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pd.DataFrame({"gram": g.view(np.int64), "lang": np.int32(index[lang]), "n": n})
            seen.clear()

    counts = sample.mapInPandas(count, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    total = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    size = F.create_map(*(F.lit(v) for i in range(len(languages)) for v in (i, float(total.get(i, 1)))))
    by_gram = counts.withColumn("rate", F.col("n") / F.element_at(size, F.col("lang"))).groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "n", "rate")).alias("in"))
    of = F.filter("in", lambda x: (x["n"] >= LEAST_COUNT) & (x["rate"] >= LEAST_RATE * F.col("most")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            g = batch["gram"].to_numpy().view(np.uint64)
            for p in positions(g):
                yield pd.DataFrame({"at": p, "lang": batch["lang"].to_numpy()})

    placed = by_gram.select("gram", F.explode(of).alias("x")).select("gram", "x.lang").mapInPandas(place, "at long, lang int").distinct()
    bits = placed.groupBy("at", F.floor(F.col("lang") / 8).cast("int").alias("w")).agg(F.sum(F.expr("shiftleft(1, pmod(lang, 8))")).alias("bits")).toPandas()  # TABLE rows at most, for every 8 languages
    table = np.zeros((TABLE, (len(languages) + 7) // 8), np.uint8)
    table[bits["at"].to_numpy(np.int64), bits["w"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    filled = np.array([((table[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
    return Filter(languages, table, filled**HASHES, index[max(languages, key=lambda x: (sizes[x], x))])


def predict(df: DataFrame, model: Filter, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its corrected hit rate."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = held.value.predict
        yield from released(pd.DataFrame([predict(t) for t in texts], columns=["pred", "score"]) for texts in batches)

    kept = [c for c in df.columns if c not in (out, score)]
    return df.select(*map(col, kept), tell(col(text)).alias("__told")).select(*map(col, kept), F.col("__told.pred").alias(out), F.col("__told.score").alias(score))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that are not held out."""
    fold = held_out(F.col("doc_id"))
    model = fit(docs.where(~fold).select("text", "lang"))
    return predict(docs.select("doc_id", fold.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
