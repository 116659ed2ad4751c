"""Phrase collocations against brute force, and the automata's parts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from larder.llm import phrases
from larder.llm.common import ship

BREAK = re.compile("[.,;:!?\x0a-\x0d]")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(table):
    counts = defaultdict(Counter)
    for lang, text in table:
        for piece in BREAK.split(lowered(text or "")):
            words = re.findall("[^ \t]+", piece)
            for n in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return counts


def brute(table, least, top):
    out = []
    for lang, f in counted(table).items():
        total = sum(a for p, a in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        around[p[i:j]] = max(around[p[i:j]], a)
        rows = []
        for p, a in candidates.items():
            if 100 * around[p] < 80 * a:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, r, total, -s) for i, (s, a, p, x, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(rng, n):
    words = ["the", "The", "of", "é", "É", "a", "b", "new", "york", "city", "hall", "x y", "\x00", "-"]
    out = []
    for _ in range(n):
        parts = [rng.choice([*words, "new york city hall", "the end of"]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\v"]) for _ in range(rng.randrange(40))]
        out.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), "".join(parts)))
    return [*out, ("en", None), ("fr", ""), (None, None), ("en", "..."), ("en", "new york city hall " * 3000)]


@pytest.mark.parametrize(("run", "span"), [(24 << 20, 4 << 20), (2000, 600)])
def test_against_brute_force(spark, monkeypatch, run, span):
    ship(spark)
    monkeypatch.setattr(phrases, "RUN_BYTES", run)
    monkeypatch.setattr(phrases, "RANGE_BYTES", span)
    table = texts(random.Random(1), 300)
    df = spark.createDataFrame([(*x, 0) for x in table], "lang string, text string, rank int").repartition(3)
    want = brute(table, 5, 40)
    assert got(df, least=5, top=40) == want and len(want) > 60


def test_documents(spark, sf):
    ship(spark)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r["lang"], r["text"]) for r in df.select("lang", "text").collect()], 30, 2000)
    assert got(df) == want and len(want) > 20


def test_empty(spark):
    ship(spark)
    assert got(spark.createDataFrame([], "lang string, text string")) == []


def test_automata_keep_every_count():
    rng = random.Random(2)
    data = [lowered(t or "").encode() for _, t in texts(rng, 60)]
    f = Counter()
    for x in counted([("x", d.decode()) for d in data]).values():
        f.update(x)
    blobs = [phrases.pack(phrases.layers_of_text(d)[0]) for d in data]
    union, words = phrases.united(blobs)
    want = {tuple(w.encode() for w in p): a for p, a in f.items()}
    assert dict(union.phrases()) == want and words == sum(a for p, a in want.items() if len(p) == 1)
    assert dict(phrases.united(blobs, 4)[0].phrases()) == {p: a for p, a in want.items() if a >= 4}
    # cut at borders and united again, every phrase is in one part
    layers, begins, following = phrases.layers_of_text(b"\n".join(data))
    for borders in ([], [(b"new", b"york", b"", b"")], [(b"a", b"", b"", b""), (b"new", b"york", b"city", b"hall"), (b"new", b"york", b"zz", b""), (b"zz", b"", b"", b"")]):
        ends = [[0] * 4, *phrases.cuts(layers, begins, following, borders), [len(x) for x in layers.label]]
        parts = [{p: a for p, a in phrases.united([phrases.pack(layers.spans(a, b))])[0].phrases() if a} for a, b in zip(ends, ends[1:], strict=False)]
        assert sum(map(len, parts)) == len(want) and {p: a for x in parts for p, a in x.items()} == want
        padded = lambda p: (*p, *[b""] * (4 - len(p)))
        for k, part in enumerate(parts):
            assert all((k == 0 or padded(p) >= borders[k - 1]) and (k == len(borders) or padded(p) < borders[k]) for p in part)


def test_composition():
    counts, _ = phrases.united([phrases.pack(phrases.layers_of_text(b"a b, a b, a b, a, a, c a b, c a b")[0])])
    asked = [b"c a b", b"a z", b"b", b"a b", b"c a", b"zz", b"a b"]
    layers, length, place = phrases.layers_of_phrases(pa.array(asked, pa.binary()))
    there = phrases.composed(counts, layers)
    told = [int(counts.weight[n - 1][there[n - 1][p]]) if there[n - 1][p] >= 0 else None for n, p in zip(length.tolist(), place.tolist(), strict=True)]
    assert told == [2, None, 5, 5, 2, None, 5]


def test_long_texts_are_cut_where_pieces_end():
    data = b"aa bb. cc dd, ee ff gg hh ii jj kk! ll"
    parts = list(phrases.segments(data, 10))
    assert parts == [b"aa bb", b" cc dd", b" ee ff gg hh ii jj kk", b" ll"]
