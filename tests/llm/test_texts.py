"""Licences, lines, mixing and the Jaccard join against brute force and SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import graph, jaccard, licenses, lines, mixing
from larder.llm.common import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"][0]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE")),
        (2, "prose\nreleased under the MIT licence!\nmore"),
        (3, None),
        (4, ""),
        (5, "... --- ..."),
        (6, "Released under the MIT License. And so on."),
        (2, "prose\nreleased under the MIT licence!\nmore"),
        (7, "All rights reserved."),
    ]
    got = licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license int")).collect()
    assert sorted((r["doc_id"], r["line_no"], r["license"]) for r in got if r["line_no"] is None) == [(1, None, "MIT"), (7, None, "All-Rights-Reserved")]
    assert [(r["doc_id"], r["line_no"], r["license"]) for r in got if r["line_no"] is not None] == [(2, 1, "MIT")] * 2
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    own = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"prose": ["Prose"]}).collect()
    assert {(r["doc_id"], r["line_no"]) for r in own} == {(2, 0)}


def test_license_scan_equals_the_full_form(spark):
    """The opening words rule out nothing that the full canonical form would match."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    known = {}
    texts = spark.createDataFrame([(n, t) for n, ts in sorted(licenses.KNOWN.items()) for t in ts], "n string, t string")
    for r in texts.select("n", licenses.canonical(F.col("t")).alias("c")).collect():
        known.setdefault(r["c"], r["n"])
    units = docs.select("doc_id", F.lit(None).cast("int").alias("line_no"), F.col("text").alias("u")).unionByName(docs.where(F.contains("text", F.lit("\n"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "u")))
    want = sorted((r["doc_id"], r["line_no"] if r["line_no"] is not None else -1, known[r["c"]]) for r in units.select("doc_id", "line_no", licenses.canonical(F.col("u")).alias("c")).collect() if r["c"] in known)
    assert sorted((r["doc_id"], r["line_no"] if r["line_no"] is not None else -1, r["license"]) for r in licenses.scan(docs).collect()) == want and want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_similarity():
    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 25)))
        b = "".join(c for c in a if rng.random() > 0.1) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 3)))
        assert lines.similar(a, b, 80) == (distance(a, b) <= max(len(a), len(b)) * 20 // 100)


def test_edit_similarity_of_many_pairs(monkeypatch):
    rng = random.Random(7)
    one, two = ["", "", "a", "ab" * 900], ["", "a", "", "ba" * 900]
    for letters in ("ab", "abcdefgh ", "aé語ß \U0001f600"):
        for n in (1, 2, 5, 30, 63, 64, 65, 127, 128, 129, 200):
            for _ in range(6):
                a = "".join(rng.choice(letters) for _ in range(n))
                b = "".join(rng.choice([c, c, c, c, c, "", c + rng.choice(letters), rng.choice(letters)]) for c in a)
                one, two = one + [a], two + [b]
    for percent in (60, 80, 95):
        plain = [distance(a, b) <= max(len(a), len(b)) * (100 - percent) // 100 for a, b in zip(one, two)]
        assert lines.similar_pairs(one, two, percent).tolist() == plain
        assert lines.similar_pairs(two, one, percent).tolist() == plain
    monkeypatch.setattr(lines, "TABLE", 0)
    assert lines.similar_pairs(one, two, 95).tolist() == plain
    assert lines.similar_pairs([], [], 80).tolist() == []


def test_minhashes_of_pieces_equal_those_of_the_whole(monkeypatch):
    forms = [b"a" * 300, b"bcde" * 50, b"xx yy zz aa bb", b"word " * 2000, b"some more words"]
    whole = lines.minhashes(forms, 6)
    monkeypatch.setattr(lines, "CACHED", 100)
    assert (lines.minhashes(forms, 6) == whole).all()


def brute_lines(docs):
    """The places that line dedup leaves out, by comparing all pairs of lines by edit similarity alone."""
    seen = {}
    for doc, text in sorted((d, t) for d, t in docs if d is not None and t is not None):
        for i, form in enumerate(lines.normal_forms(text)):
            if form:
                seen.setdefault(form, []).append((doc, i))
    forms = sorted(seen)
    up = list(range(len(forms)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(forms)):
        for j in range(i):
            if min(len(forms[i]), len(forms[j])) >= lines.FUZZY_BYTES and lines.similar(forms[i].decode(), forms[j].decode(), lines.PERCENT):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, f in enumerate(forms):
        groups.setdefault(root(i), []).extend(seen[f])
    return {p for g in groups.values() for p in set(g) - {min(g)}}


def left(docs, gone):
    return {d: "\n".join(line for i, line in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs if d is not None and t is not None}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 6, 40]))) for _ in range(30)]
    docs = []
    for d in range(60):
        own = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(base).split(" ")
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = word()
            own.append(" ".join(words).capitalize() + rng.choice(["", ".", "!"]))
        docs.append((d, "\n".join(own)))
    df = spark.createDataFrame([*docs, (None, base[0]), (900, None), (901, "")], "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("line", F.lit("kept"))
    got = lines.dedup(df).collect()
    want = brute_lines(docs)
    dropped = sum(r["n_dropped"] for r in got)
    assert 0.95 * len(want) <= dropped <= len(want) and {r["line"] for r in got} == {"kept"}
    texts, full = {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None and r["doc_id"] < 900}, left(docs, want)
    assert sum(texts[d] == full[d] for d in full) >= 0.95 * len(full) and all(r["n_lines"] - r["n_dropped"] == (len(r["text"].split("\n")) if r["n_dropped"] < r["n_lines"] else 0) for r in got if r["text"] is not None and r["doc_id"] is not None)
    assert {(r["doc_id"], r["text"]) for r in got if r["doc_id"] is None or r["doc_id"] >= 900} == {(None, base[0]), (900, None), (901, "")}
    assert lines.dedup(df.limit(0)).count() == 0
    twice = lines.dedup(df.unionByName(df)).where("doc_id is not null and doc_id < 900").select("doc_id", "text").distinct().collect()
    assert len(twice) == 60


def test_line_dedup_of_a_long_log_is_linear(spark):
    log = "\n".join(f"entry {i % 7} of the same old service log" for i in range(40_000))
    got = {r["doc_id"]: r for r in lines.dedup(spark.createDataFrame([(1, log), (2, "x" * 300_000 + "\nentry")], "doc_id long, text string")).collect()}
    assert got[1]["n_lines"] == 40_000 and got[1]["n_dropped"] == 39_999 and got[2]["n_dropped"] == 0


def test_lines_whose_first_64_bits_agree_are_told_apart(spark, monkeypatch):
    rows = [(1, "the first line of some length here"), (2, "a quite different one that stays"), (3, "the first line of some length here")]
    whole = lines._occurrences

    def same_start(batches):
        import pyarrow as pa

        for batch in whole(batches):
            yield batch.set_column(2, "id", pa.array([5] * batch.num_rows, pa.int64()))

    monkeypatch.setattr(lines, "_occurrences", same_start)
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["id"]: r["label"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in pairs if a != b for x in (a, b) for _ in [0]} | {k: v for k, v in got.items() if k == v}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_jaccard(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_join_equals_brute_force(spark, n, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rng = random.Random(n * percent)
    common = ["the", "of", "and", "to", "Zu", "ß"]
    rows = []
    for g in range(40):
        base = [rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 2, 5, 12, 40, 130, 300]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(["new", "the", f"w{rng.randrange(60)}"])
            rows.append((len(rows), rng.choice([" ", "\n", "\t\x0b"]).join(words)))
    rows += [(len(rows), None), (len(rows) + 1, " \n"), (len(rows) + 2, "A b"), (len(rows) + 3, "a B"), (len(rows) + 4, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(df, n, percent).collect()}
    assert got == brute_jaccard(rows, n, percent)


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (0, "A  B c d")], "doc_id long, text string")
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in jaccard.components(df, 3, 90).select("doc_id", "n_shingles", "component_id").collect())
    assert got == [(-1, 2, None), (0, 2, 0), (1, 2, 0), (1, 2, 0)]
    assert jaccard.components(df.limit(0), 3, 90).count() == 0
    assert sorted((r[0] is None, r[0]) for r in jaccard.keep_one(df, 3, 90).collect()) == [(False, 0), (True, None)]


def test_mixture_equals_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    told = c.execute(mixing.SQL)
    names = [x[0] for x in told.description]
    want = sorted(tuple(r[names.index(k)] for k in sorted(names)) for r in told.fetchall())
    assert sorted(tuple(r[k] for k in sorted(names)) for r in mixing.mixed_documents(docs).collect()) == want


def test_mixture_budgets_and_edges(spark):
    rows = [(i, "big" if i % 3 else "small", "w " * (1 + i % 5)) for i in range(300)] + [(None, None, "x y"), (5, "big", None), (5, "big", None), (7, "small", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("epoch", F.lit("clash"))
    out = mixing.mix(df, most_repeats=2.0, cover=True)
    counts = {(r["doc_id"], r["source"], r["text"]): r["n"] for r in out.groupBy("doc_id", "source", "text").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {(d, s, t) for d, s, t in rows} and max(v for k, v in counts.items() if k[1] == "small") <= 3
    even = mixing.mix(df, entropy_part=1.0)
    tokens = {r["source"]: r["t"] for r in even.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    budget = sum(len((t or "").split()) for _, _, t in rows) / 3
    assert all(budget - 5 <= tokens[s] <= budget for s in ("big", "small")) and math.isclose(tokens[None], budget, abs_tol=2)
    assert even.where("epoch > 0").count() > 0 and mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text = ''")).count() == 1


def test_mixing_runs_no_python(spark, sf):
    plan = mixing.mixed_documents(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
