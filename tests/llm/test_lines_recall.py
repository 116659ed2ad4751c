"""Recall of line dedup against brute force by edit similarity alone."""

import random

import pytest

from larder.llm import graph, lines
from larder.llm.common import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def pairs(rng, count, low, high, part):
    """Lines of low to high words, each with a copy that has some words replaced and is similar by brute force."""
    word = lambda: "".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9)))
    out = []
    while len(out) < count:
        words = [word() for _ in range(rng.randint(low, high))]
        copy = list(words)
        for _ in range(max(1, round(rng.uniform(0, part) * len(words)))):
            copy[rng.randrange(len(copy))] = word()
        x, y = " ".join(words), " ".join(copy)
        if x != y and lines.similar(x, y, lines.PERCENT):
            out.append((x, y))
    return out


@pytest.mark.parametrize("low,high,part", [(5, 14, 0.0), (15, 29, 0.0), (5, 14, 0.2), (15, 29, 0.2), (30, 80, 0.2)])
def test_recall_of_similar_lines(spark, low, high, part):
    made = pairs(random.Random(low), 300, low, high, part)
    rows = [(2 * i + k, line) for i, pair in enumerate(made) for k, line in enumerate(pair)]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] for i in range(300)) >= 0.9 * 300 and not any(got[2 * i] for i in range(300))


def test_every_line_takes_part(spark):
    chinese = "这是一个没有空格的段落，用来检查整行的重复是否会被删除。"
    rows = [(1, f"Page one\n\n---\n{chinese}\n目录\nkept a"), (2, f"page ONE.\n\n---\n{chinese}\n目录\n***\nkept b"), (3, " 　\n\t"), (4, " 　\n\t"), (5, None)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n***\nkept b", 4), 3: (rows[2][1], 0), 4: (rows[3][1], 0), 5: (None, 0)}


def test_large_buckets_lose_no_link(spark, monkeypatch):
    whole, seen = graph.link_buckets, []
    linked = [(1, 50), (2, 60), (50, 60)]  # 1 and 2, the least lines of two components of the bucket, are not similar; 50 and 60 are
    rows = [(1, i, 0) for i in range(100)] + [(2, 1, 0), (2, 50, 0), (3, 2, 0), (3, 60, 0)]

    def made(keys, sizes, verify, *rest):
        alike = spark.createDataFrame(linked, "a long, b long")
        found = whole(spark.createDataFrame(rows, "key long, id long, rest long"), sizes, lambda pairs: lines.written(pairs.join(alike, ["a", "b"]), "alike"), *rest)
        seen.extend(found.where("label != id").collect())
        return found

    monkeypatch.setattr(lines.graph, "link_buckets", made)
    for rounds in (lines.__dict__.get("ROUNDS"), 0):
        monkeypatch.setattr(lines, "ROUNDS", rounds, raising=False)
        seen.clear()
        lines.dedup(spark.createDataFrame([(1, "a line of some words")], "doc_id long, text string"))
        assert {(r["id"], r["label"]) for r in seen} == {(2, 1), (50, 1), (60, 1)}


def test_lengths_in_codes_lose_no_pair():
    sizes = lines.np.arange(1, 5000)
    code = lines.codes(lines.np.zeros((lines.MINHASHES, len(sizes)), lines.np.uint32), sizes)
    for i in range(0, len(sizes), 7):
        fit = 100 * sizes[: i + 1] >= lines.PERCENT * sizes[i]
        apart = lines.np.bitwise_count((code[: i + 1] ^ code[i]).view(lines.np.uint64) >> lines.np.uint64(60))
        assert (apart[fit] <= 1).all()


def test_edit_similarity_of_long_pairs_within_bands():
    rng, one, two = random.Random(9), [], []
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(60, 700))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 3)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        if rng.random() < 0.3:
            cut = rng.randint(0, len(b) // 5)
            b = b[cut:] + ["c"] * rng.randint(0, cut)
        one.append("".join(a))
        two.append("".join(b))
    for percent in (60, 80, 95):
        assert lines.similar_pairs(one, two, percent).tolist() == [lines.similar(a, b, percent) for a, b in zip(one, two, strict=True)]


def test_pairs_of_many_words_advance_together(monkeypatch):
    """Pairs of more than 2,048 characters, and few pairs of several words, were compared one by one."""
    rng, one, two = random.Random(13), [], []
    for low, high, count in ((2100, 3900, 40), (400, 700, 30), (30, 260, 60)):
        for _ in range(count):
            a = [rng.choice("abcdefgh ") for _ in range(rng.randint(low, high))]
            part = rng.uniform(0, 0.3)
            b = [rng.choice(["", "a", "xy"]) if rng.random() < part else c for c in a]
            if rng.random() < 0.4:  # a shared passage at another place
                cut = len(b) // 12
                b = ["z"] * rng.randint(0, cut) + b[rng.randint(0, cut) :]
            one.append("q" + "".join(a) + "r")
            two.append("s" + "".join(b) + "t")
    plain = {p: [lines.similar(a, b, p) for a, b in zip(one, two, strict=True)] for p in (60, 80, 90)}
    monkeypatch.setattr(lines, "FILLED", lines.np.array([1, 2, 4, 8, 16, 32, 64]))  # classes of several pairs
    monkeypatch.setattr(lines, "distance_bound", lambda a, b: 1 << 30)
    alone, whole = [], lines.similar
    monkeypatch.setattr(lines, "similar", lambda a, b, p: alone.append(len(a)) or whole(a, b, p))
    for percent in (60, 80, 90):
        alone.clear()
        assert lines.similar_pairs(one, two, percent).tolist() == plain[percent] and 0 < sum(plain[percent]) < len(one)
        assert not [n for n in alone if n > 2048]


def test_one_pair_within_a_band(monkeypatch):
    """Whatever the columns chosen at a time, the distance of one pair is that of the whole matrix where it is allowed."""
    rng = random.Random(11)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            last, row = row, [i + 1]
            for j, d in enumerate(b):
                row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    monkeypatch.setattr(lines, "distance_bound", lambda a, b: 1 << 30)  # no pair is told before its matrix
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        b = "".join(c if rng.random() < 0.8 else rng.choice(["", "a", "xy"]) for c in a)
        for cut in (b, b[rng.randint(0, 9) :] + "c" * rng.randint(0, 9)):
            far, most = distance(a, cut), max(len(a), len(cut))
            for lines_band in (1, 7, 64):
                monkeypatch.setattr(lines, "BAND", lines_band)
                assert [lines.similar(a, cut, p) for p in (50, 80, 95)] == [far <= most * (100 - p) // 100 for p in (50, 80, 95)]


def test_rounds_read_few_forms_and_groups_few_rows(spark, monkeypatch):
    """Each round read the forms of all lines through a shuffle, and all lines went through the shuffles of the groups."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshrdlucm") for _ in range(7))
    own = [" ".join(word() for _ in range(9)) for _ in range(60)]
    near = [" ".join([word(), *x.split()[1:]]) for x in own[:5]]
    rows = [(i, x) for i, x in enumerate(own)] + [(100 + i, x) for i, x in enumerate(near)] + [(200 + i, x) for i, x in enumerate(own[10:13])]
    counts = {}

    def written(df, what, **options):
        out = common_written(df, what, **options)
        counts.setdefault(what, out.count())
        return out

    common_written = lines.written
    monkeypatch.setattr(lines, "written", written)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.dedup(spark.createDataFrame([*rows, (300, None), (301, ""), (302, "\n\n")], "doc_id long, text string")).collect()}
    assert counts["distinct-lines"] == 65 and counts["bucketed-forms"] <= 12 and counts["grouped"] == 13
    assert got == {i: (1, int(i >= 100)) for i, _ in rows} | {300: (0, 0), 301: (1, 0), 302: (3, 0)}


def test_large_buckets_are_compared_in_cells(spark, monkeypatch):
    """Pairs of large buckets are compared where their rows meet: no row for a pair, and none for a pair of components, comes out."""
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(100)]
    texts += [" ".join(["other", *t.split()[1:]]) for t in texts[:30]]
    forms = [t.encode() for t in texts]
    lines_like = {(i, j) for i in range(130) for j in range(i + 1, 130) if lines.similar(texts[i], texts[j], lines.PERCENT)}
    code = lines.codes(lines.np.zeros((lines.MINHASHES, 130), lines.np.uint32), lines.np.array(list(map(len, texts)))).tolist()
    # two keys share all rows: a pair is compared once; rows 0 and 100 are in one component; row 50 has no form
    rows = [(key, i, code[i], 0 if i in (0, 100) else i, None if i == 50 else forms[i], [7, 9], len(texts[i])) for key in (7, 9) for i in range(130)]
    table = spark.createDataFrame(rows, "key long, id long, code long, label long, form binary, keys array<long>, size long")
    for most in (1000, 40, 1):
        dealt = graph.cells(table, most, 1 << 20)
        cell = dealt.groupBy("key", "cell").agg(lines.F.collect_list(lines.F.struct("side", "id", "code", "label", "form", "keys")).alias("rows")).select("key", "rows")
        got = [(r["a"], r["b"]) for r in cell.mapInArrow(lines._linked, "a long, b long").collect()]
        assert len(got) == len(set(got))
        assert {p for p in got if 50 not in p} == {p for p in lines_like if 50 not in p} - {(0, 100)}
        assert {(min(i, 50), max(i, 50)) for i in range(130) if i != 50 and lines.similar(texts[i], texts[50], lines.PERCENT)} <= set(got)


def test_links_of_near_copies_in_a_cell_are_no_more_than_their_labels():
    text = "a line of several words of which each copy has another number of letters at the end "
    rows = [{"side": 2, "id": i, "code": 0, "label": i, "form": (text + "x" * (i % 9) + chr(97 + i // 9)).encode(), "keys": [7]} for i in range(60)]
    got = [p for b in lines._linked(iter(lines.pa.table({"key": lines.pa.array([7]), "rows": [rows]}).to_batches())) for p in zip(*b.to_pydict().values())]
    assert len(got) == 59 and {x for p in got for x in p} == set(range(60))


def test_merged_components_equal_those_of_all_links(spark):
    rng = random.Random(5)
    some, more = ([(rng.randrange(200), rng.randrange(200)) for _ in range(60)] for _ in range(2))
    table = lambda pairs: lines.written(spark.createDataFrame(pairs, "a long, b long").where("a != b"), "links")
    found = lines.written(graph.components(table(some)), "labels")
    got = {r["id"]: r["label"] for r in graph.merged(found, table(more)).collect()}
    assert got == {r["id"]: r["label"] for r in graph.components(table(some + more)).collect()}


def test_letters_bound_distances_from_below():
    rng = random.Random(6)
    one = ["".join(rng.choice("abcdeé目") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    two = [x[3:] + "ab" if rng.random() < 0.5 else "".join(rng.choice("abcdeé目") for _ in range(rng.randint(0, 40))) for x in one]
    for least, a, b in zip(lines.letters_apart(one, two).tolist(), one, two, strict=True):
        most = max(len(a), len(b))
        assert least == 0 or not lines.similar(a, b, 100 - (100 * (least - 1)) // max(1, most))
    assert lines.similar_pairs(one, two, 80).tolist() == [lines.similar(a, b, 80) for a, b in zip(one, two, strict=True)]
