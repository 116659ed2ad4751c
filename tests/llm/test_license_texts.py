"""Full licence texts, also wrapped and inside longer documents."""

import re
import textwrap

from larder.llm import licenses
from larder.llm.common import ship


def wrapped(text, width=70, apart="\n\n"):
    return apart.join("\n".join(textwrap.wrap(p, width, break_on_hyphens=False)) for p in text.split("\n"))


def test_texts_in_full_and_inside_documents(spark):
    ship(spark)
    names = ["BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "Apache-2.0", "MIT", "GPL-3.0"]
    rows = []
    for i, name in enumerate(names):
        text = wrapped(licenses.KNOWN[name][0])
        rows += [(2 * i, "Copyright 2020 Someone\n\n" + text), (2 * i + 1, "Some code\n\nCopyright 2020 Someone\n" + text + "\n\nimport this\n")]
    got = {(r["doc_id"], r["line_no"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2 * i, None, n) for i, n in enumerate(names)} | {(2 * i + 1, 3, n) for i, n in enumerate(names)}


def test_every_file_between_paragraphs_however_wrapped(spark):
    """Each whole text is found as it stands, and wrapped otherwise, with other blank lines, in a document."""
    ship(spark)
    rows, want = [], set()
    for i, (file, name) in enumerate(sorted(licenses.FILES.items())):
        text = next(t for t in licenses.KNOWN[name] if len(t) > 3000)
        plain = text.strip("\n")
        # other blank lines; and the lines of a paragraph on one line, unless one of them counts as a copyright line
        blocks = [b if re.search(f"(?m){licenses._COPYRIGHT_LINE}", b.lower()) else " ".join(re.split(r"[ \t\r\n]+", b)) for b in re.split(r"\n[ \t\r]*\n", plain)]
        for k, inner in enumerate((plain, "\n \n\t\n".join(blocks).strip("\n"))):
            rows.append((10 * i + k, f"First a paragraph.\n\n{inner}\n\nThen another one.\nAnd more.\n"))
            want.add((10 * i + k, 2, name))
        rows.append((10 * i + 5, text))
        want.add((10 * i + 5, None, name))
        rows.append((10 * i + 6, f"First.\n\n{text[: len(text) // 2]}\n\nThen another one."))  # half a text is none
    got = {(r["doc_id"], r["line_no"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missing = want - got
    assert not missing
    assert not {x for x in got if x[0] % 10 == 6 and x[1] == 2}


def test_words_of_a_line_are_those_of_the_canonical_form(spark):
    lines = ["Non-commercial noncommercial use, licence!", "(c) 2020 me", "Copyright 2020", "copyrighted WORK", " ", "a\u2014b \u201cc\u201d", "İstanbul ß"]
    told = spark.createDataFrame([(x,) for x in lines], "t string").select("t", licenses.canonical("t").alias("c")).collect()
    for r in told:
        assert licenses.words_in_line(r["t"]) == len(r["c"].split(" ") if r["c"] else []), r
