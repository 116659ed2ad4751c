"""Embedding links against brute force, archives and media by exact round trips, the pipeline on a small corpus."""

import base64
import hashlib
import importlib.util
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import isomedia, vectors, warc
from larder.llm.common import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def brute_links(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (links[i], root(i)) for i, _ in rows}


def corpus(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, n, 3):  # near copies, some just above the threshold
        x[i] = x[i // 2] + rng.standard_normal(dim) * np.linalg.norm(x[i // 2]) / np.sqrt(dim) * rng.choice([0.1, 0.3, 0.42])
    return [(int(i), v.tolist()) for i, v in enumerate(x)]


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 64)
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "TILE", 32)
    rows = corpus(900, 32, 1)
    want = brute_links(rows)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert vectors.plan(900, 0.9)[0] == 3 and vectors.plan(900, 0.9)[1] > 3
    found, there = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
    assert there > 500 and 0.95 * there <= found <= there
    assert all(r["n_links"] <= want[i][0] for i, r in got.items()) and all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_vectors_about_a_far_centre(spark, monkeypatch):
    """Cells of a narrow cone part near pairs more often; the spread that is measured makes up for it."""
    monkeypatch.setattr(vectors, "CELL", 64)
    rows = [(i, (np.array(v) * 0.5 + 1.0).tolist()) for i, v in corpus(600, 32, 3)]
    want = brute_links(rows, 0.99)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.99).collect()}
    found, there = sum(got.values()), sum(n for n, _ in want.values())
    assert there > 100 and 0.9 * there <= found <= there


def test_growth_of_trees():
    """Work, as vectors times trees times the size of a cell, grows with about the 1.25th power."""
    work = lambda n: n * vectors.plan(n, 0.9)[1] * (n >> vectors.plan(n, 0.9)[0])
    assert work(1 << 32) / work(1 << 22) <= (1 << 10) ** 1.3


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (12, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    want = {i: (0, i) for i, _ in rows} | {1: (3, 1), 2: (3, 1), 3: (3, 1), 12: (3, 1)}
    assert got == want
    twice = vectors.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in twice) == [(0, 0, False), (1, 1, True), (1, 1, True)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0


PAGES = [(1, "http://a", "<p>x"), (2, "http://b", "<p>x"), (9, "http://c\r\nX: y", "<p>x"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é" * 10_000), (9, "http://c\r\nX: y", "<p>x"), (None, "http://f", "<p>x"), (None, "http://g", "only")]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    warc.write_archive(pages, str(tmp_path / "a"))
    assert warc.read_payloads(spark, str(tmp_path / "a")).count() == len({h or "" for _, _, h in PAGES})
    records = warc.reconstruct(spark, str(tmp_path / "a")).collect()
    assert len(records) == len(PAGES)
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = block[:-4]
        http, _, payload = block.partition(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(block) and bytes(r["record"]).endswith(b"\r\n\r\n")
        if r["record_type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            assert payload == b"" and "WARC-Refers-To" in fields
    ids = [f.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for f in (bytes(r["record"]) for r in records)]
    assert len(set(ids)) == len(ids)


def test_archived_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(PAGES)
    html = {i: (h or "").encode() for i, _, h in PAGES if i is not None}
    for r in got:
        if r["page_id"] is not None:
            data = html[r["page_id"]]
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got)
    assert kinds == [(0, "response", 0), (0, "revisit", 9), (1, "revisit", 9), (2, "revisit", 9), (3, "revisit", 4), (4, "response", 0), (5, "response", 0), (9, "response", 0), (9, "revisit", 9)]
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_altered_payloads_are_noticed(spark, tmp_path):
    warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(tmp_path / "a"))
    bad = warc.read_payloads(spark, str(tmp_path / "a")).select("sha256", F.lit(b"other").alias("payload"))
    bad.write.parquet(str(tmp_path / "b" / "payloads"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_payloads(spark, str(tmp_path / "b")).collect()


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 64, 576 * 64 + 1, 576 * 1000])
def test_media_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    file = isomedia.pack(isomedia.pad(data))
    (track,) = isomedia.tracks(file)
    cut = b"".join(file[c["at"] : c["at"] + c["bytes"]] for c in track["chunks"])
    assert cut == isomedia.pad(data) and cut[:n] == data
    assert (track["codec"], track["handler"], track["timescale"]) == ("raw ", "soun", 8000) and track["duration"] == len(cut) == 576 * track["n_samples"]
    first = track["keyframes"][0]
    assert file[first["at"] : first["at"] + first["bytes"]] == cut[:576] and len(track["keyframes"]) == -(-track["n_samples"] // isomedia.SYNC)


def test_foreign_boxes_and_broken_files(spark):
    box, full = isomedia._box, isomedia._full
    # 64-bit sizes, co64, varying sample sizes, no sync table, version 1 clocks
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", b"\0" * 8)), full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 5)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">IIIII", 0, 3, 4, 5, 6)), full(b"co64", struct.pack(">IQQ", 2, 1000, 2000)))
    mdia = box(b"mdia", box(b"mdhd", b"\1\0\0\0" + struct.pack(">QQIQ", 0, 0, 600, 25) + b"\0" * 4), full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 12), box(b"minf", stbl))
    trak = box(b"trak", box(b"tkhd", b"\1\0\0\0" + struct.pack(">QQI", 0, 0, 9)), mdia)
    moov = struct.pack(">I4sQ", 1, b"moov", 16 + len(trak)) + trak
    (track,) = isomedia.tracks(moov + struct.pack(">I4s", 0, b"mdat") + b"\0" * 3000)
    assert track["track_id"] == 9 and track["timescale"] == 600 and track["duration"] == 25 and track["codec"] == "avc1"
    assert track["keyframes"] == [{"at": 1000, "bytes": 4}, {"at": 1004, "bytes": 5}, {"at": 2000, "bytes": 6}] and track["chunks"] == [{"at": 1000, "bytes": 9}, {"at": 2000, "bytes": 6}]
    whole = isomedia.pack(isomedia.pad(b"x" * 2000))
    rows = [(0, whole), (1, None), (2, b""), (3, b"not a box at all"), (4, whole[:300]), (5, whole[:-700]), (6, box(b"moov", box(b"trak")))]
    out = {r["id"]: r for r in isomedia.with_index(spark.createDataFrame(rows, "id int, media binary").withColumn("error", F.lit(1))).collect()}
    assert out[0]["error"] is None and len(out[0]["tracks"]) == 1 and out[1]["tracks"] == [] and out[2]["tracks"] == []
    assert all(out[i]["error"] for i in (3, 4, 5, 6))


def test_documents_as_media(spark):
    rows = [(1, None), (2, ""), (3, "é" * 700), (4, "x" * 576), (5, "é" * 700)]
    got = {r["doc_id"]: r for r in isomedia.documents_as_media(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        data = isomedia.pad((t or "").encode())
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((t or "").encode()), len(data))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-32:])
        assert r["media_sha256"] == hashlib.sha256(isomedia.pack(data)).hexdigest() and r["media_bytes"] == len(isomedia.pack(data))
    assert got[3]["feature"] == got[5]["feature"] and isomedia.documents_as_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "s", None), (10_002, "", "en", "s", 0), (10_003, "123 456", None, None, 7)], docs.schema)
    (tmp_path / "in").mkdir()
    docs.unionByName(extra).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "in" / "documents.parquet"))
    kept, columns = [at], at.columns
    for name, stage in C.STAGES:
        kept.append(stage(spark, kept[-1], str(tmp_path / "in")).cache())
        assert name == C.STAGES[-1][0] or kept[-1].columns == columns
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] - ids[1] == {10_001, 10_002, 10_003} and all(b <= a for a, b in zip(ids, ids[1:]))
    assert ids[3] == ids[4] == ids[5] and kept[4].count() >= kept[3].count() and kept[5].where("not round_trip").isEmpty()
    assert kept[5].count() == kept[4].count() and C.run(spark, str(tmp_path / "in")).count() == kept[5].count()
