"""Content-addressed web archives.

Method: payload bytes are stored once, under their SHA-256, which is verified when they are read; the exact record headers
are stored separately, each with the digest of its payload; original records come back by joins.  Of the records with equal
payloads the one with the largest page id is the response, the others are revisits that name it.

An archive is a folder of two Parquet tables: ``payloads`` (sha256, payload) and ``records`` (page_id, row, record_type,
refers_to, sha256, header, http).  ``header`` and ``http`` are the exact bytes up to the payload.

A hot payload (a third of all pages may be copies) costs one stored copy; the rows that look it up are dealt over tasks.

Defined cases: null html is an empty payload; a null url leaves out the target field; null page ids count as the smallest;
repeated rows with equal ids become separate records, one of which is the response; an empty table gives an empty archive;
a payload of any length is stored whole; of equal page ids (a tie) the last row is the response; further columns are not archived, whatever their names; line ends within a url are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, scratch, shared_folder, written

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least this many bytes are revisited.
LEAST_BYTES = 0


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1, as payload digests are written: 8 groups of 20 bits, each 4 characters."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page_id: Column, row: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit("page"), page_id.cast("string"), row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> None:
    """Archive page_id, url, html of ``pages`` below ``folder``."""
    with scratch():
        _write_archive(pages, folder, least_bytes)


def _write_archive(pages: DataFrame, folder: str, least_bytes: int) -> None:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    own.select("sha256", "payload").dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    # the row number is fixed once this table is written
    index = written(own.select("page_id", "url", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n"), F.monotonically_increasing_id().alias("row")), "warc-index")
    repeated = index.where(F.col("n") >= least_bytes).groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    of = lookup(index, written(repeated, "warc-repeated"), "sha256", F.col("row"), "copies")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    only = lambda value: F.coalesce(value, F.lit(""))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"), F.col("row"))),
        line("WARC-Date", F.lit(DATE)),
        only(line("WARC-Target-URI", url)),
        only(line("WARC-Page-ID", F.col("page_id").cast("string"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        only(F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("first.page_id"), F.col("first.row"))), only(line("WARC-Refers-To-Page-ID", F.col("first.page_id").cast("string")))))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    of.select("row", "sha256", header.alias("header"), http.alias("http")).write.option("compression", "zstd").parquet(f"{folder}/records")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """sha256, payload, payload_bytes, payload_digest; a payload that isn't what its digest says fails the job."""
    ok = F.sha2("payload", 256) == F.lower(F.hex("sha256"))
    return spark.read.parquet(f"{folder}/payloads").select(
        "sha256",
        F.when(ok, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("sha256"))).cast("binary")).alias("payload"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(ok, base32_sha1(F.col("payload"))).otherwise(F.raise_error(F.lit("payload differs from its digest")).cast("string")).alias("payload_digest"),
    )


def _field(name: str) -> Column:
    found = F.regexp_extract("header", f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records' parsed headers: page_id, record_type, refers_to, declared_digest, sha256, header, http, row."""
    return spark.read.parquet(f"{folder}/records").select(
        _field("WARC-Page-ID").cast("long").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.substring(_field("WARC-Payload-Digest"), 6, 32).alias("declared_digest"),
        "sha256",
        "header",
        "http",
        "row",
    )


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """Every original record whole: record (bytes), head (how many of them are before its payload), and the columns page_id, record_type, refers_to,
    declared_digest, sha256, row. A response joins its payload, once for each digest; revisits have none."""
    records = read_records(spark, folder).withColumn("__head", F.concat(F.col("header").cast("binary"), F.col("http").cast("binary")))
    end = F.lit((CRLF + CRLF).encode())
    told = ("page_id", "record_type", "refers_to", "declared_digest", "sha256", "row", F.octet_length("__head").alias("head"))
    whole = records.where("record_type = 'response'").join(read_payloads(spark, folder).select("sha256", "payload"), "sha256").select(*told, F.concat("__head", "payload", end).alias("record"))
    return whole.unionByName(records.where("record_type = 'revisit'").select(*told, F.concat("__head", end).alias("record")))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Archive all pages and read the archive back; page_id, payload_bytes, payload_digest, record_type, refers_to of each rebuilt record.

    The payload is cut from the rebuilt record of its response; a revisit's is that of the response with its digest.
    """
    import uuid

    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, folder)
    rebuilt = reconstruct(spark, folder)
    body = F.substring("record", F.col("head") + 1, F.octet_length("record") - F.col("head") - 4)
    sha1 = base32_sha1(F.col("payload"))
    agree = F.when(F.col("declared_digest") == sha1, sha1).otherwise(F.raise_error(F.lit("a header's digest differs from its payload's")).cast("string"))
    with scratch("responses", "paid"):
        responses = written(rebuilt.where("record_type = 'response'").withColumn("payload", body).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), agree.alias("payload_digest"), "record_type", "refers_to", "sha256"), "responses")
        revisits = rebuilt.where("record_type = 'revisit'")
        copies = revisits.groupBy("sha256").agg(F.count("*").alias("copies"))
        paid = written(responses.select("sha256", "payload_bytes", "payload_digest").join(copies, "sha256"), "paid")
        told = lookup(revisits.select("page_id", "record_type", "refers_to", "declared_digest", "sha256", "row"), paid, "sha256", F.col("row"), "copies")
    same = F.when(F.col("declared_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit's digest differs from its response's")).cast("string"))
    return responses.drop("sha256").unionByName(told.select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to"))


_HEX5 = "('0x' || substr(h, 1 + 5 * g, 5))::BIGINT"
_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (({_HEX5} >> {s}) & 31))::BIGINT, 1)" for s in (15, 10, 5, 0))

#: The result of archive_pages() in DuckDB's SQL, for distinct page ids.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html, max(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: {_CHARS}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN m USING (html)
"""
