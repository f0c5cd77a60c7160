"""A content-addressed WARC archive: payloads once by strong digest, record headers apart, records rebuilt by joins.

An archive is two Parquet tables. `payloads` has each distinct payload once, under its SHA-256. `records` has for each record
its exact header bytes (WARC header and HTTP header), its type and the digest of its payload. A record is its header, for a
response its payload, and the closing blank lines; reading joins the tables, checks every digest against the bytes, and
gives the records as they would stand in a WARC file. Everything runs on built-in functions.

Payloads are reduced to one for each digest within a task before they are shuffled, so a payload that a third of all pages
share moves once for each task. Otherwise digests and lengths travel instead of payloads: a page is a row of some hundred bytes
when responses are chosen, a revisit is checked against its response's facts, and only responses' bytes are joined again. Rows
of a very frequent digest are salted (see skew.py).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import checkpoint_folder, checkpointed
from .skew import salted_join

#: Payloads of so many bytes are revisited; smaller ones are always responses.
LEAST_REVISIT = 1000
#: Written where a page has no date of its own.
DATE = "1970-01-01T00:00:00Z"
#: What closes a record.
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*parts: Column | str) -> Column:
    """Header lines, each of a name and a value, with their line ends."""
    return F.concat(*(F.concat(p if isinstance(p, Column) else F.lit(p), F.lit("\r\n")) for p in parts))


def record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def _facts(pages: DataFrame, key: str, url: str, html: str, date: Column) -> DataFrame:
    """(key, url, date, n, sha1, digest) of each page: what its record needs to know of its payload."""
    payload = _payload(html)
    return pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), date.alias("date"), F.octet_length(payload).alias("n"), F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("digest"))


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("binary"), F.lit(b""))


def as_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: Column | str = DATE, least: int = LEAST_REVISIT) -> DataFrame:
    """A row for each page: key, record_type, refers_to, digest (SHA-256), n (bytes) and sha1 of its payload, and its header (binary).

    Of rows with equal payloads of at least `least` bytes, that with the largest key is a response and the others revisit it.
    A null html is an empty payload, a null url an empty address. Rows that tie for the largest key are all responses; a row
    without a key is never referred to, and revisits when some row with a key has its payload. Other columns are left out.
    """
    rows = checkpointed(_facts(pages, key, url, html, date if isinstance(date, Column) else F.lit(date)))
    first = rows.where(F.col("n") >= least).groupBy("digest").agg(F.max("key").alias("first"))
    rows = salted_join(rows, first, "digest")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    rows = rows.withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))).withColumn("refers_to", F.when(revisit, F.col("first")))
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("n").cast("string")), "")
    rows = rows.withColumn("http", http)
    length = F.octet_length("http") + F.when(F.col("record_type") == "response", F.col("n")).otherwise(0)
    warc = F.concat(
        _lines("WARC/1.1", F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("key"))), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", " ")), F.concat(F.lit("WARC-Date: "), F.col("date")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"))),
        F.when(F.col("record_type") == "revisit", _lines(F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"))), f"WARC-Profile: {PROFILE}")).otherwise(F.lit("")),
        _lines("Content-Type: application/http;msgtype=response", F.concat(F.lit("Content-Length: "), length.cast("string")), ""),
        F.col("http"),
    )
    return rows.select(F.col("key").alias(key), "record_type", "refers_to", "digest", "n", "sha1", warc.cast("binary").alias("header"))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", html: str = "html", **options) -> None:
    """Writes the pages' archive below path: records and payloads. A payload of any length, up to a row's 2 GB, is stored whole, once."""
    payload = _payload(html)
    stored = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    stored.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    as_records(pages, key, html=html, **options).select(key, "record_type", "digest", "header").write.parquet(f"{path}/records")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of an archive's payloads; fails at one that doesn't have its digest."""
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload doesn't have its digest")).cast("binary"))
    return spark.read.parquet(f"{path}/payloads").select("digest", sound.alias("payload"))


def _found(name: str) -> Column:
    """A joined column, which must be there."""
    return F.coalesce(name, F.raise_error(F.lit("a payload is missing")).cast({"payload": "binary", "n": "int", "sha1": "string"}[name]))


def read_archive(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """An archive's records: key, record (binary, as in a WARC file), header, and payload (binary; of a revisit, the one it refers to).

    Fails if a payload is missing or doesn't have its digest.
    """
    rows = salted_join(spark.read.parquet(f"{path}/records"), _stored(spark, path), "digest").withColumn("payload", _found("payload"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select(key, F.concat("header", body, F.lit(END)).alias("record"), "header", "payload")


def read_headers(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """What an archive's records say of themselves: key, url, record_type, refers_to, payload_digest, payload_bytes.

    As `parsed`, with the same checks, and every record is rebuilt too: responses from their header and payload, revisits from
    their header alone. Payloads so travel to the records that hold them; a revisit is checked against its payload's facts.
    """
    records, stored = spark.read.parquet(f"{path}/records"), _stored(spark, path)
    whole = salted_join(records.where("record_type = 'response'"), stored, "digest").withColumn("payload", _found("payload"))
    whole = whole.select(key, "header", F.concat("header", "payload", F.lit(END)).alias("record"), F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1"))
    facts = stored.select("digest", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1"))
    again = salted_join(records.where("record_type = 'revisit'"), facts, "digest").withColumn("n", _found("n")).withColumn("sha1", _found("sha1"))
    again = again.select(key, "header", F.concat("header", F.lit(END)).alias("record"), "n", "sha1")
    return _checked(whole.unionByName(again), F.col("header"), F.col("sha1"), F.col("n"), _block("record"), key)


def _block(record: str) -> Column:
    """The length of a record's block: what stands between the end of its own header and its closing lines."""
    return F.octet_length(record) - F.instr(F.decode(record, "ISO-8859-1"), "\r\n\r\n") - 3 - len(END)


def _checked(rows: DataFrame, head: Column, sha1: Column, n: Column, block: Column, key: str, *more: str) -> DataFrame:
    stated = F.regexp_extract(header_field(head, "WARC-Payload-Digest"), "^sha1:([0-9a-f]{40})$", 1)
    sound = (sha1 == stated) & (block == header_field(head, "Content-Length").cast("int"))
    digest = F.when(sound, sha1).otherwise(F.raise_error(F.lit("a record doesn't match its header")))
    return rows.select(key, header_field(head, "WARC-Target-URI").alias("url"), header_field(head, "WARC-Type").alias("record_type"), F.regexp_extract(header_field(head, "WARC-Refers-To"), "^<urn:page:(.*)>$", 1).alias("refers_to"), digest.alias("payload_digest"), n.cast("long").alias("payload_bytes"), *more)


def header_field(record: Column, name: str) -> Column:
    """The value of a field of a record's WARC header; null if there is none."""
    head = F.substring_index(F.decode(record, "UTF-8"), "\r\n\r\n", 1)
    value = F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    return F.when(value != "", value)


def parsed(records: DataFrame, key: str = "page_id") -> DataFrame:
    """What the archived bytes say of each record: key, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    Fails if a payload's SHA-1 isn't the one in its header, or a record's length the one that it states.
    """
    rows = records.withColumn("__sha", F.sha1("payload"))
    return _checked(rows, F.col("header"), F.col("__sha"), F.octet_length("payload"), _block("record"), key, "payload")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages, archived and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_folder(spark, "warc")
    write_archive(pages, path)
    return read_headers(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, payload, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM d
"""
