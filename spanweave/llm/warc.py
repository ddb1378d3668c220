"""Content-addressed WARC archive.

An archive is two tables in the shared folder. ``payloads`` holds the bytes of every distinct payload
once, under their SHA-256 address. ``headers`` holds one row per record: the exact header block
(WARC header and HTTP header) and the address of its payload. A record is put together again by a
join on the address; a payload is used only after its bytes have been hashed to their address again.

Of records with equal payloads of at least ``revisit_bytes`` bytes, those with the largest id are
``response``, the others ``revisit`` it; smaller ones are all ``response``.

Hot payloads: copies collapse in each task before the shuffle, and only the (address, id) pairs of
payloads that occur more than once are joined back, as two plain shuffles that adaptive execution
splits where one address holds many records.

Defined results: a null payload is empty; an empty payload is a response with the digest of nothing; repeated rows
are records of their own with the same answer; a null target leaves out its header line; a record without id
revisits if another record of its payload has one; an empty table gives an empty archive; other columns
are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.session import materialize, shared_folder

RECORD = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line ends inside a value are escaped."""
    clean = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _header(date: str) -> Column:
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    revisit = F.col("record_type") == "revisit"
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{RECORD}"), F.col("id").cast("string"), F.lit(">"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("target")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", F.concat(F.lit(f"<{RECORD}"), F.col("refers_to").cast("string"), F.lit(">"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(END), http,
    )


def write_archive(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", target_col: str = "url", payload_col: str = "html",
    revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z",
) -> str:
    """Write one record per row; returns the folder of the archive."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/spanweave/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(target_col).alias("target"), payload.alias("payload"))
    addressed = rows.withColumn("address", F.sha2("payload", 256))
    facts = materialize(
        addressed.select("id", "target", "address", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes")),
        "warc-facts",
    )
    shared = materialize(
        facts.where(F.col("bytes") >= revisit_bytes).groupBy("address")
        .agg(F.max("id").alias("keeper"), F.count("*").alias("records")).where("records > 1").select("address", "keeper"),
        "warc-shared",
    )
    revisits = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    records = facts.join(shared, "address", "left").select(
        "id", "target", "address", "digest", "bytes",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("keeper")).alias("refers_to"),
    )
    records.select("address", _header(date).alias("header")).write.parquet(f"{folder}/headers")
    addressed.groupBy("address").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    return folder


def _field(name: str, pattern: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(address, header) and what the header says: id, record_type, target, digest, refers_to."""
    number = lambda c: F.when(c != "", c.cast("bigint"))
    headers = spark.read.schema("address string, header string").parquet(f"{folder}/headers")
    return headers.select(
        "address", "header", number(_field("WARC-Record-ID", f"<{RECORD}([^>]*)>")).alias("id"),
        F.regexp_extract("header", r"^WARC/1\.1\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        F.expr(r"nullif(regexp_extract(header, '\r\nWARC-Target-URI: ([^\r]*)\r\n', 1), '')").alias("target"),
        _field("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("digest"),
        number(_field("WARC-Refers-To", f"<{RECORD}([^>]*)>")).alias("refers_to"),
    )


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(address, payload, intact): intact payloads hash to their address."""
    stored = spark.read.schema("address string, payload binary").parquet(f"{folder}/payloads")
    return stored.select("address", "payload", (F.sha2("payload", 256) == F.col("address")).alias("intact"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records: header fields, payload, and the exact bytes of the record (a revisit carries no payload bytes).

    A record whose payload is missing or damaged stays, with null payload and record."""
    whole = read_headers(spark, folder).join(read_payloads(spark, folder).where("intact"), "address", "left")
    record = F.concat(
        F.encode("header", "UTF-8"), F.when(F.col("record_type") == "response", F.col("payload")).when(F.col("payload").isNotNull(), F.lit(b"")),
        F.lit(END.encode()),
    )
    return whole.select("id", "record_type", "target", "digest", "refers_to", "payload", record.alias("record"))


def read_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Per record what reading it back shows. Payload bytes are measured where they are stored, so
    only their length and digest travel to the records. A record whose payload is missing or damaged stays: it is not
    verified, and shows what is stored (nulls if nothing is)."""
    measured = read_payloads(spark, folder).select(
        "address", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "intact"
    )
    return read_headers(spark, folder).join(measured, "address", "left").select(
        "id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        F.coalesce(F.col("intact") & (F.col("payload_digest") == F.col("digest")), F.lit(False)).alias("verified"),
    )
