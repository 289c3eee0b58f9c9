"""Content-addressed WARC archive: payloads once by digest, record headers as they are, joins to read back.

An archive is a folder of two Parquet tables. ``payloads`` holds every distinct payload once, under its
SHA-256. ``headers`` holds, for every record, the exact bytes that stand before the payload (WARC header
and HTTP header) and the payload's digest. Reading joins the two on the digest, checks each payload
against its digest, and puts the records together again. A revisit's own record has no payload in it,
but its payload is found by the same join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import fields
from tickloom.session import scratch_path, staged

#: Payloads of fewer bytes are repeated rather than revisited.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(key: Column, row: Column) -> Column:
    """Record id: the record's key (nothing if null) and a number that tells repeated keys apart."""
    return F.concat(F.lit("<urn:x-record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _uri_text(url: Column) -> Column:
    """A URL that fits in a header line: control characters and blanks are percent-encoded."""
    plain = url
    for code in [*range(33), 127]:
        plain = F.replace(plain, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return plain


def _header(record_type: Column) -> Column:
    """The bytes before the payload. Needs uri, refers_uri, url, payload_digest, n_bytes."""
    revisit = record_type == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", record_type), line("WARC-Record-ID", F.col("uri")), line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", _uri_text(F.col("url")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("refers_uri")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))).cast("string")),
        F.lit(CRLF), http,
    ).cast("binary")


def write_archive(records: DataFrame, path: str | None = None) -> str:
    """Writes ``records`` (key long, url string, payload binary) to an archive and returns its folder.

    Of the records with the same payload of ``REVISIT_BYTES`` or more, the one with the largest key is the
    response and the others revisit it; of repeated rows one is. Null payloads count as empty, null keys
    as smaller than all others, null URLs leave their header line out. An empty table gives an empty archive.
    """
    spark = records.sparkSession
    path = path or scratch_path(spark, "archive")
    records = records.select("key", "url", F.coalesce("payload", F.lit("").cast("binary")).alias("payload"))
    digest = F.unhex(F.sha2("payload", 256)).alias("digest")
    # facts are small; payloads travel once, to their digest, and copies meet on the map side already
    facts = staged(records.select(F.monotonically_increasing_id().alias("row"), "key", "url", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("payload_digest"), digest), "facts")
    records.select(digest, "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    owners = facts.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("key", "row")).alias("owner"))
    typed = facts.join(owners, "digest", "left").withColumn("revisit", F.col("owner").isNotNull() & (F.col("owner.row") != F.col("row")))
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    named = typed.withColumn("uri", record_uri(F.col("key"), F.col("row"))).withColumn("refers_uri", record_uri(F.col("owner.key"), F.col("owner.row")))
    named.select(F.col("row").alias("record"), "digest", (~F.col("revisit")).alias("has_payload"), _header(kind).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``record, header, payload, content``: every record, put together again.

    ``payload`` is the full payload, for revisits too, and is checked against its digest; ``content`` is
    the exact WARC record: header, payload where the record holds one, and the closing blank lines.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    intact = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    payloads = payloads.select("digest", F.when(intact, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary")).alias("payload"))
    whole = spark.read.parquet(f"{path}/headers").join(payloads, "digest")
    content = F.concat("header", F.when(F.col("has_payload"), F.col("payload")).otherwise(F.lit("").cast("binary")), F.lit(CRLF * 2).cast("binary"))
    return whole.select("record", "header", "payload", content.alias("content"))


def header_value(header: Column, name: str) -> Column:
    """Value of a header line, null if there is none. Lines end at CRLF, which values cannot hold."""
    found = F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def write_warc_files(spark: SparkSession, path: str, target: str, compression: str = "gzip") -> None:
    """The archive's records as plain WARC files below ``target``, a file per task.

    A record ends with two line ends, so Spark's text writer with that separator writes WARC.
    """
    content = read_archive(spark, path).select(F.expr(f"substring(content, 1, octet_length(content) - {len(CRLF * 2)})").cast("string").alias("value"))
    content.write.option("lineSep", CRLF * 2).option("compression", compression).text(target)


def warc_digest(pages: DataFrame) -> DataFrame:
    """Per page, read back from an archive of all pages: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    pages = fields(pages, page_id="long", url="string", html="string")
    path = write_archive(pages.select(F.col("page_id").alias("key"), "url", F.col("html").cast("binary").alias("payload")))
    back = read_archive(pages.sparkSession, path).withColumn("text", F.col("header").cast("string"))
    key_of = lambda uri: F.regexp_extract(uri, r"^<urn:x-record:(-?\d*):", 1)
    number = lambda text: F.when(text != "", text).cast("long")
    return back.select(
        number(key_of(header_value(F.col("text"), "WARC-Record-ID"))).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        header_value(F.col("text"), "WARC-Type").alias("record_type"), number(key_of(header_value(F.col("text"), "WARC-Refers-To"))).alias("refers_to"),
    )
