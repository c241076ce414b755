"""WARC archives addressed by content: each payload is stored once under its SHA-256, record headers are kept apart.

``write_archive`` makes two folders of WARC text in the shared folder: ``headers`` (the exact header block of every
record) and ``payloads`` (one gzipped record for each different payload). ``read_archive`` parses both, checks every
payload against its digest and length, and joins them to the original records again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm.common import work_dir

END = "\r\n\r\n"
#: Smaller payloads are never replaced by a revisit record.
MIN_REVISIT_BYTES = 100
WRITTEN = "1970-01-01T00:00:00Z"


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"\r\n{name}: "), value)


def _one_line(value: Column) -> Column:
    """A header value without line breaks (RFC 3986 percent signs for CR and LF)."""
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT_BYTES) -> str:
    """Write both folders under path; returns the boundary that marks the payload records.

    A null html is an empty payload. Rows that repeat a page_id with one payload are records of the same type each. A
    null page_id is recorded as empty and reads back as null; it is a revisit where another page has its payload.
    """
    boundary = uuid.uuid4().hex
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("_id"), F.col(url).cast("string").alias("_url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_html")
    ).select("*", F.sha2(F.col("_html").cast("binary"), 256).alias("_digest"), F.octet_length("_html").cast("bigint").alias("_bytes"), F.xxhash64("_id", "_url").alias("_key"))
    slim = rows.drop("_html")
    # of equal payloads one row is chosen by its content, so that it is the same row whenever pages are read again
    kinds = slim.groupBy("_digest", "_key").agg(F.min("_id").alias("_id"), F.count("*").alias("_n"))
    firsts = kinds.groupBy("_digest").agg(F.min("_id").alias("_first"), F.min(F.struct("_key", "_n")).alias("_keep"))
    revisit = (F.col("_bytes") >= min_revisit) & F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    records = slim.join(firsts.drop("_keep"), "_digest").select(
        F.concat(
            F.lit("WARC/1.1"),
            _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(">"))),
            _header("WARC-Date", F.lit(WRITTEN)),
            _header("WARC-Target-URI", _one_line(F.col("_url"))),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
            F.when(revisit, _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">")))).otherwise(F.lit("")),
            F.when(revisit, _header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
            _header("Content-Type", F.lit("text/html")),
            _header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("_bytes").cast("string"))),
        ).alias("value")
    )
    records.write.option("lineSep", END).option("compression", "gzip").text(f"{path}/headers")
    # every payload once: the row to keep is known by digest and key, so copies of a payload never meet in one task
    def kept(keep: DataFrame) -> DataFrame:
        return rows.join(keep.select("_digest", F.col("_keep._key").alias("_key")).hint("shuffle_hash"), ["_digest", "_key"], "left_semi").select("_digest", "_bytes", "_html")

    stored = kept(firsts.where("_keep._n = 1"))
    again = firsts.where("_keep._n > 1")  # rows that repeat id, address and payload: one of them, found before the shuffle
    if again.limit(1).count():
        stored = stored.unionByName(kept(again).groupBy("_digest", "_bytes").agg(F.first("_html").alias("_html")))
    payloads = stored.select(
        F.concat(
            F.lit(f"WARC/1.1\r\nX-Boundary: {boundary}"),
            _header("WARC-Type", F.lit("resource")),
            _header("WARC-Record-ID", F.concat(F.lit("<urn:sha256:"), F.col("_digest"), F.lit(">"))),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
            _header("Content-Length", F.col("_bytes").cast("string")),
            F.lit(END),
            F.col("_html"),
        ).alias("value")
    )
    payloads.write.option("lineSep", END).option("compression", "gzip").text(f"{path}/payloads")
    return boundary


def _value(name: str) -> Column:
    return F.regexp_extract("value", rf"\r\n{name}: ([^\r]*)", 1)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, digest and the exact header block of every record."""
    lines = spark.read.option("lineSep", END).text(f"{path}/headers")

    def page(name: str) -> Column:
        return F.regexp_extract("value", rf"\r\n{name}: <urn:page:(-?\d*)>", 1).try_cast("bigint")

    return lines.select(page("WARC-Record-ID").alias("page_id"), _value("WARC-Target-URI").alias("url"), _value("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), _value("WARC-Payload-Digest").substr(8, 64).alias("digest"), F.col("value").alias("header"))


def read_payloads(spark: SparkSession, path: str, boundary: str) -> DataFrame:
    """digest and payload (binary) of every stored payload; fails where bytes do not match digest and length."""
    mark = f"WARC/1.1\r\nX-Boundary: {boundary}"
    lines = spark.read.option("lineSep", END + mark).text(f"{path}/payloads").where(F.length("value") > 0)
    block = F.expr("substring(cast(value as binary), instr(value, '\\r\\n\\r\\n') + 4, cast(regexp_extract(value, '\\r\\nContent-Length: ([0-9]+)', 1) as int))")
    parsed = lines.select(_value("WARC-Payload-Digest").substr(8, 64).alias("digest"), _value("Content-Length").cast("bigint").alias("_bytes"), block.alias("payload"))
    found = F.sha2("payload", 256)
    good = (found == F.col("digest")) & (F.octet_length("payload") == F.col("_bytes"))
    return parsed.select(F.when(good, found).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest")))).alias("digest"), "payload")


def read_archive(spark: SparkSession, path: str, boundary: str) -> DataFrame:
    """The original records: header fields with the full payload, revisits included. A record without its payload is an
    error, not left out."""
    return _complete(read_headers(spark, path).join(read_payloads(spark, path, boundary).withColumn("_there", F.lit(True)), "digest", "left"))


def _complete(records: DataFrame) -> DataFrame:
    lost = F.raise_error(F.concat(F.lit("no payload is stored under "), F.col("digest"))).cast("string")
    return records.withColumn("digest", F.when(F.col("_there"), F.col("digest")).otherwise(lost)).drop("_there")


def archive_digests(pages: DataFrame, **options) -> DataFrame:
    """Write the archive of pages, read it back and report each record by length and digest of the payload found there."""
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    boundary = write_archive(pages, path, **options)
    facts = read_payloads(spark, path, boundary).select("digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.lit(True).alias("_there"))
    return _complete(read_headers(spark, path).join(facts, "digest", "left")).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
