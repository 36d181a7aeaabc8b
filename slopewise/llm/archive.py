"""Content-addressed web archive: payload bytes stored once, record headers kept exactly, records rebuilt by joins.

`write_archive` makes two tables. `headers` has one row for each page: the exact bytes of its WARC header block and the
payload's address. `payloads` has one row for each distinct payload: its bytes under its address, the SHA-256 digest. Of
equal payloads, the page with the largest page_id is the response; the others are revisits that refer to it (payloads of
fewer than `least` bytes are all responses). `read_archive` joins the two, checks each payload against its address, and
puts header block and payload together again.

Edge cases: a null html is an empty payload. Null page_ids come before all others, so one is the response only where
all are null. Of fully equal rows one is the response. A url's line breaks are percent-encoded, a null url leaves the
header out. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewise.session import scratch_path

from .scratch import Scratch

BASE32_DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")  # fixed values: Java's digits, RFC 4648's


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 digest in base 32: each five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), *BASE32_DIGITS)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Writes `path/headers` and `path/payloads`."""
    scratch = Scratch(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    plain = plain.withColumns({"address": F.unhex(F.sha2("payload", 256)), "payload_bytes": F.octet_length("payload").cast("long")})
    rows = plain.select("page_id", "url", "address", "payload_bytes", base32_sha1(F.col("payload")).alias("sha1"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.table(rows, "pages")
    best = rows.groupBy("address").agg(F.max(F.struct("page_id", "row")).alias("best"))
    best = scratch.table(best.select("address", F.col("best.page_id").alias("first_id"), F.col("best.row").alias("first_row")), "best")

    response = (F.col("row") == F.col("first_row")) | (F.col("payload_bytes") < least)
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", named(F.col("page_id"))), F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, F.lit("")).otherwise(_line("WARC-Refers-To", named(F.col("first_id")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    headers = rows.join(best, "address").select("page_id", block.cast("binary").alias("header"), "address")
    headers.write.mode("overwrite").parquet(f"{path}/headers")

    # Rows of one address have one payload, so any of them will do.
    stored = plain.select("address", "payload").dropDuplicates(["address"])
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    scratch.drop(rows, best)


def read_archive(spark, path: str) -> DataFrame:
    """Each record as `page_id`, `record` (header block and payload), `header`, `payload`, `verified` (the payload has its address as digest)."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    good = F.unhex(F.sha2("payload", 256)) == F.col("address")
    payloads = payloads.select("address", "payload", good.alias("verified"))
    out = headers.join(payloads, "address", "left")
    return out.select("page_id", F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"), "header", "payload", F.coalesce("verified", F.lit(False)).alias("verified"))


def parsed(records: DataFrame) -> DataFrame:
    """What a record says, read from its bytes: `page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`, `url`, `intact`."""
    head = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(head, f"(?m)^{name}: ([^\r\n]*)", 1)
    length = field("Content-Length").cast("int")
    body = F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)")
    refers = F.regexp_extract(field("WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1)
    out = records.withColumns({"body": body, "length": length})
    digest = base32_sha1(F.col("body"))
    said = F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")
    return out.select("page_id", F.octet_length("body").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), field("WARC-Type").alias("record_type"),
                      F.when(refers != "", refers).cast("long").alias("refers_to"), F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
                      (F.col("verified") & (said == digest) & (F.col("length") == F.octet_length("body"))).alias("intact"))


def archived(pages: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    """Pages written to a fresh archive in the shared folder and read back."""
    path = scratch_path(pages.sparkSession, "archive")
    write_archive(pages, path, least=least, **columns)
    return parsed(read_archive(pages.sparkSession, path))
