"""Content-addressed web archive: payloads stored once by digest, record headers apart, records restored by joins.

An archive is two tables. `payloads` has each different payload once, under its SHA-256. `headers` has for each record the
exact bytes of its headers (WARC/1.1 and, in the block, HTTP) and the digest of its payload. The record with the largest
identifier of those with equal payloads is the response, which carries the payload; the others revisit it.

Digests are verified: writing raises where one SHA-256 stands for payloads of different SHA-1 or size, reading where a
stored payload has another SHA-256 than its address or another SHA-1 than a header declares. Only digests are grouped, so
a payload that a third of all pages share is counted by all tasks; what is joined by digest is narrow, and Spark's
adaptive skew join splits it.

A null payload is empty; a null or repeated identifier is told apart by a row number in the record's name; a null address
is written as that name. White space in an address is percent-encoded. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, keyed, new_dir

CRLF = "\r\n"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: Column) -> Column:
    """The SHA-1 as the 32 characters that WARC headers use."""
    # 40 hex digits are two times 60 bits and 40 bits; 5 bits make a digit
    pieces = [F.lpad(F.conv(F.substring(F.sha1(payload), at, size), 16, 32), size * 4 // 5, "0") for at, size in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*pieces), HEX32, BASE32)


def record_name(id: Column, row: Column) -> Column:
    return F.concat(F.lit("urn:x-record:"), F.coalesce(id.cast("string"), F.lit("-")), F.lit(":"), row.cast("string"))


def header_lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*[x for name, value in pairs for x in (F.lit(f"{name}: "), value, F.lit(CRLF))], F.lit(CRLF))


def record_headers(kind: str, date: str) -> Column:
    """The exact headers of a response or a revisit, up to where the payload begins."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), header_lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("bytes").cast("string"))))
    size = F.octet_length(http) + (F.col("bytes") if kind == "response" else F.lit(0))
    own = record_name(F.col("_id"), F.col("_row"))
    address = F.col("_url")
    for char in (" ", "\t", "\r", "\n"):
        address = F.replace(address, F.lit(char), F.lit(f"%{ord(char):02X}"))
    named = lambda name: F.concat(F.lit("<"), name, F.lit(">"))
    first = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", named(own)), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.coalesce(address, own))]
    more = [] if kind == "response" else [("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", named(record_name(F.col("_of._id"), F.col("_of._row"))))]
    last = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", size.cast("string"))]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), header_lines(*first, *more, *last), http)


def write_archive(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes the tables `headers` and `payloads` into the folder. Payloads below `least` bytes make no revisits, but are stored once all the same."""
    spark = pages.sparkSession
    rows = keyed(pages, id)
    text = F.coalesce(F.col(f"_doc.{payload}").cast("string"), F.lit(""))
    facts = rows.select("_row", F.col(f"_doc.{id}").alias("_id"), F.col(f"_doc.{url}").alias("_url"), F.octet_length(text).cast("bigint").alias("bytes"), F.sha2(text, 256).alias("digest"), sha1_base32(text).alias("sha1"))
    facts = cut(facts, "pages")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.concat(F.lit(f"payloads of different {c} have the SHA-256 "), F.col("digest"))).cast("string"))
    groups = facts.groupBy("digest").agg(F.max(F.struct("_id", "_row")).alias("_of"), one("sha1").alias("_sha1"), one("bytes").cast("bigint").alias("_bytes"))
    groups = cut(groups, "payload-groups")
    joined = facts.join(groups, "digest")
    is_response = (F.col("_of._row") == F.col("_row")) | (F.col("bytes") < least)
    heads = joined.select("digest", is_response.alias("own"), F.when(is_response, record_headers("response", date)).otherwise(record_headers("revisit", date)).alias("head"))
    heads.write.option("compression", "zstd").parquet(f"{folder}/headers")
    stored = groups.select(F.col("_of._row").alias("_row"), "digest")
    rows.select("_row", text.alias("payload")).join(stored, "_row").select("digest", "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")
    discard(spark, facts, groups)
    return folder


def archive_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """headers (digest, own: whether the record carries its payload, head) and payloads (digest, payload), which are verified."""
    heads = spark.read.schema("digest string, own boolean, head string").parquet(f"{folder}/headers")
    payloads = spark.read.schema("digest string, payload string").parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("a stored payload has not the SHA-256 "), F.col("digest"))).cast("string")
    return heads, payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong))


def header_value(name: str) -> Column:
    """A WARC header's value; null without one."""
    return F.regexp_extract(F.regexp_substr("head", F.lit(rf"\r\n{name}: [^\r]*")), r": (.*)", 1)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """What each record is: page_id, payload_bytes, payload_digest, record_type, refers_to; sizes and digests are those of the stored payloads."""
    heads, payloads = archive_tables(spark, folder)
    named = lambda header: F.regexp_extract(header_value(header), r"^<urn:x-record:(-?\d+):\d+>$", 1).try_cast("bigint")
    read = heads.select("digest", named("WARC-Record-ID").alias("page_id"), header_value("WARC-Type").alias("record_type"), named("WARC-Refers-To").alias("refers_to"), header_value("WARC-Payload-Digest").alias("_declared"))
    facts = payloads.select("digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("_sha1"))
    wrong = F.raise_error(F.concat(F.lit("a record declares another digest than its payload has: "), F.col("_declared"))).cast("string")
    digest = F.when(F.col("_declared") == F.concat(F.lit("sha1:"), F.col("_sha1")), F.col("_sha1")).otherwise(wrong)
    return read.join(facts, "digest").select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def records(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """Each record (record: its text up to the two line ends that close it). whole: revisits carry their payload, too."""
    heads, payloads = archive_tables(spark, folder)
    carries = F.lit(True) if whole else F.col("own")
    with_payload = heads.where(carries).join(payloads, "digest").select(F.concat("head", "payload").alias("record"))
    return with_payload if whole else with_payload.unionByName(heads.where(~carries).select(F.col("head").alias("record")))


def export_warc(spark: SparkSession, folder: str, out: str, compression: str = "none") -> None:
    """Writes the archive as WARC files, one for each task."""
    records(spark, folder).write.option("lineSep", CRLF * 2).option("compression", compression).text(out)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes pages as an archive in the shared folder and reads it back."""
    spark = pages.sparkSession
    return read_archive(spark, write_archive(pages, new_dir(spark, "archive")))
