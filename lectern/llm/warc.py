"""Content-addressed WARC archive.

An archive is a folder of two Parquet tables:

- ``payloads``: (address, payload), every distinct payload once, under its SHA-256;
- ``records``: (page_id, address, header), the exact header block of every record, as bytes.

Of the records with equal payloads of at least ``least`` bytes, the one with the smallest page_id is a response;
the others are revisits that refer to it. ``verified`` recomputes the addresses of what was stored and fails on
the first that differs; ``reconstruct`` joins headers and payloads to whole records again (a revisit holds no
block). Only slim rows are shuffled by payload; a payload moves once, as its response.

Defined cases: a null html is the empty payload; a null url is the empty target, and line ends in one are percent-encoded; very
long payloads move once and whole; repeated rows are records of their own, each with its own record id (equal page_ids are
no smaller than each other, so both are responses, while the payload is stored once);
a row without a page_id is a revisit wherever another row holds its payload; an empty table gives an empty
archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import new_path, stored

# The digits of base 32 as conv() writes them, and those of RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hexadecimal digits are 4 of base 32."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, RFC_DIGITS)


def _uri(page_id: Column, row: Column) -> Column:
    """A record's own id: row tells those of one page_id apart, and is null for the first of them."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(F.concat(F.lit(":r"), row.cast("string")), F.lit("")), F.lit(">"))


def _header(kind: Column) -> Column:
    """The header block, ending with the empty line before the block."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    is_revisit = kind == "revisit"
    none = F.lit("")
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.coalesce(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), none)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("first_record")))).otherwise(none),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(END),
    ).cast("binary")


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> str:
    """Write an archive of one record per row; returns its path."""
    path = path or new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    slim = stored(rows.select("page_id", "url", F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("address"), base32_sha1(F.col("payload")).alias("digest")), "warc_slim")
    slim = slim.withColumn("row", F.monotonically_increasing_id())
    # Of the rows of one page_id, all but the first carry their number in the record's id.
    firsts = slim.groupBy("page_id").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("is_first"))
    slim = slim.join(firsts, "row", "left").withColumn("record_id", _uri(F.col("page_id"), F.when(F.col("is_first").isNull(), F.col("row")))).drop("is_first")
    slim = stored(slim, "warc_records")
    least_id = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row", "record_id"))).alias("f")
    first = slim.groupBy("address").agg(least_id).select("address", F.col("f.page_id").alias("first_id"), F.col("f.record_id").alias("first_record"))
    kind = F.when((F.col("size") >= least) & F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull()), "revisit").otherwise("response")
    records = slim.join(first, "address").select("page_id", "address", _header(kind).alias("header"))
    records.write.option("compression", "zstd").parquet(f"{path}/records")
    # One row per payload carries it; the pair of keys spreads what equal payloads there are.
    same = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    addressed = rows.select(same("page_id").alias("holder"), F.sha2("payload", 256).alias("address"), "payload")
    payloads = addressed.join(first.select("address", same("first_id").alias("holder")), ["address", "holder"]).dropDuplicates(["address", "holder"])
    payloads.select("address", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(address, payload, size, digest) of the stored payloads; fails where the bytes do not have their address."""
    held = spark.read.parquet(f"{path}/payloads").withColumn("found", F.sha2("payload", 256))
    address = F.when(F.col("found") == F.col("address"), F.col("address")).otherwise(F.raise_error(F.concat(F.lit("stored payload differs from its address "), F.col("address"))))
    return held.select(address.alias("address"), "payload", F.length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest"))


def fields(spark: SparkSession, path: str) -> DataFrame:
    """The records' headers, parsed: page_id, address, record_type, refers_to, length, header."""
    text = F.col("header").cast("string")
    one = lambda name: F.regexp_extract(text, f"(?m)^{name}: (.*?)\\r?$", 1)
    refers = F.regexp_extract(one("WARC-Refers-To"), "<urn:page:(-?[0-9]+)(?::r[0-9]+)?>", 1)
    return spark.read.parquet(f"{path}/records").select("page_id", "address", one("WARC-Type").alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"), one("Content-Length").cast("long").alias("length"), F.substring_index(one("WARC-Payload-Digest"), ":", -1).alias("payload_digest"), "header")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): every record's bytes, header, block and the two line ends."""
    joined = fields(spark, path).join(verified(spark, path).select("address", "payload"), "address")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", F.concat("header", block, F.lit((END + END).encode())).alias("record"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Per record, from its header and the verified payload: size and digest of the full payload, type, reference."""
    held = verified(spark, path).select("address", "size", "digest")
    joined = fields(spark, path).join(held, "address")
    digest = F.when(F.col("digest") == F.col("payload_digest"), F.col("digest")).otherwise(F.raise_error(F.lit("a header's digest is not its payload's")))
    return joined.select("page_id", F.col("size").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
