"""A content-addressed WARC archive.

write_archive stores two Parquet tables in a folder: payloads (each distinct payload's bytes once, by
its SHA-256 and length) and headers (the exact WARC header block of every record). read_archive joins the
two and rebuilds the whole records; it recomputes each payload's digests and fails on one that doesn't
match. The headers of a payload with more than PART_RECORDS records are read in parts, each with a copy
of the payload, so that no task gets them all.

Of the records with equal payloads of at least REVISIT_BYTES, the one with the largest identifier is a
response and the others are revisits that refer to it; smaller payloads are always responses.

Null payloads count as empty, and empty payloads are responses of 0 bytes. A null url leaves out the
WARC-Target-URI line, a null identifier the X-Page-ID line. Every row makes a record of its own, rows that
repeat an identifier too: of equal payloads, all rows with the largest identifier are responses. A null
identifier is never the largest; where equal payloads have no other, all are responses. Identifiers can be
of any type that casts to a string and back. Extra columns are not stored. An empty table gives an archive
without records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 1000
PART_RECORDS = 4096
#: Fixed values of the WARC 1.1 format.
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def record_urn(page_id: Column) -> Column:
    """A record's URN: a UUID made of the hash of its identifier."""
    h = F.sha2(F.concat(F.lit("record:"), page_id.cast("string")), 256)
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def one_line(text: Column) -> Column:
    """Text without line ends, which become %0D and %0A; what looks like one of these gets a 25 after its %."""
    return F.replace(F.replace(F.regexp_replace(text, "%((?:25)*0[AD])", "%25$1"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def as_before(line: Column) -> Column:
    """The text of one_line."""
    return F.regexp_replace(F.replace(F.replace(line, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), "%25((?:25)*0[AD])", "%$1")


def header_block(page_id: Column, url: Column, kind: Column, refers_to: Column, sha1: Column, length: Column) -> Column:
    """The header lines of a record, ended by an empty line."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    revisit = kind == "revisit"
    return F.concat_ws(
        "",
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_urn(page_id), F.lit(">"))),
        F.lit(f"WARC-Date: {EPOCH}{CRLF}"),
        line("WARC-Target-URI", one_line(url)),
        line("X-Page-ID", one_line(page_id.cast("string"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("X-Payload-Length", length.cast("string")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<"), record_urn(refers_to), F.lit(">")))),
        F.when(revisit, line("X-Refers-To-Page-ID", one_line(refers_to.cast("string")))),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(length).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the archive of pages: payloads, headers and (for the writing only) the digest of each row.

    A payload's copies in one task become one before they are shuffled, and a header finds its payload's owner
    through its own task's list of digests, so a payload that very many rows share stays spread out.
    """
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    page = pages.select(F.col(id_col).alias("a_id"), F.col(url_col).alias("a_url"), body.alias("a_payload"))
    keyed = page.withColumn("a_sha256", F.unhex(F.sha2("a_payload", 256))).withColumn("a_bytes", F.octet_length("a_payload").cast("long"))
    keyed.select("a_id", "a_url", "a_sha256", "a_bytes", F.sha1("a_payload").alias("a_sha1"), F.spark_partition_id().alias("a_task")).write.parquet(f"{folder}/digests")
    stored = keyed.groupBy("a_sha256", "a_bytes").agg(F.max("a_id").alias("owner"), F.count("*").alias("records"), F.first("a_payload").alias("payload"))
    stored.write.parquet(f"{folder}/payloads")

    digests = spark.read.parquet(f"{folder}/digests")
    owners = spark.read.parquet(f"{folder}/payloads").select("a_sha256", "a_bytes", "owner", "records")
    by_task = digests.select("a_task", "a_sha256", "a_bytes").distinct().join(owners, ["a_sha256", "a_bytes"])
    joined = digests.join(by_task, ["a_task", "a_sha256", "a_bytes"])
    revisit = (F.col("a_bytes") >= REVISIT_BYTES) & ~F.col("a_id").eqNullSafe(F.col("owner"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    header = header_block(F.col("a_id"), F.col("a_url"), kind, F.col("owner"), F.col("a_sha1"), F.col("a_bytes"))
    part = F.pmod(F.xxhash64("a_id", "a_url"), copies(F.col("records")))
    joined.select("a_sha256", "a_bytes", part.alias("part"), F.encode(header, "UTF-8").alias("header")).write.parquet(f"{folder}/headers")


def copies(records: Column) -> Column:
    """In how many parts the records of one payload are read."""
    return F.ceil(records / PART_RECORDS).cast("int")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: the rebuilt record, the header's fields and the full payload (for revisits too).

    Headers and payloads meet in a join; a payload is checked once, before it, against the digest that is its
    key. A stored payload that differs raises an error, as does a record whose length or SHA-1 isn't what its
    header says. page_id and refers_to have the type that the identifiers were written with.
    """
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    kind = payloads.schema["owner"].dataType
    sound = (F.unhex(F.sha2("payload", 256)) == F.col("a_sha256")) & (F.octet_length("payload") == F.col("a_bytes"))
    checked = payloads.select("a_sha256", "a_bytes", "records", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("damaged payload"))).alias("payload"))
    checked = checked.withColumn("sha1", F.sha1("payload")).withColumn("part", F.explode(F.sequence(F.lit(0), copies(F.col("records")) - 1))).drop("records")
    read = headers.join(checked, ["a_sha256", "a_bytes", "part"]).withColumn("lines", F.decode("header", "UTF-8"))

    def field(name: str) -> Column:
        """A header line's value, or null where there is no such line."""
        return F.when(F.col("lines").contains(CRLF + name + ": "), F.regexp_extract("lines", rf"\r\n{name}: ([^\r]*)\r\n", 1))

    response = field("WARC-Type") == "response"
    rows = read.select(
        as_before(field("X-Page-ID")).cast(kind).alias("page_id"), field("WARC-Type").alias("record_type"), as_before(field("WARC-Target-URI")).alias("url"), as_before(field("X-Refers-To-Page-ID")).cast(kind).alias("refers_to"),
        F.concat("header", F.when(response, F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"), "payload", "sha1", F.col("a_bytes").alias("length"),
        ((F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "") == F.col("sha1")) & (field("X-Payload-Length").cast("long") == F.col("a_bytes"))).alias("agrees"),
    )
    return rows.withColumn("record", F.when(F.col("agrees"), F.col("record")).otherwise(F.raise_error(F.lit("record differs from its header")).cast("binary"))).drop("agrees")


def report(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, a response's from its rebuilt record's block."""
    record = F.col("record")
    # the head of a record has no empty line but its last one, and holds no byte that isn't UTF-8
    head = F.octet_length("record") - F.col("length") - 4
    block = F.when(F.col("record_type") == "response", F.substring(record, head + 1, F.col("length").cast("int"))).otherwise(F.col("payload"))
    return archive.select("page_id", F.octet_length(block).cast("long").alias("payload_bytes"), F.when(F.col("record_type") == "response", F.sha1(block)).otherwise(F.col("sha1")).alias("payload_digest"), "record_type", "refers_to")
