"""Content-addressed WARC archive.

A payload is stored once, under its SHA-256; every record keeps its exact WARC
and HTTP header bytes in a table of its own. Joining the two gives back the
original records byte for byte; the digest is verified on every read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import store

#: Records of one payload that are joined with it in one task.
PART = 10_000
#: A payload is hot that over one in so many records have.
HOT = 1000
CRLF = "\r\n"
HTTP_HEADER = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"


@dataclass(frozen=True)
class Archive:
    """``headers``: record_id, warc_header, http_header, sha256, has_payload,
    copies. ``payloads``: sha256, payload, copies. ``copies`` is the number of
    records that have the payload."""

    headers: DataFrame
    payloads: DataFrame


def base32(hexed: Column) -> Column:
    """RFC 4648 base32 of 40 hex digits: forty bits are eight characters."""
    part = lambda i: F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """Store a WARC record per row.

    Of the records whose payloads are equal and of ``min_bytes`` bytes or
    more, that with the smallest id is a response and the others revisit it;
    smaller payloads all stay responses. A null payload is empty; a null id
    sorts after all others (a group of null ids only: all responses, like
    repeated rows of the smallest id); a null URL leaves its header line out,
    and line breaks in a URL are percent-encoded. Other columns are ignored;
    an empty table gives an empty archive.

    Only ids and digests are shuffled to find the first record of a payload
    (map-side combined, so a hot payload is one row a task); payloads are
    shuffled after each task has dropped its own repeats. The first records of
    hot payloads, fewer than HOT, are broadcast to the others.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload")).withColumn("_sha256", F.unhex(F.sha2("_payload", 256)))
    found = store(rows.select("_id", "_url", "_sha256", F.sha1("_payload").alias("_sha1"), F.octet_length("_payload").cast("long").alias("_bytes")), "warc-digests")
    payloads = store(rows.groupBy("_sha256").agg(F.first("_payload").alias("payload"), F.count("*").alias("copies")).select(F.col("_sha256").alias("sha256"), "payload", "copies"), "warc-payloads")

    first = store(found.groupBy(F.col("_sha256").alias("_same")).agg(F.min("_id").alias("_first"), F.count("*").alias("copies")), "warc-first")
    total = first.agg(F.sum("copies")).first()[0] or 0
    hot, same = F.col("copies") * HOT > total, F.col("_sha256") == F.col("_same")
    few = F.broadcast(first.where(hot))
    rest = found.join(few.select("_same"), same, "left_anti").join(first.where(~hot), same)
    told = found.join(few, same).unionByName(rest).withColumn("_key", F.when(F.col("_bytes") >= min_bytes, F.col("_same")))
    revisit = F.col("_key").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    named = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    url = F.replace(F.replace(F.col("_url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.lit(len(HTTP_HEADER)) + F.when(revisit, 0).otherwise(F.col("_bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", named(F.col("_id"))), line("WARC-Date", F.lit(date)),
        F.when(F.col("_url").isNull(), "").otherwise(line("WARC-Target-URI", url)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("_sha1")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", named(F.col("_first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit(CRLF),
    )
    headers = told.select(F.col("_id").cast("string").alias("record_id"), header.cast("binary").alias("warc_header"), F.lit(HTTP_HEADER.encode()).alias("http_header"), F.col("_sha256").alias("sha256"), (~revisit).alias("has_payload"), "copies")
    return Archive(store(headers, "warc-headers"), payloads)


def read(archive: Archive) -> DataFrame:
    """``record_id, record, warc_header, payload`` per stored record.

    ``record`` holds the record's exact bytes (a revisit without its payload),
    ``payload`` the full payload, of revisits too. A payload that is missing
    or does not have its digest ends the query with an error.
    """
    # a payload of many records meets a part of them in each task
    parts = F.ceil(F.col("copies") / PART)
    store_ = archive.payloads.select(F.col("sha256").alias("_key"), F.col("payload").alias("_payload"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_at"))
    headers = archive.headers.withColumn("_part", F.pmod(F.xxhash64("record_id", "warc_header"), parts))
    joined = headers.join(store_, (F.col("sha256") == F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    sound = F.coalesce(F.unhex(F.sha2("_payload", 256)) == F.col("sha256"), F.lit(False))
    joined = joined.withColumn("payload", F.when(sound, F.col("_payload")).otherwise(F.raise_error(F.concat(F.lit("payload missing or damaged: "), F.hex("sha256"))).cast("binary")))
    body = F.when(F.col("has_payload"), F.col("payload")).otherwise(F.lit(b""))
    return joined.select("record_id", F.concat("warc_header", "http_header", body, F.lit((CRLF * 2).encode())).alias("record"), "warc_header", "payload")


def describe(records: DataFrame) -> DataFrame:
    """What :func:`read` gave, told from the records' bytes alone:
    ``record_id, payload_bytes, payload_digest, record_type, refers_to_id``.

    A record is taken apart into header, block and end; its length and its
    payload's digest must be what the header says. Only of a revisit, whose
    record has no payload, the joined one counts.
    """
    end = CRLF * 2
    head = F.substring_index(F.col("record").cast("string"), end, 1)
    rows = records.select("record", "payload", F.concat(head, F.lit(end)).alias("_head"))
    at = F.octet_length("_head")
    rows = rows.select("payload", "_head", F.substring("record", at + 1, F.octet_length("record") - at - len(end)).alias("_block"), F.col("record").cast("string").endswith(end).alias("_ended"))
    rows = rows.withColumn("_http", F.concat(F.substring_index(F.col("_block").cast("string"), end, 1), F.lit(end)))
    field = lambda pattern: F.nullif(F.regexp_extract("_head", rf"\r\n{pattern}\r\n", 1), F.lit(""))
    kind = field(r"WARC-Type: (\w+)")
    body = F.substring("_block", F.octet_length("_http") + 1, F.octet_length("_block"))
    rows = rows.withColumn("_body", F.when(kind == "revisit", F.col("payload")).otherwise(body))
    whole = F.col("_ended") & (field(r"Content-Length: ([0-9]+)").cast("long") == F.octet_length("_block"))
    digest = base32(F.sha1("_body"))
    told = field(r"WARC-Payload-Digest: sha1:([A-Z2-7]+)")
    return rows.select(
        field(r"WARC-Record-ID: <urn:x-page:([^>]*)>").alias("record_id"),
        F.octet_length("_body").cast("long").alias("payload_bytes"),
        F.when(whole & (told == digest), digest).otherwise(F.raise_error(F.lit("record's length or payload digest differs from its header's"))).alias("payload_digest"),
        kind.alias("record_type"),
        field(r"WARC-Refers-To: <urn:x-page:([^>]*)>").alias("refers_to_id"),
    )


def write_files(records: DataFrame, path: str, per_file: int = 20_000) -> None:
    """WARC files of :func:`read`'s records, compressed, at most ``per_file``
    records each; for payloads that are UTF-8, as those of :func:`write` are.
    A record ends with two line breaks, which stand in as the line separator."""
    end = CRLF * 2
    text = F.col("record").cast("string")
    rows = records.select(F.substring(text, F.lit(1), F.length(text) - len(end)).alias("value"))
    rows.write.option("lineSep", end).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def parse(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """``warc_header, block`` of each record of a WARC file, also of one that
    is compressed in any number of members."""
    while content[:2] == b"\x1f\x8b":
        plain, rest = [], content
        while rest:
            member = zlib.decompressobj(31)
            plain.append(member.decompress(rest) + member.flush())
            rest = member.unused_data
        content = b"".join(plain)
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at) + 4
        header = content[at:stop]
        length = next(int(line.split(b":", 1)[1]) for line in header.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        yield header, content[stop : stop + length]
        at = stop + length + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``warc_header, block`` of every record in the WARC files under
    ``path``; a task holds one file at a time."""

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                found = list(parse(content))
                for i in range(0, len(found), 1000):
                    yield pd.DataFrame(found[i : i + 1000], columns=["warc_header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(records, "warc_header binary, block binary")
