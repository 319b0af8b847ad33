"""WARC archive: round trip, digests, and odd rows."""

import base64
import hashlib

import pytest

from millrace.llm import warc_archive
from millrace.llm.queries import ORACLE_SQL, op1_warc_archive
from tests.oracle import same

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, sha256 string, _key string"


def told(spark, rows, **kw):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    archive = warc_archive.write(pages, **kw)
    return archive, warc_archive.describe(warc_archive.read(archive)).collect()


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_query_equals_sql(spark):
    same(spark, SF, op1_warc_archive, ORACLE_SQL["op1_warc_archive"])


def test_equal_payloads_are_stored_once(spark):
    rows = [(3, "u", "same é"), (1, None, "same é"), (2, "a\r\nb", None), (5, "", ""), (4, "u", "other"), (None, "u", "same é"), (7, "u", "x" * 300_000)]
    archive, found = told(spark, rows)
    got = {r["record_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_id"]) for r in found}
    assert got["1"] == (7, digest("same é"), "response", None)
    assert got["3"] == (7, digest("same é"), "revisit", "1")
    assert got["2"] == (0, digest(""), "response", None) and got["5"] == (0, digest(""), "revisit", "2")
    assert got["4"][2] == "response" and got["7"][0] == 300_000
    assert got[None] == (7, digest("same é"), "revisit", "1")
    assert archive.payloads.count() == 4 and archive.headers.count() == len(rows)


def test_records_come_back_byte_for_byte(spark):
    archive, _ = told(spark, [(1, "http://x/", "body"), (2, "http://y/", "body")])
    records = {r["record_id"]: bytes(r["record"]) for r in warc_archive.read(archive).collect()}
    head, http, rest = records["1"].split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI: http://x/" in head
    assert f"Content-Length: {len(http) + 4 + 4}".encode() in head and rest == b"body\r\n\r\n"
    assert records["2"].endswith(b"charset=utf-8\r\n\r\n\r\n\r\n") and b"WARC-Refers-To: <urn:x-page:1>" in records["2"]
    stored = {r["record_id"]: bytes(r["warc_header"]) for r in archive.headers.collect()}
    assert all(records[k].startswith(h) for k, h in stored.items())


def test_small_payloads_stay_responses(spark):
    _, found = told(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], min_bytes=3)
    assert {r["record_id"]: r["record_type"] for r in found} == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_damage_and_loss_are_noticed(spark):
    archive, _ = told(spark, [(1, "u", "one"), (2, "u", "two")])
    from pyspark.sql import functions as F

    for bad in (archive.payloads.withColumn("payload", F.lit(b"zero")), archive.payloads.limit(1)):
        with pytest.raises(Exception, match="missing or damaged"):
            warc_archive.read(warc_archive.Archive(archive.headers, bad)).collect()


def test_repeated_rows_and_empty_table(spark):
    _, found = told(spark, [(1, "u", "x"), (1, "u", "x"), (2, "u", "x")])
    assert sorted(r["record_type"] for r in found) == ["response", "response", "revisit"]
    assert told(spark, [])[1] == []


def test_warc_files_round_trip(spark, tmp_path):
    archive, _ = told(spark, [(1, "http://x/", "WARC/1.1\r\n\r\n\r\n\r\nnot a record é"), (2, None, ""), (3, "http://y/", None), (4, "u", "line\n" * 9)])
    records = warc_archive.read(archive)
    warc_archive.write_files(records, str(tmp_path / "warc"), per_file=2)
    got = {bytes(r["warc_header"]) + bytes(r["block"]) + b"\r\n\r\n" for r in warc_archive.read_files(spark, str(tmp_path / "warc")).collect()}
    assert got == {bytes(r["record"]) for r in records.collect()} and len(got) == 4


def test_records_are_described_from_their_bytes(spark):
    """A record that was cut, or whose payload changed, is noticed; so is a
    payload of many records, joined in parts."""
    from pyspark.sql import functions as F

    rows = [(i, f"http://é/{i}", "much the same") for i in range(40)] + [(100, "u", "\r\n\r\nodd é\r\n\r\n"), (101, None, None)]
    archive, found = told(spark, rows)
    assert {r["record_id"] for r in found if r["refers_to_id"] == "0"} == {str(i) for i in range(1, 40)}
    assert {r["record_id"]: r["payload_bytes"] for r in found}["100"] == 14 and len(found) == 42
    records = warc_archive.read(archive)
    for bad in (F.expr("substring(record, 1, octet_length(record) - 5)"), F.expr("cast(replace(cast(record as string), 'much', 'such') as binary)")):
        with pytest.raises(Exception, match="differs from its header"):
            warc_archive.describe(records.withColumn("record", bad)).collect()


def test_hot_payloads_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(warc_archive, "PART", 7)
    monkeypatch.setattr(warc_archive, "HOT", 4)
    rows = [(i, "u", "hot") for i in range(60)] + [(i, "u", f"own {i // 2}") for i in range(60, 90)]
    archive, found = told(spark, rows)
    got = {int(r["record_id"]): (r["record_type"], r["refers_to_id"]) for r in found}
    assert got == {i: ("response", None) if i == 0 or i >= 60 and i % 2 == 0 else ("revisit", "0" if i < 60 else str(i - 1)) for i in range(90)}
    assert sorted(r["copies"] for r in archive.payloads.collect()) == [2] * 15 + [60]
