"""Archives written and read again, and archives of others."""

import gzip
import hashlib

import pytest
from postsieve.llm import warc
from postsieve.session import new_folder

SCHEMA = "page_id long, url string, html string, payload string, record_type int"
BIG = "é" * 600


def pages():
    rows = [(1, "http://a/", "x" * 1000), (2, None, "x" * 1000), (7, "http://b/\r\nX: y", "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999)]
    rows += [(5, "u", None), (6, "u", ""), (8, "u", BIG), (9, "u", BIG), (9, "u", BIG), (None, "u", BIG), (None, "u", "\r\n\r\nHTTP/1.1\r\n\r\n"), (-3, "u", "z" * 300_000)]
    return [(*r, "other", k) for k, r in enumerate(rows)]


def expected():
    rows = [(p, (h or "").encode()) for p, _, h, *_ in pages()]
    out = []
    for page, body in rows:
        last = max((p for p, b in rows if b == body and p is not None), default=None) if len(body) >= 1000 else None
        revisit = page is not None and last is not None and page < last
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("file_bytes", [1, 1 << 26])
def test_pages_come_back(spark, file_bytes):
    path = new_folder(spark, "warc")
    frame = spark.createDataFrame(pages(), SCHEMA).repartition(2)
    warc.write_archives(warc.page_records(frame), path, file_bytes=str(file_bytes))
    got = sorted((tuple(r) for r in warc.archived_pages(spark, path).collect()), key=repr)
    assert got == expected()
    whole = warc.read_archives(spark, path, split_bytes="100")
    assert sorted(bytes(r.payload).decode() for r in whole.where("record_type = 'response' AND payload_length = 1200").collect()) == [BIG] * 3
    assert whole.where("refers_to = '<urn:page:7>'").count() == 2
    assert whole.where("target_uri IS NULL").count() == 1
    assert whole.where("record_id IN ('<urn:page:3>', '<urn:page:4>') AND payload_length > 5").count() == 2


def test_predicates_reach_the_reader(spark):
    path = new_folder(spark, "warc")
    warc.write_archives(warc.page_records(spark.createDataFrame(pages(), SCHEMA)), path)
    plan = warc.read_archives(spark, path).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")


def test_no_pages(spark):
    path = new_folder(spark, "warc")
    warc.write_archives(warc.page_records(spark.createDataFrame([], SCHEMA)), path)
    assert warc.archived_pages(spark, path).count() == 0


def record(k, payload):
    row = {"record_id": f"<urn:page:{k}>", "record_type": "response", "target_uri": "u", "date": "2020-01-01T00:00:00Z", "payload_digest": hashlib.sha1(payload).hexdigest(), "refers_to": None, "payload_length": None, "payload": payload}
    return warc.record_bytes(row)


class Counting:
    """A file that counts the bytes it gives."""

    def __init__(self, data):
        self.data, self.at, self.given = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        part = self.data[self.at : self.at + n]
        self.at += len(part)
        self.given += len(part)
        return part


@pytest.mark.parametrize("pack", [lambda d: warc.member(d, 1), gzip.compress, lambda d: d])
def test_all_kinds_of_archives(pack):
    payloads = [b"", b"short", b"\r\n\r\n" * 3000, bytes(range(256)) * 2000]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = pack(info) + b"".join(pack(record(k, p)) for k, p in enumerate(payloads))
    rows = list(warc.records(Counting(data), len(data), lambda row: True, True))
    assert [r["payload"] for r in rows] == [b"hello", *payloads]
    assert [r["payload_length"] for r in rows] == [5, *map(len, payloads)]
    assert [r["record_id"] for r in warc.records(Counting(data), len(data), lambda row: row["record_type"] == "warcinfo", True)] == ["<urn:i>"]
    assert [r["payload"] for r in warc.records(Counting(data), len(data), lambda row: True, False)] == [None] * 5


def test_unwanted_payloads_are_not_read():
    import random

    noise = random.Random(0).randbytes(1_000_000)
    data = b"".join(warc.member(record(k, noise), 1) for k in range(5))
    file = Counting(data)
    assert len(list(warc.records(file, len(data), lambda row: True, False))) == 5
    assert file.given < 60_000


@pytest.mark.parametrize("payload", [b"a" * 1_000_000, b"", b"short"])
def test_no_more_is_read_than_there_is(payload):
    data = b"".join(warc.member(record(k, payload), 6) for k in range(50))
    file = Counting(data)
    assert len(list(warc.records(file, len(data), lambda row: False, True))) == 0
    assert file.given <= len(data)
    assert [r["payload"] for r in warc.records(Counting(data), len(data), lambda row: True, True)] == [payload] * 50


def test_long_heads():
    row = {"record_id": "<urn:1>", "record_type": "response", "target_uri": "http://a/" + "é" * 20_000, "date": None, "payload_digest": None, "refers_to": None, "payload_length": None, "payload": b"x" * 10}
    for pack in (lambda d: warc.member(d, 0), gzip.compress, lambda d: d):
        data = pack(warc.record_bytes(row)) * 3
        assert [(r["target_uri"], r["payload"]) for r in warc.records(Counting(data), len(data), lambda row: True, True)] == [(row["target_uri"], b"x" * 10)] * 3
