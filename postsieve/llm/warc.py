"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Archives are WARC/1.1, each record a gzip member of its own. A member's extra field (``SL``) holds its packed
length, so a reader can go to the next record without inflating this one. The reader plans whole files into
tasks of about ``split_bytes``; it inflates the head of a record first, tests the pushed predicates on its
headers, and only then, and only if payloads are asked for (option ``payload``), inflates the rest. Archives
of others, without that field or without compression, are read as well.

Tests that are pushed: ``=``, ``IN`` and IS [NOT] NULL on every column but payload and payload_length.

Identical payloads are found by length and SHA-1. The counting step sends one row per digest and task, and only
digests that repeat are joined back, so a payload of a third of all pages is no burden to any task.

Edge cases: a null html is an empty payload. A null url gives a record without target. Pages with a null
page_id are responses and keep the null; they are nobody's revisit target. Rows that repeat the largest page_id of
a payload are all responses. An empty table makes no archive, and a folder without archives reads as empty.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage,
)

from .store import make_folder, opened

MIN_REVISIT = 1000
SPLIT_BYTES = 64 << 20
FILE_BYTES = 64 << 20
HEAD_BYTES = 1024
READ_BYTES = 1 << 16
BATCH_BYTES = 4 << 20

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_length", T.LongType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in RECORD])

# Field names and the profile of the WARC 1.1 standard.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records -------------------------------------------------------------------------------------------


def record_bytes(row: dict) -> bytes:
    """A record: WARC headers, HTTP head and, unless it is a revisit, the payload."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if row["record_type"] != "revisit":
        block += payload
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        value = row[column]
        if value is not None:
            if column == "payload_digest":
                value = "sha1:" + base64.b32encode(bytes.fromhex(value)).decode()
            lines.append(f"{header}: " + value.replace("\r", "%0D").replace("\n", "%0A"))
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field has its packed and plain length (0: too long for the field)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 24 + len(body) + 8
    sizes = (total, len(data)) if max(total, len(data)) < 1 << 32 else (0, 0)
    head = struct.pack("<4BI2BH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"SL", 8, *sizes)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parsed(head: bytes | bytearray) -> tuple[dict, int, int, int] | None:
    """The columns of a record by its head, where its block begins, the block's length, and where its payload
    begins; None if the head is not complete."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in head[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    row = {column: fields.get(header.lower()) for column, header in HEADERS.items()}
    block, size = end + 4, int(fields.get("content-length", 0))
    start = block
    row["payload_length"] = size
    if fields.get("content-type", "").startswith("application/http") and size:
        http = head.find(b"\r\n\r\n", block)
        if http < 0 and len(head) < block + size:
            return None
        if 0 <= http < block + size:
            start = http + 4
            row["payload_length"] = size - (start - block)
            if row["record_type"] == "revisit":
                for line in head[block:http].split(b"\r\n"):
                    name, _, value = line.partition(b":")
                    if name.strip().lower() == b"content-length":
                        row["payload_length"] = int(value)
    digest = row["payload_digest"] or ""
    if digest.startswith("sha1:") and len(digest) == 37:
        row["payload_digest"] = base64.b32decode(digest[5:]).hex()
    return row, block, size, start


class Inflated:
    """A gzip member, read and inflated only as far as it is asked for. ``first`` are the archive's bytes from the
    member on, as far as they are read."""

    def __init__(self, file, position: int, first: bytes):
        self.next = None
        if first[3:4] == b"\x04" and first[12:14] == b"SL":
            total = struct.unpack_from("<I", first, 16)[0]
            self.next = position + total if total else None
            first = first[:total] if total else first
        self.file, self.read, self.waiting = file, position + len(first), first
        self.inflate, self.data = zlib.decompressobj(31), bytearray()

    def grow(self, step: int) -> bool:
        """More of the plain bytes, from at most ``step`` further packed ones; False at the member's end."""
        if self.inflate.eof:
            return False
        if not self.waiting:
            left = step if self.next is None else min(step, self.next - self.read)
            self.file.seek(self.read)
            self.waiting = self.file.read(left) if left > 0 else b""
            self.read += len(self.waiting)
            if not self.waiting:
                return False
        self.data += self.inflate.decompress(self.waiting, 16 * step)
        self.waiting = self.inflate.unconsumed_tail
        return True

    def upto(self, size: int) -> bytearray:
        while len(self.data) < size and self.grow(READ_BYTES):
            pass
        return self.data

    def end(self) -> int:
        """Where the next member begins."""
        if self.next is None:
            while self.grow(READ_BYTES):
                self.data.clear()
            self.next = self.read - len(self.inflate.unused_data)
        return self.next


class Plain:
    """A record of an archive without compression."""

    def __init__(self, file, position: int, first: bytes):
        self.file, self.position, self.data = file, position, bytearray(first)

    def grow(self, step: int) -> bool:
        self.file.seek(self.position + len(self.data))
        more = self.file.read(step)
        self.data += more
        return bool(more)

    def upto(self, size: int) -> bytearray:
        if len(self.data) < size:
            self.grow(size - len(self.data))
        return self.data


def records(file, size: int, wanted, payloads: bool) -> Iterator[dict]:
    """The records of an archive whose headers pass ``wanted``. What is read of a record before it is known to
    be wanted is its head and at most as much again, and no byte beyond a member of known length."""
    position, first, begin = 0, b"", 0
    while position < size:
        first = first[position - begin :]  # short records lie in what has been read already
        if len(first) < HEAD_BYTES // 2:
            file.seek(position + len(first))
            first += file.read(HEAD_BYTES)
        begin = position
        packed = first[:2] == b"\x1f\x8b"
        source = (Inflated if packed else Plain)(file, position, first)
        step = HEAD_BYTES
        while (found := parsed(source.data)) is None and source.grow(step):
            step = min(2 * step, READ_BYTES)
        if found is None:
            return  # trailing bytes that are no record
        row, block, length, start = found
        row["payload"] = None
        if wanted(row) and row["record_id"] is not None:
            if payloads and row["record_type"] != "revisit":
                row["payload"] = bytes(source.upto(block + length)[start : block + length])
            yield row
        position = source.end() if packed else position + block + length + 4


# --- the data source -----------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    files: tuple

    def __init__(self, files: Sequence[tuple[str, int]]):
        super().__init__(tuple(files))
        self.files = tuple(files)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.payloads = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((column, type(f).__name__, ()))
            else:
                yield f

    def passes(self, row: dict) -> bool:
        for column, test, values in self.tests:
            value = row[column]
            if not (value is None if test == "IsNull" else value is not None and (test == "IsNotNull" or value in values)):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = opened(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = [(f.path, f.size) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and f.base_name[0] not in "._"]
        parts, held, total = [], [], 0
        for file in sorted(files):
            if held and total + file[1] > self.split_bytes:
                parts.append(Files(held))
                held, total = [], 0
            held.append(file)
            total += file[1]
        return parts + [Files(held)] if held or not parts else parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        held, total = [], 0
        for path, size in partition.files:
            with store.open_input_file(path) as file:
                for row in records(file, size, self.passes, self.payloads):
                    held.append(row)
                    total += 256 + len(row["payload"] or b"")
                    if total >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, ARROW)
                        held, total = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write drafts; the driver gives them their names when all tasks are done."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.level = int(options.get("level", 4))
        self.job = uuid.uuid4().hex
        make_folder(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, path = opened(self.path)
        task, files, out = TaskContext.get(), [], None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= self.file_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():06d}-{len(files):06d}.warc.gz"
                        files.append((f"{path}/.{self.job}-{task.taskAttemptId()}-{name}", f"{path}/{self.job[:8]}-{name}"))
                        out = store.open_output_stream(files[-1][0], compression=None)
                    out.write(member(record_bytes(row), self.level))
        finally:
            if out is not None:
                out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for message in messages:
            for draft, final in message.files if message else ():
                store.move(draft, final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for message in messages:
            for draft, _final in message.files if message else ():
                store.delete_file(draft)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return RECORD

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_archives(spark: SparkSession, path: str, payload: bool = True, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(payload=str(payload).lower(), **options).load(path)


def write_archives(rows: DataFrame, path: str, **options: str) -> None:
    """``rows``: the columns of ``RECORD``."""
    register(rows.sparkSession)
    make_folder(path)
    rows.select([F.col(f.name).cast(f.dataType) for f in RECORD]).write.format("warc").options(**options).mode("append").save(path)


# --- pages ---------------------------------------------------------------------------------------------


def urn(page_id) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def page_of(name: str) -> Column:
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def page_records(pages: DataFrame, min_bytes: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record per row of ``pages`` (page_id, url, html). Of equal payloads of ``min_bytes`` bytes or more the one
    with the largest page_id is the response and the others revisit it; all else is a response."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    key = ["payload_length", "payload_digest"]
    same = rows.where(F.col("payload_length") >= min_bytes).groupBy(key).agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    rows = rows.join(same.where("n > 1").drop("n"), key, "left")
    revisit = F.col("page_id") < F.col("last")
    return rows.select(
        F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), "payload_digest", "payload_length",
        F.when(revisit, urn(F.col("last"))).alias("refers_to"), F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
    )


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to. Length and digest
    of responses are worked out from the payload that was read; revisits are read by their headers alone."""
    whole = read_archives(spark, path).where(F.col("record_type") == "response")
    heads = read_archives(spark, path, payload=False).where(F.col("record_type") == "revisit")

    def columns(rows: DataFrame, length, digest) -> DataFrame:
        return rows.select(
            page_of("record_id").alias("page_id"), length.alias("payload_bytes"), digest.alias("payload_digest"),
            "record_type", page_of("refers_to").alias("refers_to"),
        )

    read = columns(whole, F.octet_length("payload").cast("long"), F.sha1("payload"))
    return read.unionByName(columns(heads, F.col("payload_length"), F.col("payload_digest")))
