"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first chunk of every id, level k the
chunk k of those ids that have one. A bitmap per level tells which ids go on to the next, and a rank
directory holds how many do before every 512th: the place of an id's next chunk is the number of ids before
it that go on. So any id is read with one step per level and without decoding a block.

A file holds consecutive documents: their ids, where each begins, and the levels. Documents are in
ascending order of doc_id over all files (name order is file order), and a document never spans two files.

Edge cases: a null text is an empty one; every document has at least its end id. Rows with one doc_id follow
each other in the order of their texts; rows with a null doc_id come first and keep the null. An empty table
makes no file. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_folder, stage
from .common import batch_of, keyed_texts, partitions, releasing, rows_of
from .encoding import END_ID, encoder, vocabulary
from .store import make_folder, write_whole

MAGIC = b"DACTOK01"
HEAD = "<8sQQQQ"  # magic, ids before this file in its partition, documents, ids, levels
RANK_STEP = 512
FILE_IDS = 2_000_000
BATCH = 256

DONE = "part long, file string, base long, n_docs long, n_ids long"
READ = "part long, place long, doc_id long, start long, n_tokens long, ids_crc32 long"


# --- the codes -----------------------------------------------------------------------------------------


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, continuation bitmap and rank directory of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        chunks, rest = (rest & 255).astype(np.uint8), rest >> 8
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // RANK_STEP) * RANK_STEP, bool)
        padded[: len(more)] = more
        ranks = np.cumsum(padded.reshape(-1, RANK_STEP).sum(axis=1)).astype(np.uint32)
        out.append((chunks, bitmap, np.insert(ranks, 0, 0)[:-1] if len(ranks) else ranks))
        if not more.any():
            return out
        rest = rest[more]


def packed(base: int, doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    levels = levels_of(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        struct.pack(HEAD, MAGIC, base, len(doc_ids), len(ids), len(levels)),
        np.array([len(chunks) for chunks, _, _ in levels], "<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), starts.astype("<u8").tobytes(),
    ]
    for chunks, bitmap, ranks in levels:
        parts += [chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u4").tobytes()]
    return parts


class Codes:
    """A file's content. Indexing it reads one id; ``ids(a, b)`` a range of them."""

    def __init__(self, data: bytes):
        magic, self.base, self.n_docs, self.n_ids, n_levels = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a file of token codes")
        self.at = struct.calcsize(HEAD)
        self.data = data
        sizes = self._take("<u8", n_levels)
        self.doc_ids = self._take("<i8", self.n_docs)
        self.known = self._take(np.uint8, self.n_docs).astype(bool)
        self.starts = self._take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for n in sizes.tolist():
            self.levels.append(
                (self._take(np.uint8, n), self._take(np.uint8, -(-n // 8)), self._take("<u4", -(-n // RANK_STEP)))
            )

    def _take(self, kind, n: int) -> np.ndarray:
        found = np.frombuffer(self.data, kind, n, self.at)
        self.at += found.nbytes
        return found

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(k, i)
        return value

    def rank(self, level: int, i: int) -> int:
        """Ids before place ``i`` of the level that go on: the directory's count and less than a step of bits."""
        _, bitmap, ranks = self.levels[level]
        from_bit = i // RANK_STEP * RANK_STEP
        bits = int.from_bytes(bitmap[from_bit >> 3 : (i >> 3) + 1].tobytes(), "little")
        return int(ranks[i // RANK_STEP]) + (bits & (1 << i - from_bit) - 1).bit_count()

    def ids(self, start: int, end: int) -> np.ndarray:
        """A range: on each level the chunks of a range follow each other too."""
        if end <= start:
            return np.empty(0, np.uint32)
        out = np.zeros(end - start, np.uint32)
        place = np.arange(end - start)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[place] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bitmap[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start] > 0
            place = place[more]
            if not len(place):
                break
            start = self.rank(k, start)
            end = start + len(place)
        return out


# --- files ---------------------------------------------------------------------------------------------


def write_codes(
    docs: DataFrame, tokenizer: str, path: str | None = None, file_ids: int = FILE_IDS, end_id: int = END_ID
) -> tuple[str, DataFrame]:
    """Encodes (doc_id, text) and writes the files. Gives back their folder and a table of the files.

    ``tokenizer`` is the path of a vocabulary file. Documents are dealt out by ranges of doc_id; a file closes
    at ``file_ids`` ids, which bounds a task's memory."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "token_codes")
    make_folder(path)
    rules = spark.sparkContext.broadcast(vocabulary(tokenizer))
    schema = pa.schema([(n, pa.string() if n == "file" else pa.int64()) for n in ("part", "file", "base", "n_docs", "n_ids")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, task = encoder(rules.value), TaskContext.get()
        part, end, base, count = task.partitionId(), np.array([end_id], "<u4").tobytes(), 0, 0
        doc_ids, parts, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal base, count, doc_ids, parts, size
            name = f"part-{part:06d}-{count:06d}.dac"
            starts = np.cumsum([0, *(len(p) // 4 for p in parts)])
            ids = np.frombuffer(b"".join(parts), "<u4")
            write_whole(path, name, task.taskAttemptId(), packed(base, doc_ids, starts, ids))
            row = batch_of(schema, [[part], [name], [base], [len(doc_ids)], [len(ids)]])
            base, count, doc_ids, parts, size = base + len(ids), count + 1, [], [], 0
            return row

        for keys, texts in in_groups(rows_of(batches, "doc_id", "text"), BATCH):
            for key, ids in zip(keys, encoded.encode(texts), strict=True):
                doc_ids.append(key)
                parts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= file_ids:
                    yield close()
        if doc_ids:
            yield close()

    dealt = keyed_texts(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return path, stage(dealt.mapInArrow(releasing(write, encodes=True), DONE))


def in_groups(rows: Iterator[tuple[int | None, bytes | None]], size: int) -> Iterator[tuple[list, list[str]]]:
    keys, texts = [], []
    for key, text in rows:
        keys.append(key)
        texts.append((text or b"").decode("utf-8"))
        if len(keys) == size:
            yield keys, texts
            keys, texts = [], []
    if keys:
        yield keys, texts


def read_codes(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``files`` gives the ids per partition; the driver sums them up, one number for each partition of the writer."""
    schema = pa.schema([(n.split()[0], pa.int64()) for n in READ.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content in rows_of(batches, "path", "content"):
            codes = Codes(content)
            ids = codes.ids(0, len(codes)).astype("<u4").tobytes()
            starts = codes.starts.tolist()
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, starts[1:], strict=False)]
            part = int(name.rsplit("/part-", 1)[1].split("-")[0])
            n = codes.n_docs
            doc_ids = pa.array(codes.doc_ids, mask=~codes.known)
            yield batch_of(schema, [np.full(n, part), np.arange(n), doc_ids, codes.starts[:-1] + codes.base, np.diff(codes.starts), crcs])

    totals = dict(files.groupBy("part").agg(F.sum("n_ids")).collect())
    before, base = {}, 0
    for part in sorted(totals):
        before[part], base = base, base + totals[part]
    bases = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "part long, before long")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(path).select("path", "content")
    rows = content.mapInArrow(read, READ)
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
