"""What the operators here share: input columns, buckets, bitmaps of keys, packed columns, components."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage

# ASCII letters and digits and all bytes of other characters stay, A-Z in lower case; the rest parts words.
PLAIN_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

FILTER_BITS = 1 << 26

ENCODERS = "_postsieve_encoders"  # what a Python worker keeps its encoders under


BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: batches of the session get ``BATCH_ROWS`` rows at most, which bounds what the
    executors and their Python workers hold at once."""
    now = int(spark.conf.get(_ROWS))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that operators on texts read, the text as its UTF-8 bytes; null texts stay null."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))


def free_name(rows: DataFrame, name: str) -> str:
    """A name that no column of ``rows`` has."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values, some hundred rows at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


class WordHashes(dict):
    """Memo of word hashes; emptied when it is full, so that its memory is bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed_all(x: np.ndarray) -> np.ndarray:
    """Bit mixer of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive word hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for i in range(1, length):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += hashes[i : i + n]
    return mixed_all(total)


# --- a bitmap of keys: a pre-filter of fixed size before a join -----------------------------------------


def key_bitmap(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits in which the slot of every key (LONG) is set: 8 MB by default, whatever
    the number of keys. A key that is not set does not occur; one that is set may."""
    slot = F.pmod(F.col(key), F.lit(bits)) + 1
    rows = (
        keys.where(F.col(key).isNotNull())
        .groupBy(F.bitmap_bucket_number(slot).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for part, found in rows.collect():  # of fixed size, and one job where an iterator would take one per partition
        at = (part - 1) * len(found)
        bitmap[at : at + len(found)] = np.frombuffer(found, np.uint8)
    return bitmap


def may_occur(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of signed or unsigned 64-bit keys: whether their slot is set."""
    slot = keys.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


# --- counts by slot: sums of fixed size -----------------------------------------------------------------

PARTS = 64


def count_rows(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A task's counts (32 bits) in parts, for ``summed``."""
    return list(range(PARTS)), [p.tobytes() for p in np.split(counts.astype(np.uint32), PARTS)]


def summed(rows: DataFrame, slots: int) -> np.ndarray:
    """The sum of the tasks' counts, rows (part INT, counts BINARY). Each part is added up in a task of its own; the
    driver gets ``slots`` numbers."""
    width = slots // PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part, counts in rows_of(batches, "part", "counts"):
            found = np.frombuffer(counts, np.uint32)
            total[part] = total[part] + found if part in total else found.astype(np.int64)
        for part, counts in total.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": [counts.tobytes()]})

    out = np.zeros(slots, np.int64)
    parts = rows.select("part", "counts").repartition(PARTS, "part").mapInArrow(releasing(add), "part int, counts binary")
    for part, counts in parts.collect():
        out[part * width : (part + 1) * width] = np.frombuffer(counts, np.int64)
    return out


# --- components ----------------------------------------------------------------------------------------


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links between LONG ids: ``node``, ``component`` (its smallest id).

    Large-star and small-star rounds: each round hangs neighbours on the smallest id they know until all
    hang on the smallest id of their component. Only minima per node are formed, with map-side combine, and
    joined back, so no node's neighbours meet in one row or task; every round is a written table.
    Links with a null end or from an id to itself are left out.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stage(ends.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u")
        large = stage(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def releasing(run, encodes: bool = False):
    """A function of Arrow batches that, when it has ended, hands the memory it no longer uses back to the system. Workers are
    kept for the next stages, whose own memory comes on top of what an idle one holds. A function that ``encodes`` finds the
    memos of encoders that the tasks before it have filled; any other drops them first."""

    def ended(batches):
        if not encodes:
            sys.modules.pop(ENCODERS, None)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return ended
