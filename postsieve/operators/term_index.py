"""Term lists of any length against texts (J4), with work that does not grow with terms times texts.

The list is measured first. Up to ``literal_bytes`` its terms are literals of one expression in the JVM. Up to
``automaton_bytes`` they are sent to the executors as one automaton that reads a text once, whatever the number of
terms. Beyond that the terms stay a table: nothing of them passes the driver but a bitmap of fixed size.

The gram index: every term is keyed by one gram of ``GRAM`` bytes (the whole term, if shorter), the one that the fewest
texts hold by a count of fixed size over all texts. A text sends those of its distinct grams whose slot in the bitmap of
keys is set; what meets a term by its key is a candidate, and candidates are verified with ``contains``. Texts are
looked at once each, however often they occur, and hot texts and hot keys are dealt out. Pairs of text and term exist
only for terms whose rarest gram the text holds.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.match import contains_any
from ..session import stage
from ..shipping import ship_by_value
from .skew import hot_keys, spread_join

ship_by_value(__name__)

LITERAL_BYTES = 1 << 12
AUTOMATON_BYTES = 4 << 20
GRAM = 8
BITMAP_BITS = 1 << 26
SLOTS = 1 << 20
PARTS = 64


def listed_terms(terms: DataFrame, term: str) -> DataFrame:
    return terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct()


def rows_with_terms(
    rows: DataFrame,
    terms: DataFrame,
    text: str,
    how: str,
    term: str = "term",
    literal_bytes: int = LITERAL_BYTES,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Rows with none (``left_anti``) or any (``left_semi``) of the terms in their text. Null texts have none; null and
    empty terms are left out."""
    listed = listed_terms(terms, term)
    total = listed.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if total <= literal_bytes:
        hit = contains_any(text, [r.term for r in listed.orderBy("term").collect()])
        return rows.where(~hit if how == "left_anti" else hit)
    if total <= automaton_bytes and importlib.util.find_spec("ahocorasick"):
        hit = automaton_hits([r.term for r in listed.collect()], rows)(F.col(text))
        return rows.where(~hit if how == "left_anti" else hit)
    return by_gram_index(rows, stage(listed), text, how)


def automaton_hits(terms: list[str], rows: DataFrame):
    """A function of a text column: whether one of the terms occurs."""
    sent = rows.sparkSession.sparkContext.broadcast(terms)

    @F.arrow_udf("boolean")
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from ahocorasick import Automaton

        automaton = Automaton()
        for word in sent.value:
            automaton.add_word(word, True)
        automaton.make_automaton()
        for texts in batches:
            yield pa.array([t is not None and next(automaton.iter(t), None) is not None for t in texts.to_pylist()], pa.bool_())

    return hits


# --- the gram index ------------------------------------------------------------------------------------


def gram_hashes(data: bytes, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` bytes, in order."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    letters = np.frombuffer(data, np.uint8)
    total = np.full(n, length, np.uint64)
    for k in range(length):
        total = total << np.uint64(8) | letters[k : k + n].astype(np.uint64) if length <= 7 else (
            total * np.uint64(0x100000001B3) ^ letters[k : k + n].astype(np.uint64)
        )
    x = (total ^ total >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def gram_counts(texts: DataFrame, lengths: list[int], slots: int) -> np.ndarray:
    """Per slot of gram hashes the number of texts that have it. Tasks send parts that are added up in tasks of their
    own; the driver gets ``slots`` numbers."""
    width = slots // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        for batch in batches:
            for data in batch.column("text"):
                data = data.as_py()
                for length in lengths:
                    counts[np.unique(gram_hashes(data, length) & np.uint64(slots - 1)).astype(np.int64)] += 1
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "counts": [p.tobytes() for p in np.split(counts, PARTS)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                totals[part] = totals.get(part, np.zeros(width, np.int64)) + np.frombuffer(counts, np.uint32)
        for part, total in totals.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": [total.tobytes()]})

    ddl = "part int, counts binary"
    out = np.zeros(slots, np.int64)
    for part, total in texts.mapInArrow(count, ddl).repartition(PARTS, "part").mapInArrow(add, ddl).collect():
        out[part * width : (part + 1) * width] = np.frombuffer(total, np.int64)
    return out


def keyed_terms(listed: DataFrame, counts: np.ndarray, gram: int) -> DataFrame:
    """term and the hash of its gram that the fewest texts have."""
    sent = listed.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("key", pa.int64()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            keys = []
            for word in batch.column("term").to_pylist():
                data = word.encode()
                hashes = gram_hashes(data, min(gram, len(data)))
                keys.append(hashes[np.argmin(counts[(hashes & np.uint64(len(counts) - 1)).astype(np.int64)])])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column("term")], schema=schema)

    return listed.mapInArrow(run, "key long, term string")


def key_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits that are set at the slots of all keys; 8 MB by default, whatever their number."""
    slot = F.pmod(F.col("key"), F.lit(bits)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for part, found in parts.collect():
        out[(part - 1) * len(found) : part * len(found)] = np.frombuffer(found, np.uint8)
    return out


def text_keys(texts: DataFrame, bitmap: np.ndarray, lengths: list[int]) -> DataFrame:
    """digest and the keys that the text may have, each once."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("digest", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        last = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            for digest, data in zip(batch.column("digest").to_pylist(), batch.column("text"), strict=True):
                hashes = np.unique(np.concatenate([gram_hashes(data.as_py(), length) for length in lengths]))
                slot = hashes & last
                found = hashes[bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), digest)), pa.array(found.view(np.int64))], schema=schema)

    return texts.mapInArrow(run, "digest long, key long")


def by_gram_index(
    rows: DataFrame, listed: DataFrame, text: str, how: str, gram: int = GRAM, slots: int = SLOTS, bits: int = BITMAP_BITS
) -> DataFrame:
    """The same for a table of distinct terms of any size."""
    texts = rows.select(F.xxhash64(text).alias("digest"), F.col(text).cast("binary").alias("text")).where("text IS NOT NULL")
    texts = stage(texts.dropDuplicates(["digest", "text"]))
    found = listed.select(F.least(F.octet_length("term"), F.lit(gram)).alias("n")).distinct().collect()  # ``gram`` numbers at most
    lengths = sorted(r.n for r in found)
    if not lengths:
        return rows if how == "left_anti" else rows.where(F.lit(False))
    terms = stage(keyed_terms(listed, gram_counts(texts.select("text"), lengths, slots), gram))
    keys = text_keys(texts, key_bitmap(terms.select("key"), bits), lengths)
    pairs = spread_join(keys, terms, ["key"], "inner", ["digest"], hot_keys(keys, ["key"]))
    pairs = stage(pairs.select(F.col("digest").alias("candidate"), "term"))
    whole = texts.join(pairs, F.col("digest") == F.col("candidate"))
    hits = whole.where(F.contains(F.col("text"), F.col("term").cast("binary"))).select("digest", "text").distinct()
    hits = stage(hits.select(F.col("digest").alias("_digest"), F.sha2("text", 256).alias("_sha")))
    dealt = rows.withColumns({"_digest": F.xxhash64(text), "_sha": F.sha2(F.col(text).cast("binary"), 256)})
    kept = spread_join(dealt, hits, ["_digest", "_sha"], how, [text], hot_keys(dealt, ["_digest"]), hot_on=["_digest"])
    return kept.drop("_digest", "_sha").select(*rows.columns)
