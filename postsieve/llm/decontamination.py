"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by document: a task turns its documents into shards of some megabytes, each with the
list of its terms, the ascending positions of each term, and the place of each document. Positions run
through the documents of a shard with one left out between two, so that no phrase crosses a border.
Nothing is shuffled, a hot source or term only makes a list longer inside its shard, and a lost task is made
again from its own input. A search takes the shards one by one. Of a phrase it starts from the positions
of the rarest term, moves those of the other terms by their offset in the phrase and intersects, rarest
first, until nothing is left.

Terms are the runs of ASCII letters, digits and non-ASCII characters; A-Z count as a-z.

Edge cases: a null or empty text is a document without words. Items (or phrases) with null id, null text or
no word are searched for nowhere. Rows that repeat, also with one id, are judged row by row. Empty tables give
empty results; other columns of the inputs are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import new_folder
from .common import PLAIN_WORDS, batch_of, keyed_texts, releasing, rows_of

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20

SHARD = "shard long, doc_ids binary, absent binary, lengths binary, terms binary, counts binary, steps binary"
MATCH = "shard long, place long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"
SHARD_COLUMNS = [c.split()[0] for c in SHARD.split(", ")]
FOUND = "item_id long, doc_id long, start long, end long"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN_WORDS).split() if text else []


def numbers() -> defaultdict[bytes, int]:
    """Numbers words in the order in which they are first asked for."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    return number


# --- the index -----------------------------------------------------------------------------------------


class Shard:
    """Postings of some documents. ``postings(t)`` are the ascending positions of term number ``t``."""

    def __init__(self, doc_ids, absent, lengths, terms, counts, steps):
        self.doc_ids, self.absent, self.lengths = doc_ids, absent, lengths
        self.terms, self.counts, self.steps = terms, counts, steps
        self.ends = np.cumsum(counts)
        self.positions = np.cumsum(steps, dtype=np.uint32)  # steps between positions wrap at each new term
        self.starts = np.cumsum(lengths + 1) - lengths - 1

    @classmethod
    def of(cls, docs: list[tuple[int | None, np.ndarray]], number: dict[bytes, int]) -> Shard:
        """``docs``: the words of each document, as numbers."""
        lengths = np.array([len(words) for _, words in docs], np.int64)
        terms = np.concatenate([words for _, words in docs])
        counts = np.bincount(terms, minlength=len(number)).astype(np.int64)
        order = np.argsort(terms, kind="stable")
        positions = (order + np.repeat(np.arange(len(docs)), lengths)[order]).astype(np.uint32)
        ids = np.array([0 if i is None else i for i, _ in docs], np.int64)
        absent = np.array([i is None for i, _ in docs], bool)
        return cls(ids, absent, lengths, list(number), counts, np.diff(positions, prepend=np.uint32(0)))

    def packed(self) -> list[bytes]:
        parts = [x.tobytes() for x in (self.doc_ids, self.absent, self.lengths)]
        return [*parts, b" ".join(self.terms), self.counts.tobytes(), self.steps.tobytes()]

    @classmethod
    def unpacked(cls, doc_ids, absent, lengths, terms, counts, steps) -> Shard:
        whole = np.frombuffer
        return cls(
            whole(doc_ids, np.int64), whole(absent, bool), whole(lengths, np.int64), terms.split(),
            whole(counts, np.int64), whole(steps, np.uint32),
        )

    def postings(self, term: int) -> np.ndarray:
        end = self.ends[term]
        return self.positions[end - self.counts[term] : end].astype(np.int64)

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions at which the terms follow each other."""
        order = np.argsort(self.counts[terms], kind="stable")
        at = self.postings(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                break
            there = self.postings(terms[k])
            place = np.searchsorted(there, at + k)
            at = at[there[np.minimum(place, len(there) - 1)] == at + k]
        return at

    def near(self, terms: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """The tightest spans (start, end) of at most ``within`` words that hold all terms in any order."""
        terms = np.unique(terms)
        lists = [self.postings(t) for t in terms]
        at = np.unique(np.concatenate(lists))
        first = np.full(len(at), np.iinfo(np.int64).max)
        for one in lists:
            place = np.searchsorted(one, at, side="right") - 1
            first = np.minimum(first, np.where(place >= 0, one[np.maximum(place, 0)], -within - 1))
        good = (first >= 0) & (at - first < within) & (self.doc(first) == self.doc(at))
        first, at = first[good], at[good]
        tight = np.diff(first, prepend=-1) > 0  # of the spans that begin alike the shortest
        return first[tight], at[tight] + 1

    def doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard; a document is never cut, so a shard is as large as its last document makes it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, size = [], numbers(), 0
        schema = pa.schema([(n, pa.binary()) for n in ("doc_ids", "absent", "lengths", "terms", "counts", "steps")])
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            words = words_of(text)
            held.append((doc_id, np.fromiter(map(number.__getitem__, words), np.int32, len(words))))
            size += len(text or b"") + 64
            if size >= shard_bytes:
                yield batch_of(schema, [[x] for x in Shard.of(held, number).packed()])
                held, number, size = [], numbers(), 0
        if held:
            yield batch_of(schema, [[x] for x in Shard.of(held, number).packed()])

    return keyed_texts(docs).mapInArrow(releasing(build), SHARD.removeprefix("shard long, "))


def write_index(docs: DataFrame, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the index of ``docs`` (doc_id, text) as a table and gives back the table."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "phrase_index")
    rows = shards(docs, shard_bytes).withColumn("shard", F.monotonically_increasing_id()).select(*SHARD_COLUMNS)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


# --- searches ------------------------------------------------------------------------------------------


def blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items in blocks of about ``block_bytes``: what is sent to all shards at once has that bound."""
    rows = keyed_texts(items, "item_id").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    for block in range(n):
        part = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == block)
        yield [(i, w) for i, t in part.collect() if (w := words_of(bytes(t)))]


class Phrases:
    """The distinct windows of a block of items, as numbers into the block's list of words."""

    def __init__(self, words: list[bytes], windows: list[np.ndarray], owners: list[list[int]]):
        self.words, self.windows, self.owners = words, windows, owners
        width = max(map(len, windows), default=1)
        self.padded = np.array([[*w, *[-1] * (width - len(w))] for w in windows], np.int64).reshape(-1, width)

    @staticmethod
    def parts(items: list[tuple[int, list[bytes]]], length: int) -> tuple:
        """The windows of ``items`` as plain values, which can be broadcast."""
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        owners: defaultdict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, words in items:
            ids = [number[w] for w in words]
            for i in range(max(1, len(ids) - length + 1)):
                owners[tuple(ids[i : i + length])].add(item)
        return list(number), [np.array(w, np.int64) for w in owners], [sorted(o) for o in owners.values()]

    def present(self, shard: Shard) -> Iterator[tuple[np.ndarray, list[int]]]:
        """The windows all of whose words occur in the shard, in the shard's term numbers."""
        index = {t: i for i, t in enumerate(shard.terms)}
        local = np.array([*(index.get(w, -2) for w in self.words), -1], np.int64)
        for k in np.flatnonzero((local[self.padded] != -2).all(axis=1)):
            yield local[self.windows[k]], self.owners[k]


def covered(shard: Shard, phrases: Phrases) -> Iterator[tuple]:
    """A row per document of the shard: its merged hit spans and the items found in it."""
    size = int(shard.lengths.sum()) + len(shard.lengths)
    change = np.zeros(size + 1, np.int32)
    found: defaultdict[int, set[int]] = defaultdict(set)
    for window, owners in phrases.present(shard):
        at = shard.phrase(window)
        if len(at):
            np.add.at(change, at, 1)
            np.add.at(change, at + len(window), -1)
            for doc in np.unique(shard.doc(at)).tolist():
                found[doc].update(owners)
    edge = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = shard.doc(begins)
    spans: defaultdict[int, list[dict]] = defaultdict(list)
    for d, b, e in zip(doc.tolist(), (begins - shard.starts[doc]).tolist(), (ends - shard.starts[doc]).tolist(), strict=True):
        spans[d].append({"start": b, "end": e})
    for d, (doc_id, absent, n) in enumerate(zip(shard.doc_ids.tolist(), shard.absent.tolist(), shard.lengths.tolist(), strict=True)):
        yield d, None if absent else doc_id, n, spans[d], sorted(found[d])


def contamination(index: DataFrame, items: DataFrame, length: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document of the index: doc_id, n_words, the merged spans of words that lie in a window of an
    item, and the sorted ids of the items with such windows. A window is ``length`` consecutive words
    of an item (item_id, text), or the whole of an item with fewer."""
    schema = pa.schema(
        [
            ("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64())),
        ]
    )
    results = []
    columns = ["doc_id", "n_words", "spans", "items"]
    for block in blocks(items, block_bytes):
        sent = index.sparkSession.sparkContext.broadcast(Phrases.parts(block, length))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(*sent.value)
            for number, *row in rows_of(batches, *SHARD_COLUMNS):
                rows = [(number, *x) for x in covered(Shard.unpacked(*row), phrases)]
                yield batch_of(schema, list(zip(*rows, strict=True)))

        results.append(index.mapInArrow(releasing(search), MATCH))
    return (results[0] if len(results) == 1 else _merged(results)).select(*columns)


def _merged(results: list[DataFrame]) -> DataFrame:
    """The blocks' rows of each document as one."""
    rows = results[0]
    for one in results[1:]:
        rows = rows.unionByName(one)
    merged = rows.groupBy("shard", "place", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def joined(done, x):
        last = F.get(done, F.size(done) - 1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        apart = (F.size(done) == 0) | (x["start"] > F.get(done, F.size(done) - 1)["end"])
        return F.when(apart, F.concat(done, F.array(x))).otherwise(
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))
        )

    spans = F.aggregate("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"), joined)
    return merged.withColumn("spans", F.when(F.size("spans") > 0, spans).otherwise(F.col("spans")))


def find(index: DataFrame, phrases: DataFrame, within: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Matches of whole phrases (item_id, text): item_id, doc_id, start, end in words of the document.

    Without ``within`` the phrase occurs word for word; with it, all its words occur in any order inside
    a span of at most ``within`` words, and the tightest spans are given."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    out = None
    for block in blocks(phrases, block_bytes):
        sent = index.sparkSession.sparkContext.broadcast(Phrases.parts(block, max((len(w) for _, w in block), default=1)))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(*sent.value)
            for _, *row in rows_of(batches, *SHARD_COLUMNS):
                shard = Shard.unpacked(*row)
                for window, owners in phrases.present(shard):
                    if within is None:
                        begin = shard.phrase(window)
                        end = begin + len(window)
                    else:
                        begin, end = shard.near(window, within)
                    doc = shard.doc(begin)
                    for owner in owners:
                        ids = pa.array(shard.doc_ids[doc], mask=shard.absent[doc])
                        yield batch_of(schema, [np.full(len(doc), owner), ids, begin - shard.starts[doc], end - shard.starts[doc]])

        part = index.mapInArrow(releasing(search), FOUND)
        out = part if out is None else out.unionByName(part)
    return out
