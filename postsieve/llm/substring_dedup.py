"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``length`` consecutive words of a document. Of the ``seed``-word runs inside it the one with the
smallest hash is its minimiser; equal windows have equal minimisers. Consecutive windows of a document mostly
share theirs, and such a stretch travels as one packed string to the bucket of the minimiser. There the windows
of the strings are sorted, so equal ones meet, and the smallest and largest doc_id of each are exact. Strings
whose minimiser nobody else has are never unpacked.

A string that comes many times is sent once per chunk of a task, with the smallest and largest doc_id that
has it: a passage of a third of all documents loads its bucket with one row per chunk. What is learned
goes back by a join on the strings' hashes (128 bits), which Spark may split where it is skewed; a bitmap of
fixed size keeps out strings that have nothing to learn.

Words are the runs without ASCII white space. A word is removed if it lies in a window that also starts in a
document with a smaller doc_id; windows are judged on the input.

Edge cases: null and empty texts have no words. A document with fewer words than a window keeps all. Rows with
one doc_id do not remove each other's words, repeats included. Rows with a null doc_id neither lose words
nor take any from others. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import WordHashes, batch_of, key_bitmap, keyed_texts, may_occur, mixed_all, partitions, rows_of, window_hashes

LENGTH = 13
SEED = 4
CHUNK_BYTES = 4 << 20
ROUND_BYTES = 256 << 20

PACKED = "bucket long, minimisers binary, lowest binary, highest binary, strings binary, size long"
SHARED = "lo long, hi long, firsts array<long>"
MET = "lo long, hi long, doc_id long, digest long, start int"
KEPT = "doc_id long, n_words long, n_removed long, kept string"


def fields(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


class Stretches:
    """The super-k-mers of some documents, of (doc_id, digest, words)."""

    def __init__(self, docs: list[tuple[int, int, list[bytes]]], memo: WordHashes, length: int, seed: int):
        sizes = np.array([len(w) for _, _, w in docs], np.int64)
        ends = np.cumsum(sizes)
        self.words = [w for _, _, words in docs for w in words]
        hashes = memo.of(self.words)
        count = max(0, len(hashes) - length + 1)
        runs = window_hashes(hashes, seed)
        best, place = runs[:count].copy(), np.arange(count)
        for k in range(1, length - seed + 1):
            other = runs[k : k + count]
            less = other < best
            best[less] = other[less]
            place[less] = np.flatnonzero(less) + k
        doc = np.repeat(np.arange(len(docs)), sizes)[:count]
        valid = np.arange(count) + length <= ends[doc] if count else np.zeros(0, bool)
        new = valid.copy()
        new[1:] &= ~(valid[:-1] & (place[1:] == place[:-1]) & (doc[1:] == doc[:-1]))
        self.first = np.flatnonzero(new)
        last = np.append(new[1:] | ~valid[1:], True) & valid
        self.n = np.flatnonzero(last) - self.first + 1
        self.doc = doc[self.first]
        self.minimiser = best[self.first]
        self.lo, self.hi = stretch_keys(hashes, self.first, self.n, length)
        self.doc_id = np.array([d for d, _, _ in docs], np.int64)[self.doc]
        self.digest = np.array([d for _, d, _ in docs], np.int64)[self.doc]
        self.start = self.first - (ends - sizes)[self.doc]

    def strings(self, which: np.ndarray, length: int) -> Iterator[bytes]:
        """The packed strings: words parted by one blank."""
        joined = b" ".join(self.words)
        at = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1, out=at[1:])
        begin, end = at[self.first[which]], at[self.first[which] + self.n[which] + length - 1] - 1
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            yield joined[a:b]


def salted(hashes: np.ndarray) -> np.ndarray:
    return mixed_all(hashes + np.uint64(0x632BE59BD9B4E019))


def stretch_keys(hashes: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each stretch. A minimiser lasts for less than ``length`` windows, so the first and
    the last window hold all words."""
    keys = []
    for words in (hashes, salted(hashes)):
        whole = window_hashes(words, length)
        key = mixed_all(whole[first] * np.uint64(3) + n.astype(np.uint64)) + whole[first + n - 1]
        keys.append(mixed_all(key).view(np.int64))
    return keys[0], keys[1]


def chunks(rows: Iterator[tuple], size: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    held, total = [], 0
    for doc_id, digest, text in rows:
        held.append((doc_id, digest, text.split()))
        total += len(text)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def packed_stretches(texts: DataFrame, length: int, seed: int, buckets: int, chunk_bytes: int) -> DataFrame:
    """A row per chunk and bucket: minimisers (32 bits of each), doc_ids and strings, each string once."""
    schema = fields(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, codec = WordHashes(), pa.Codec("zstd", 1)
        for docs in chunks(rows_of(batches, "doc_id", "digest", "text"), chunk_bytes):
            s = Stretches(docs, memo, length, seed)
            order = np.lexsort((s.doc_id, s.hi, s.lo, s.minimiser % np.uint64(buckets)))
            lo, hi, ids = s.lo[order], s.hi[order], s.doc_id[order]
            edge = np.append((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True)
            lasts = np.flatnonzero(edge[: len(order)])
            firsts = np.append(0, lasts[:-1] + 1)[: len(lasts)]
            which, low, high = order[firsts], ids[firsts], ids[lasts]
            strings = list(s.strings(which, length))
            bucket = (s.minimiser[which] % np.uint64(buckets)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                text = b"\n".join(strings[a:b])
                parts = (s.minimiser[which[a:b]].astype(np.uint32), low[a:b], high[a:b])
                blobs = [codec.compress(p.tobytes(), asbytes=True) if k else p.tobytes() for k, p in enumerate(parts)]
                yield batch_of(schema, [[x] for x in (bucket[a], *blobs, codec.compress(text, asbytes=True), len(text))])

    return texts.mapInArrow(run, PACKED)


def shared_windows(packed: DataFrame, length: int, buckets: int) -> DataFrame:
    """Of every string with a window that starts in several documents: for each of its windows the smallest
    doc_id in which that window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        by_bucket: dict[int, list[tuple]] = {}
        for bucket, *row in rows_of(batches, *fields(PACKED).names):
            by_bucket.setdefault(bucket, []).append(row)
        for rows in by_bucket.values():
            mine = np.frombuffer(b"".join(r[0] for r in rows), np.uint32)
            firsts = np.cumsum([0] + [len(r[0]) // 4 for r in rows])
            low, high = (np.frombuffer(unpacked([r[k] for r in rows], 8 * len(mine)), np.int64) for k in (1, 2))
            _, group, times = np.unique(mine, return_inverse=True, return_counts=True)
            wanted = (times[group] > 1) | (low != high)
            rounds = 1 + sum(r[4] for r in rows) // ROUND_BYTES  # windows that are equal have one minimiser: one round
            for turn in range(rounds):
                which = np.flatnonzero(wanted & (mine % np.uint32(rounds) == turn))
                if len(which):
                    yield answers(*merged(picked(rows, firsts, which), low[which], high[which]), memo, length)

    return packed.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(run, SHARED)


def unpacked(blobs: list[bytes], size: int) -> bytes:
    """What the blobs hold, one after the other. A call costs more than a small blob, and zstd reads a row of them."""
    return pa.Codec("zstd").decompress(b"".join(blobs), size, asbytes=True)


def picked(rows: list[tuple], firsts: np.ndarray, which: np.ndarray) -> list[bytes]:
    """The strings ``which`` of a bucket, numbered through its rows. A bucket has a row per chunk of the whole input, so
    rows get smaller and more as the input grows: as many are unpacked at once as make up a chunk."""
    texts, held, size = [], [], 0
    ends = np.searchsorted(which, firsts[1:])
    for k, (row, own) in enumerate(zip(rows, np.split(which, ends[:-1]), strict=True)):
        if len(own):
            held.append((row, (own - firsts[k]).tolist()))
            size += row[4]
        if held and (size >= CHUNK_BYTES or k == len(rows) - 1):
            whole, at = unpacked([r[3] for r, _ in held], size), 0
            for r, own in held:
                strings = whole[at : at + r[4]].split(b"\n")
                texts += [strings[i] for i in own]
                at += r[4]
            held, size = [], 0
    return texts


def merged(texts: list[bytes], lows: np.ndarray, highs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Each string once, with the smallest and largest doc_id that has it: chunks send what others have sent too."""
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
    order = np.argsort(which, kind="stable")
    heads = np.flatnonzero(np.diff(which[order], prepend=-1))
    return list(number), np.minimum.reduceat(lows[order], heads), np.maximum.reduceat(highs[order], heads)


def answers(texts: list[bytes], lows: np.ndarray, highs: np.ndarray, memo: WordHashes, length: int) -> pa.RecordBatch:
    """Sorts the windows of the strings by 128 bits of hash, so that equal ones meet, and takes the smallest and the
    largest doc_id of each."""
    sizes = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
    hashes = memo.of(b" ".join(texts).split(b" "))
    n = sizes - length + 1
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(texts)), n)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(ends[-1]) - (ends - n)[owner] + starts[owner]
    first, second = (window_hashes(h, length)[place] for h in (hashes, salted(hashes)))
    order = np.lexsort((second, first))
    edge = np.append(True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1]))
    heads, group = np.flatnonzero(edge), np.cumsum(edge) - 1
    low = np.minimum.reduceat(lows[owner[order]], heads)
    several = low < np.maximum.reduceat(highs[owner[order]], heads)
    least, shared = np.empty(len(order), np.int64), np.empty(len(order), bool)
    least[order], shared[order] = low[group], several[group]
    kept = np.flatnonzero(np.logical_or.reduceat(shared, ends - n))
    lo, hi = stretch_keys(hashes, starts[kept], n[kept], length)
    _, once = np.unique(np.stack([lo, hi]), axis=1, return_index=True)
    kept, lo, hi = kept[once], lo[once], hi[once]
    offsets = np.append(0, np.cumsum(n[kept])).astype(np.int32)
    values = least[np.repeat((ends - n)[kept] - offsets[:-1], n[kept]) + np.arange(offsets[-1])]
    firsts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), firsts], names=fields(SHARED).names)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch_of(schema, list(zip(*held, strict=True)))
            held = []
    if held:
        yield batch_of(schema, list(zip(*held, strict=True)))


def occurrences(texts: DataFrame, shared: DataFrame, length: int, seed: int, chunk_bytes: int) -> DataFrame:
    """Where the documents have stretches that may be in ``shared``."""
    bitmap = texts.sparkSession.sparkContext.broadcast(key_bitmap(shared, "lo"))
    schema = fields(MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for docs in chunks(rows_of(batches, "doc_id", "digest", "text"), chunk_bytes):
            s = Stretches(docs, memo, length, seed)
            k = np.flatnonzero(may_occur(bitmap.value, s.lo))
            yield batch_of(schema, [s.lo[k], s.hi[k], s.doc_id[k], s.digest[k], s.start[k].astype(np.int32)])

    return texts.mapInArrow(run, MET)


def repeated_starts(docs: DataFrame, length: int = LENGTH, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, digest (xxhash64 of the text), starts: the word places at which windows start that also start in
    a document with a smaller doc_id. Only documents that have some."""
    texts = with_digest(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    buckets = partitions(docs.sparkSession)
    shared = stage(shared_windows(packed_stretches(texts, length, seed, buckets, chunk_bytes), length, buckets))
    met = occurrences(texts, shared, length, seed, chunk_bytes).join(shared, ["lo", "hi"])
    later = F.filter(F.sequence(F.lit(0), F.size("firsts") - 1), lambda i: F.get("firsts", i) < F.col("doc_id"))
    places = met.select("doc_id", "digest", F.transform(later, lambda i: F.col("start") + i).alias("starts"))
    places = places.where(F.size("starts") > 0)
    return places.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def with_digest(docs: DataFrame) -> DataFrame:
    return keyed_texts(docs).select("doc_id", "text", F.xxhash64("text").alias("digest"))


def dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one blank, of every row of ``docs``."""
    schema = fields(KEPT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text, starts in rows_of(batches, "doc_id", "text", "starts"):
                words = text.split() if text else []
                kept = words
                if starts:
                    change = np.zeros(len(words) + 1, np.int32)
                    at = np.array(starts)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + length, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                yield doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8")

        yield from batches_of(rows(), schema, 1000)

    starts = repeated_starts(docs, length, seed, chunk_bytes)
    joined = with_digest(docs).join(starts, ["doc_id", "digest"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(cut, KEPT)
