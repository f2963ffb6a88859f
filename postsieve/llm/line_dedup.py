"""Line dedup by pairwise alignment.

Pairs of documents are aligned by patience diff: lines that occur once in either document and in the same order are
anchors, and what lies between anchors is aligned in the same way. Runs of aligned lines with ``min_words`` words
or more are deleted from the later document, which is the one with the larger doc_id. Documents are judged on the
input, not on what other deletions leave. Lines are parted by line feeds and compared without white space at their ends.

The result is that of aligning every two documents. What an alignment deletes lies in runs of lines that both
documents have and that reach ``min_words`` with their last or with their first line, so only documents that share
such a run are compared. A run that at most ``RARE`` documents have pairs every two of them. A more frequent one
pairs each holder with the first of all. Where the first's alignment leaves lines of the run, because it has them in
another order or place, the holder is open: it meets more holders of that run, the first of each of some slots,
and in the end all earlier ones. A document whose shared runs are deleted needs no further comparison, since no other
document can delete more of it.

Of a run that many documents of one chunk of a task have only the first holder and their number travel; its other
holders learn the first of all by a join that Spark may split.

Edge cases: null and empty texts have no line to delete and give null and empty texts. Rows with a null doc_id
are left alone. Rows with the same doc_id and text count as one document, and rows with the same
doc_id as none's later. Long texts are taken whole, as one row of line hashes. Empty tables give empty results; other
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import batch_of, free_name, key_bitmap, keyed_texts, may_occur, mixed_all, partitions, releasing, rows_of

RARE = 8
MIN_WORDS = 10
SLOTS = (8, 64)
CHUNK_LINES = 200_000

LINES = "doc_id long, digest long, hashes binary, words binary"
HOLDERS = "bucket long, hashes binary, docs binary, digests binary, counts binary"
MET = "line long, a long, a_digest long, b long, b_digest long"
HELD = "b long, b_digest long, line long"
DELETED = "b long, b_digest long, deleted array<int>"

Keys = Callable[[np.ndarray, np.ndarray], np.ndarray]


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def lines_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each line (0: blank) and its number of words."""
    stripped = [line.strip() for line in text.split(b"\n")]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) if x else 0 for x in stripped), np.uint64, len(stripped))
    return hashes, np.fromiter((len(x.split()) for x in stripped), np.int32, len(stripped))


def hashed_lines(docs: DataFrame) -> DataFrame:
    schema = schema_of(LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for doc_id, digest, text in rows_of(batches, "doc_id", "digest", "text"):
            hashes, words = lines_of(text)
            held.append((doc_id, digest, hashes.tobytes(), words.tobytes()))
            if len(held) == 1000:
                yield batch_of(schema, list(zip(*held, strict=True)))
                held = []
        if held:
            yield batch_of(schema, list(zip(*held, strict=True)))

    rows = with_digest(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id", "digest"])
    return rows.select("doc_id", "digest", "text").mapInArrow(releasing(run), LINES)


def with_digest(docs: DataFrame) -> DataFrame:
    return keyed_texts(docs).select("doc_id", "text", F.xxhash64("text").alias("digest"))


# --- pairs ---------------------------------------------------------------------------------------------


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number modulo 2**64, and of its inverse."""
    if n not in _POWERS:
        base = 0x9E3779B97F4A7C15
        both = [np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for x in both:
            x[:1] = 1
        _POWERS[n] = tuple(np.multiply.accumulate(x) for x in both)
    return _POWERS[n]


def runs_of(hashes: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash, the begin and the end of each run of lines that has ``min_words`` words but not without its last line, or
    not without its first."""
    n = len(hashes)
    before = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    place = np.arange(n, dtype=np.int64)
    ends = np.maximum(np.searchsorted(before, before[:-1] + min_words), place + 1)
    starts = np.minimum(np.searchsorted(before, before[1:] - min_words, "right") - 1, place)
    forward, backward = ends <= n, starts >= 0
    runs = np.unique(np.concatenate([place[forward] * (n + 1) + ends[forward], starts[backward] * (n + 1) + place[backward] + 1]))
    starts, ends = runs // (n + 1), runs % (n + 1)
    power, inverse = (x[:n] for x in powers(1 << n.bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed_all(hashes + np.uint64(0x9E3779B97F4A7C15)) * power, dtype=np.uint64)])
    return mixed_all((sums[ends] - sums[starts]) * inverse[starts]), starts, ends


def run_keys(min_words: int) -> Keys:
    return lambda hashes, words: runs_of(hashes, words, min_words)[0]


def by_line(hashes: np.ndarray, docs: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by line and document, and where each line begins in it."""
    order = np.lexsort((digests, docs, hashes))
    lines = hashes[order]
    return order, np.flatnonzero(np.append(True, lines[1:] != lines[:-1])) if len(lines) else np.empty(0, np.int64)


def anchors_of(batches: Iterator[pa.RecordBatch], keys: Keys) -> Iterator[list[np.ndarray]]:
    """Chunks of (key, doc_id, digest) as columns, each key of a document once. Keys are hashes of runs or lines."""
    held, total = [], 0
    for doc_id, digest, hashes, words in rows_of(batches, "doc_id", "digest", "hashes", "words"):
        hashes = np.unique(keys(np.frombuffer(hashes, np.uint64), np.frombuffer(words, np.int32)))
        held.append((hashes, np.full(len(hashes), doc_id), np.full(len(hashes), digest)))
        total += len(hashes)
        if total >= CHUNK_LINES:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, total = [], 0
    if total:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def line_holders(lines: DataFrame, rare: int, keys: Keys, buckets: int) -> DataFrame:
    """Holders of keys on their way to the key's bucket, with counts: all holders of a key, but of one that
    more than ``rare`` documents of the chunk have only the first, with the number of them."""
    schema = schema_of(HOLDERS)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in anchors_of(batches, keys):
            order, starts = by_line(*columns)
            sizes = np.diff(np.append(starts, len(order)))
            frequent = np.repeat(sizes > rare, sizes)
            left = np.flatnonzero(~frequent | np.isin(np.arange(len(order)), starts))
            counts = np.where(frequent, np.repeat(sizes, sizes), 1)[left].astype(np.int64)
            hashes, docs, digests = (c[order[left]] for c in columns)
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                which = order[a:b]
                blobs = [x[which].tobytes() for x in (hashes, docs, digests, counts)]
                yield batch_of(schema, [[x] for x in (int(bucket[which[0]]), *blobs)])

    return lines.mapInArrow(releasing(hold), HOLDERS).repartition(buckets, "bucket")


def document_pairs(lines: DataFrame, rare: int, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a before b) of documents that share a key which at most ``rare`` documents have, or
    a key whose first holder is a; and the more frequent keys of all documents but the first with them (line, b,
    b_digest, a, a_digest)."""
    schema, kinds = schema_of(MET), (np.uint64, np.int64, np.int64, np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = defaultdict(list)
        for bucket, *blobs in rows_of(batches, "bucket", "hashes", "docs", "digests", "counts"):
            by_bucket[bucket].append([np.frombuffer(x, t) for x, t in zip(blobs, kinds, strict=True)])
        for held in by_bucket.values():
            hashes, docs, digests, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order, starts = by_line(hashes, docs, digests)
            hashes, docs, digests = hashes[order], docs[order], digests[order]
            sizes = np.diff(np.append(starts, len(order)))
            frequent = np.add.reduceat(counts[order], starts) > rare
            first = starts[frequent]
            yield batch_of(schema, [hashes[first].view(np.int64), docs[first], digests[first], [None] * len(first), [None] * len(first)])
            left = np.flatnonzero(~np.repeat(frequent, sizes))
            hashes, docs, digests = hashes[left], docs[left], digests[left]
            for step in range(1, rare):
                i = np.flatnonzero((hashes[step:] == hashes[:-step]) & (docs[step:] > docs[:-step]))
                found = np.unique(np.stack([docs[i], digests[i], docs[i + step], digests[i + step]]), axis=1)
                yield batch_of(schema, [[None] * found.shape[1], *found])

    buckets = partitions(lines.sparkSession)
    made = stage(line_holders(lines, rare, keys, buckets).mapInArrow(releasing(meet), MET))
    frequent = made.where("line IS NOT NULL").select("line", "a", "a_digest")
    held = stage(holders_of(lines, frequent, keys).join(frequent, "line").where("a < b"))
    return made.where("line IS NULL").drop("line").unionByName(held.drop("line")).distinct(), held


def holders_of(lines: DataFrame, wanted: DataFrame, keys: Keys) -> DataFrame:
    """line, b, b_digest: documents with the keys that they have of ``wanted`` (line), and a few other keys."""
    bitmap = lines.sparkSession.sparkContext.broadcast(key_bitmap(wanted, "line"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, docs, digests in anchors_of(batches, keys):
            k = np.flatnonzero(may_occur(bitmap.value, hashes))
            yield pa.RecordBatch.from_pydict({"b": docs[k], "b_digest": digests[k], "line": hashes[k].view(np.int64)})

    return lines.mapInArrow(releasing(others), HELD)


def open_runs(later: DataFrame, deleted: DataFrame, held: DataFrame, bitmap: Broadcast, min_words: int) -> DataFrame:
    """line, b, b_digest: frequent runs with an earlier holder of which b still has lines. ``later`` are the lines of
    the documents that hold some, ``bitmap`` tells the runs."""
    schema = schema_of(HELD)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, digest, hashes, words, gone in rows_of(batches, "b", "b_digest", "hashes", "words", "deleted"):
            hashes = np.frombuffer(hashes, np.uint64)
            keys, starts, ends = runs_of(hashes, np.frombuffer(words, np.int32), min_words)
            stay = np.ones(len(hashes) + 1, np.int64)
            stay[0] = 0
            if gone:
                stay[np.array(gone) + 1] = 0
            stay = np.cumsum(stay)
            keys = np.unique(keys[(stay[ends] > stay[starts]) & may_occur(bitmap.value, keys)])
            if len(keys):
                yield batch_of(schema, [np.full(len(keys), b), np.full(len(keys), digest), keys.view(np.int64)])

    docs = later.withColumnsRenamed({"doc_id": "b", "digest": "b_digest"})
    found = docs.join(deleted, ["b", "b_digest"], "left").mapInArrow(releasing(left), HELD)
    return found.join(held.select("line", "b", "b_digest"), ["line", "b", "b_digest"], "left_semi")


def further_pairs(held: DataFrame, opened: DataFrame, slots: int | None) -> DataFrame:
    """Distinct pairs (a before b) of open documents with other holders of their open runs: the first of each
    slot, or all."""
    firsts = held.groupBy("line").agg(F.min(F.struct("a", "a_digest")).alias("first")).select("line", "first.*")
    holders = firsts.unionByName(held.select("line", F.col("b").alias("a"), F.col("b_digest").alias("a_digest")))
    holders = holders.join(opened.select("line").distinct(), "line", "left_semi")
    if slots is not None:
        slot = F.pmod(F.xxhash64("a", "a_digest"), F.lit(slots)).alias("slot")
        first = holders.groupBy("line", slot).agg(F.min(F.struct("a", "a_digest")).alias("first"))
        holders = first.select("line", "first.*")
    return opened.join(holders, "line").where("a < b").select("a", "a_digest", "b", "b_digest").distinct()


# --- alignment -----------------------------------------------------------------------------------------


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: matched places (i, j), ascending in both."""
    found, ranges = [], [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if times_b[b[j]] == 1}
        anchors = rising([(i, place[a[i]]) for i in range(a0, a1) if a[i] in place and times_a[a[i]] == 1])
        if not anchors:
            continue
        found += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        ranges += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of the pairs, which ascend in the first place, that ascends in the second too."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        low, high = 0, len(tops)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if tops[middle] < j else (low, middle)
        back.append(piles[low - 1] if low else -1)
        tops[low : low + 1] = [j]
        piles[low : low + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Places in ``b`` of lines that lie in aligned runs of enough words."""
    out, run = [], []
    for i, j in [*aligned(a, b), (-1, -1)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[m] for _, m in run) >= min_words:
                out += [m for _, m in run]
            run = []
        run.append((i, j))
    return out


def aligned_blocks(lines: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """b, b_digest and the places of b's lines in blocks that it shares with a, for pairs that have some."""
    earlier = lines.select(F.col("doc_id").alias("a"), F.col("digest").alias("a_digest"), F.col("hashes").alias("ours"))
    later = lines.select(F.col("doc_id").alias("b"), F.col("digest").alias("b_digest"), F.col("hashes").alias("theirs"), "words")
    schema = schema_of(DELETED)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b, digest, ours, theirs, words in rows_of(batches, "b", "b_digest", "ours", "theirs", "words"):
            ours, theirs = (np.frombuffer(x, np.uint64).tolist() for x in (ours, theirs))
            if found := common_blocks(ours, theirs, np.frombuffer(words, np.int32).tolist(), min_words):
                held.append((b, digest, found))
            if len(held) == 1000:
                yield batch_of(schema, list(zip(*held, strict=True)))
                held = []
        if held:
            yield batch_of(schema, list(zip(*held, strict=True)))

    both = pairs.join(earlier, ["a", "a_digest"]).join(later, ["b", "b_digest"])
    return both.select("b", "b_digest", "ours", "theirs", "words").mapInArrow(releasing(align), DELETED)


def united(found: DataFrame) -> DataFrame:
    return found.groupBy("b", "b_digest").agg(F.array_distinct(F.flatten(F.collect_list("deleted"))).alias("deleted"))


def deletions(docs: DataFrame, min_words: int) -> DataFrame:
    """b, b_digest and the places of its lines to delete, for documents that have some."""
    lines = stage(hashed_lines(docs))
    pairs, held = document_pairs(lines, RARE, run_keys(min_words))
    deleted = stage(united(aligned_blocks(lines, pairs, min_words)))
    holders = held.select(F.col("b").alias("doc_id"), F.col("b_digest").alias("digest")).distinct()
    later = stage(lines.join(holders, ["doc_id", "digest"], "left_semi"))
    bitmap = lines.sparkSession.sparkContext.broadcast(key_bitmap(held, "line"))
    for slots in (*SLOTS, None):
        opened = stage(open_runs(later, deleted, held, bitmap, min_words))
        if opened.isEmpty():
            break
        found = aligned_blocks(lines, further_pairs(held, opened, slots), min_words)
        deleted = stage(united(deleted.unionByName(found)))
    return deleted


def cut(texts: pd.Series, deleted: pd.Series) -> pd.DataFrame:
    rows = []
    for text, places in zip(texts, deleted, strict=True):
        n = text.count("\n") + 1 if text else 0
        if places is not None and len(places):
            gone = set(places.tolist())
            text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in gone])
        rows.append((n, 0 if places is None else len(places), text))
    return pd.DataFrame(rows, columns=["n_lines", "n_removed", "kept"])


def without_blocks(docs: DataFrame, min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the kept lines as text, and the numbers of lines and of removed
    lines under the names ``counts``; columns of these two names are replaced."""
    gone = deletions(docs, min_words)
    key, digest, deleted, made = (free_name(docs, name) for name in ("key", "digest", "deleted", "made"))
    keyed = docs.withColumns({key: F.col("doc_id").cast("long"), digest: F.xxhash64(F.col("text").cast("binary"))})
    joined = keyed.join(gone.withColumnsRenamed({"b": key, "b_digest": digest, "deleted": deleted}), [key, digest], "left")
    cutting = F.pandas_udf(cut, "n_lines long, n_removed long, kept string")
    rows = joined.withColumn(made, cutting(F.col("text").cast("string"), F.col(deleted)))
    own = [F.col(made)["kept"].alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in counts]
    return rows.select(*own, F.col(made)["n_lines"].alias(counts[0]), F.col(made)["n_removed"].alias(counts[1]))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the kept text of every row of ``docs`` (doc_id, text)."""
    found = without_blocks(docs.select("doc_id", "text"), min_words)
    return found.select(F.col("doc_id").cast("long"), "n_lines", "n_removed", F.col("text").alias("kept"))
