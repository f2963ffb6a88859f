"""Packing of documents into sequences of a fixed capacity by multiway differencing.

Each task takes its documents in groups of about ``group_ids`` ids and packs every group by itself: nothing is
shuffled and memory is bounded, whatever the source or length of the documents. A document is cut into full
sequences and a rest. The rests of a group go to the least number of windows that may hold them, by the
differencing method of Karmarkar and Karp for many ways: every rest begins as a partition of its own into
windows, all but one empty; the two partitions with the largest imbalance are merged, the fullest windows of
one with the emptiest of the other, until one partition is left. Should a window then exceed the
capacity, the number of windows rises by one and the group is packed again.

Edge cases: a null text is an empty document, which still has its end id. Repeated rows are packed as often as
they come; a null doc_id stays null. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batch_of, keyed_texts, releasing, rows_of
from .encoding import END_ID, encoder, vocabulary
from .token_codes import in_groups

CAPACITY = 4096
GROUP_IDS = 1_000_000
BATCH = 256

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def differenced(sizes: list[int], ways: int) -> list[list[int]]:
    """The items (by number) of each of ``ways`` windows with near-equal sums. A partition holds its non-empty windows
    only, in ascending order of their sums, so all partitions together hold no more windows than there are items."""
    heap = [(-size, k, np.array([size], np.int64), [k]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, low, mine = heapq.heappop(heap)
        _, _, high, theirs = heapq.heappop(heap)
        both = max(0, len(low) + len(high) - ways)  # the emptiest of each, where there are no empty windows left
        sums = np.concatenate([high[both:][::-1], low[:both] + high[:both][::-1], low[both:]])
        items = theirs[both:][::-1] + list(zip(mine[:both], theirs[:both][::-1], strict=True)) + mine[both:]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        least = sums[0] if len(sums) == ways else 0
        heapq.heappush(heap, (int(least - sums[-1]), number, sums, [items[i] for i in order.tolist()]))
        number += 1
    if not heap:
        return []
    return [[] for _ in range(ways - len(heap[0][3]))] + [list(leaves(w)) for w in heap[0][3]]


def leaves(tree) -> Iterator[int]:
    stack = [tree]
    while stack:
        top = stack.pop()
        if isinstance(top, tuple):
            stack += top
        elif top is not None:
            yield top


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    ways = -(-sum(sizes) // capacity)
    while True:
        packed = differenced(sizes, ways)
        if all(sum(sizes[i] for i in w) <= capacity for w in packed):
            return [w for w in packed if w]
        ways += 1


def sequences(docs: list[tuple[int | None, bytes]], capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document by number, start, length), full ones first."""
    rests = []
    for k, (_, ids) in enumerate(docs):
        n = len(ids) // 4
        for start in range(0, n - capacity + 1, capacity):
            yield [(k, start, capacity)]
        if n % capacity:
            rests.append((k, n - n % capacity, n % capacity))
    for window in windows([r[2] for r in rests], capacity):
        yield [rests[i] for i in window]


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_ids: int = GROUP_IDS, end_id: int = END_ID
) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and the ids themselves (little-endian 32-bit). ``tokenizer`` is the path of a vocabulary file."""
    rules = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))
    schema = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (c.split() for c in PIECE.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, end = encoder(rules.value), np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 34
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            rows = []
            for pieces in sequences(held, capacity):
                offset = 0
                for k, start, length in pieces:
                    doc_id, ids = held[k]
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(part), len(ids) // 4, number, offset, part))
                    offset += length
                number += 1
            held, size = [], 0
            return batch_of(schema, list(zip(*rows, strict=True)))

        for keys, texts in in_groups(rows_of(batches, "doc_id", "text"), BATCH):
            for key, ids in zip(keys, encoded.encode(texts), strict=True):
                held.append((key, ids + end))
                size += len(ids) // 4 + 1
                if size >= group_ids:
                    yield flush()
        if held:
            yield flush()

    return keyed_texts(docs).mapInArrow(releasing(run, encodes=True), PIECE)
