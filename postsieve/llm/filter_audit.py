"""What filters remove in every order of applying them, by sorted posting lists.

1. A pass over the texts tells for each document which filters it fails. The filter for copies compares digests of
   128 bits: the smallest doc_id of each text that several documents have is joined back, a hot text in slices.
2. Documents are dealt by ranges of doc_id, whatever part they belong to, so a part with a third of all rows is in as
   many tasks as any other. Within a range every document has a number, ascending with doc_id. For each range and part
   a row holds one sorted list of numbers per filter, the documents that fail it, and one each for the documents that
   are good and toxic by their labels. This table of lists is written.
3. For each range and part the unions of all sets of filters are merged from these lists, and from each filter's list
   the union of any set of others is taken away; sizes of what is left, and of its part that is good or toxic, are
   summed per part. Merging goes over sorted runs: numpy's stable sort of them is a merge that gallops, and the lookup
   of a short list in a long one is a binary search.
4. Removed at a step of an order: those that fail its filter and none before it. All else follows from these sums.

Edge cases: a null text is empty, a null part is the empty string. A null doc_id has no labels and no document with a
smaller id, and its text makes no other document a copy. Repeated rows count as often as they come; rows with one
doc_id are no copies of each other. A doc_id with several labels is good, or toxic, if any of them says so. Long texts
are taken whole, one at a time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import hot_keys, spread_join
from ..session import stage
from .common import batch_of, partitions, rows_of, short_batches

# A filter's name and whether a text with these words fails it; the filter for copies has its own rule.
Test = Callable[[bytes, list[bytes]], bool]
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))


def few_words(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def repetitive(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def shouting(text: bytes, words: list[bytes]) -> bool:
    points = len(text.translate(None, CONTINUATION))
    return 100 * (len(text) - len(text.translate(None, CAPITALS))) > 2 * points


def marked(text: bytes, words: list[bytes]) -> bool:
    return len(text.translate(None, MARKS)) < len(text)


TESTS: dict[str, Test] = {"A": few_words, "B": repetitive, "C": shouting, "D": marked}
COPIES = "E"
RANGE_ROWS = 200_000


# --- 1: which filters a document fails -----------------------------------------------------------------


def failures(docs: DataFrame, tests: dict[str, Test], key: str, text: str, part: str) -> DataFrame:
    """doc_id, part, failed (a bit per test) and the digest of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("failed", pa.int32()), ("digest", pa.binary())])
    rules = list(tests.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, digests = [], []
            for (body,) in rows_of([batch], "text"):
                words = body.split()
                failed.append(sum(rule(body, words) << k for k, rule in enumerate(rules)))
                digests.append(hashlib.blake2b(body, digest_size=16).digest())
            yield batch_of(schema, [batch.column("doc_id"), batch.column("part"), failed, digests])

    short_batches(docs.sparkSession)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, part string, failed int, digest binary")


def with_copies(facts: DataFrame, bit: int) -> DataFrame:
    """The bit of documents whose text a smaller doc_id has."""
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = stage(first.where("first < last"))
    hot = hot_keys(first, ["digest"], count=F.col("n"))
    joined = spread_join(facts, first.select("digest", "first"), ["digest"], "left", ["doc_id"], hot)
    failed = F.col("failed") + F.when(F.col("first") < F.col("doc_id"), 1 << bit).otherwise(0)
    return joined.select("doc_id", "part", failed.alias("failed"))


def with_labels(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    hot = hot_keys(rows.where("doc_id IS NOT NULL"), ["doc_id"])
    joined = spread_join(rows, known, ["doc_id"], "left", ["doc_id", "part", "failed"], hot)
    no = F.lit(False)
    return joined.select("doc_id", "part", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


# --- 2: posting lists ------------------------------------------------------------------------------------

LISTS = "part string, first_id long, last_id long, rows long, lists array<binary>, good binary, toxic binary"


def posting_lists(rows: DataFrame, filters: int, range_rows: int) -> DataFrame:
    """Per range of doc_id and part: number of rows, and sorted numbers (32 bits) of the documents that fail each
    filter, of good and of toxic ones."""
    schema = pa.schema([
        ("part", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("rows", pa.int64()),
        ("lists", pa.list_(pa.binary())), ("good", pa.binary()), ("toxic", pa.binary()),
    ])

    def listed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        parts = table.column("part").chunk(0).dictionary_encode()
        codes, failed = parts.indices.to_numpy(zero_copy_only=False), table.column("failed").to_numpy()
        good, toxic = table.column("good").to_numpy(), table.column("toxic").to_numpy()
        ids = table.column("doc_id")
        order = np.argsort(codes, kind="stable")
        cuts = np.searchsorted(codes[order], np.arange(len(parts.dictionary) + 1))
        out = []
        for code, name in enumerate(parts.dictionary.to_pylist()):
            own = order[cuts[code] : cuts[code + 1]].astype(np.int32)
            lists = [own[failed[own] >> k & 1 == 1].tobytes() for k in range(filters)]
            out.append((name, ids[own[0]].as_py(), ids[own[-1]].as_py(), len(own), lists, own[good[own]].tobytes(), own[toxic[own]].tobytes()))
        return batch_of(schema, list(zip(*out, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                total += batch.num_rows
            if total >= range_rows:
                yield listed(held)
                held, total = [], 0
        if held:
            yield listed(held)

    count = partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(count, "doc_id", F.xxhash64("part", "failed")).sortWithinPartitions("doc_id")
    return dealt.mapInArrow(run, LISTS)


# --- 3: unions and differences ---------------------------------------------------------------------------


def union(lists: list[np.ndarray]) -> np.ndarray:
    """The merge of sorted lists, each number once."""
    merged = np.sort(np.concatenate(lists), kind="stable")  # sorted runs are merged, galloping
    return merged[np.append(True, merged[1:] != merged[:-1])] if len(merged) else merged


def found_in(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which numbers of a sorted list another one has, by binary search."""
    if not len(others):
        return np.zeros(len(some), bool)
    at = np.searchsorted(others, some)
    return others[np.minimum(at, len(others) - 1)] == some


ALL_ROWS = -1
SIZES = "part string, filter int, before int, removed long, good long, toxic long"


def difference_sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """For each filter and set of others (as bits): how many fail it and none of those, of them good and toxic."""
    unions = {0: np.empty(0, np.int32)}
    for chosen in range(1, 1 << len(lists)):
        top = chosen.bit_length() - 1
        unions[chosen] = union([unions[chosen ^ 1 << top], lists[top]])
    for k, own in enumerate(lists):
        if len(own):
            for before in range(1 << len(lists)):
                if not before >> k & 1:
                    left = own[~found_in(own, unions[before])]
                    if len(left):
                        yield k, before, len(left), int(found_in(left, good).sum()), int(found_in(left, toxic).sum())


def sizes_of(postings: DataFrame) -> DataFrame:
    schema = pa.schema([("part", pa.string()), ("filter", pa.int32()), ("before", pa.int32()), *((n, pa.int64()) for n in ("removed", "good", "toxic"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, *packed in rows_of(batches, "part", "rows", "lists", "good", "toxic"):
            lists, good, toxic = [np.frombuffer(p, np.int32) for p in packed[0]], *(np.frombuffer(p, np.int32) for p in packed[1:])
            out = [(ALL_ROWS, 0, rows, 0, 0), *difference_sizes(lists, good, toxic)]
            yield batch_of(schema, [[part] * len(out), *zip(*out, strict=True)])

    return postings.mapInArrow(run, SIZES).groupBy("part", "filter", "before").agg(
        *(F.sum(n).alias(n) for n in ("removed", "good", "toxic"))
    )


# --- 4: every order --------------------------------------------------------------------------------------

STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def steps_of(names: list[str], sizes: list[tuple[int, int, int, int, int]]) -> list[tuple]:
    """The rows of a part, all orders and steps, from its sums (a few for each set of filters)."""
    found = {(k, before): rest for k, before, *rest in sizes}
    rows, none, everything = found[ALL_ROWS, 0][0], (0, 0, 0), (1 << len(names)) - 1
    out, shapley = [], dict.fromkeys(range(len(names)), 0)
    for order in permutations(range(len(names))):
        kept, before = rows, 0
        for step, k in enumerate(order, 1):
            removed, good, toxic = found.get((k, before), none)
            kept -= removed
            failing, alone = found.get((k, 0), none)[0], found.get((k, everything ^ 1 << k), none)[0]
            out.append((k, "".join(names[i] for i in order), step, kept, removed, failing - removed, alone, good, toxic))
            shapley[k] += removed
            before |= 1 << k
    return [(*row, shapley[k]) for k, *row in out]


def audit(
    docs: DataFrame,
    labels: DataFrame,
    tests: dict[str, Test] = TESTS,
    copies: str = COPIES,
    key: str = "doc_id",
    text: str = "text",
    part: str = "source",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """A row per part, order of the filters and step. ``tests`` are filters on a text and its words, by a letter
    each; ``copies`` is the letter of the filter for texts that a smaller doc_id has. ``labels`` has the columns
    quality and toxic by ``key``."""
    names = [*tests, copies]
    facts = stage(failures(docs, tests, key, text, part))
    rows = with_labels(with_copies(facts, len(tests)), labels, key)
    sizes = sizes_of(stage(posting_lists(rows, len(names), range_rows)))
    fields = ["filter", "before", "removed", "good", "toxic"]
    whole = sizes.groupBy("part").agg(F.collect_list(F.struct(*fields)).alias("sizes"))  # one entry per set of filters
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in STEPS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, found in rows_of(batches, "part", "sizes"):
            out = steps_of(names, [tuple(f[n] for n in fields) for f in found])
            yield batch_of(schema, [[name] * len(out), *zip(*out, strict=True)])

    return whole.mapInArrow(run, STEPS)
