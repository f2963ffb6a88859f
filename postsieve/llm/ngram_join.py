"""Exact Jaccard join of word n-gram sets with skipping by set relations.

1. Every document's set is hashed and fingerprinted; equal sets are one set from then on, whose members need no
   comparing. A sketch of fixed size counts n-grams by slot.
2. The n-grams of a set are ordered by (how far the sketch count lies above the mean, hash). Two sets that
   reach the threshold share at least l n-grams among the first n - ceil(t n) + l of each, for any l; with a
   quarter of the set as l only those prefixes are indexed: they travel packed to the bucket of the n-gram,
   where n-grams that one set alone has are dropped and the others get the length of their list. n-grams that the
   sketch calls frequent come late in the order, so they enter a prefix only where a set has little else, and they do
   not meet in a bucket but stay rows. A set whose n-grams in lists are fewer than the r that any partner would share
   is dropped; the others keep all but the last r - 1 of them, those in the shortest lists first: the first that two
   sets share is among these.
3. Each index list is first answered for its leaders, of each size (up to a factor of the threshold) the set with the longest
   lists: leader and members that pass the length bound are verified. A large group of near copies has the same few leaders
   in all of its lists. Links so far give components. A set that has a quarter of its n-grams in
   common with a leader belongs to its family, that of the leader with most such sets.
4. Within a family a set's answers follow from those of the others by what they have in common: the n-grams that most
   members have are columns of a table of members, whose product gives all overlaps on these columns at once; what
   members have beside them bounds the rest, and few pairs are left to be intersected. Links are given out that join
   components. Families of one component are done; others are cut into cells of bounded size.
5. Pairs of different families meet in the index lists. Lists whose sets are all in one component are done. The others
   are cut into cells of bounded size, their entries into blocks by length and position; a block is skipped as a whole
   when its first position and lengths rule the threshold out. An entry has with it the
   ``SEEN`` n-grams that come before the list's own in its set; a pair that has one of these in common meets in
   that one's list as well and is left out here, so a pair is given out about once and never less than once.
   The rest is verified.

No pair inside a component that is already known is looked at again, no list is gathered beyond a cell, and the
comparing steps read the sets of candidates only.

Edge cases: null texts and texts without words have the empty set, which links with nothing. With fewer words than
``n`` the whole sequence is the one n-gram. Rows with null doc_id take part; a component's id is its smallest doc_id
that is not null. Repeated rows are equal sets. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import LOWER, WordHashes, batch_of, components, key_bitmap, keyed_texts, may_occur, mixed_all, partitions, releasing, rows_of, window_hashes

NGRAM = 5
NUMERATOR, DENOMINATOR = 3, 4
SKETCH_SLOTS = 1 << 20
SKETCH_PARTS = 64
FREQUENT = 16
CHUNK_BYTES = 4 << 20
CELL = 4096
BLOCK = 64
LISTED = 50_000
PAIRS_AT_ONCE = 100_000

SLIM = "doc_id long, n_shingles long, fp long, part int, counts binary"
SEEN = 8
FAMILY_CELL = 2_000_000
SHORT = 1000
COLUMNS_AT_ONCE = 4096
ROWS_AT_ONCE = 256
FREQUENT_LIST = (1 << 31) - 1  # stands for the length of a frequent n-gram's list, which no bucket has counted
PREFIX = "bucket long, tokens binary, places binary, owners binary, fps binary, sizes binary"
ENTRY = "token long, fp long, n int, pos int, listed int"
PAIR = "a long, b long"
FAMILY = "family long, i int, j int, fp long, comp long, part int, shingles array<long>"


class Sets:
    """Shingle sets of texts, as sorted distinct 64-bit hashes."""

    def __init__(self, n: int):
        self.n, self.memo = n, WordHashes()

    def of(self, text: bytes | None) -> np.ndarray:
        words = text.translate(LOWER).split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.n:  # its own kind of n-gram: never equal to one of full length
            return mixed_all(window_hashes(self.memo.of(words), len(words)) + np.uint64(len(words)))
        return np.unique(window_hashes(self.memo.of(words), self.n))


def fingerprint(shingles: np.ndarray) -> int:
    return int(mixed_all(mixed_all(shingles * np.uint64(0xD6E8FEB86659FD93)).sum(keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


def shared_in_prefix(n):
    """How many n-grams of its prefix a set of this size shares with a partner of its size or larger."""
    return max(1, n // 4)


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + shared_in_prefix(n)


def shared_at_least(n: Column) -> Column:
    """The same for the smallest partner: sizes differ by the threshold at most."""
    return F.greatest(F.lit(1), F.floor(F.ceil(NUMERATOR * n / DENOMINATOR) / 4))


def needed(total):
    """Smallest overlap of two sets with so many n-grams together: 4 I >= 3 (total - I)."""
    return -(-NUMERATOR * total // (NUMERATOR + DENOMINATOR))


# --- 1: sets and sketch --------------------------------------------------------------------------------


def slim_sets(texts: DataFrame, n: int, slots: int) -> DataFrame:
    """A row per document (doc_id, n_shingles, fp), and per task the sketch's counts in parts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, counts = Sets(n), np.zeros(slots, np.uint32)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                shingles = sets.of(text)
                rows.append((doc_id, len(shingles), fingerprint(shingles) if len(shingles) else None))
                np.add.at(counts, (shingles & np.uint64(slots - 1)).astype(np.int64), np.uint32(1))
            none = [None] * len(rows)
            yield batch_of(schema, [*zip(*rows, strict=True), none, none] if rows else [[]] * 5)
        codec, width = pa.Codec("zstd", 1), slots // SKETCH_PARTS
        if counts.any():
            parts = [codec.compress(counts[k * width : (k + 1) * width].tobytes(), asbytes=True) for k in range(SKETCH_PARTS)]
            none = [None] * SKETCH_PARTS
            yield batch_of(schema, [none, none, none, list(range(SKETCH_PARTS)), parts])

    return texts.mapInArrow(releasing(run), SLIM)


def frequency_class(slim: DataFrame, slots: int) -> np.ndarray:
    """0 for slots up to ``FREQUENT`` times the mean count, else the power of two above it. Of fixed size."""
    width = slots // SKETCH_PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, total = pa.Codec("zstd"), {}
        for part, counts in rows_of(batches, "part", "counts"):
            found = np.frombuffer(codec.decompress(counts, 4 * width, asbytes=True), np.uint32)
            total[part] = total[part] + found if part in total else found.astype(np.uint64)
        for part, counts in total.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    parts = slim.where("part IS NOT NULL").select("part", "counts")
    summed = parts.repartition(SKETCH_PARTS, "part").mapInArrow(releasing(add), "part int, counts binary")
    counts = np.zeros(slots, np.uint64)
    for part, found in summed.collect():  # of fixed size
        counts[part * width : (part + 1) * width] = np.frombuffer(found, np.uint64)
    level = max(FREQUENT * counts.mean(), FREQUENT)
    return np.ceil(np.log2(np.maximum(counts / level, 1))).astype(np.uint8)


# --- 2: the index --------------------------------------------------------------------------------------


def prefix_entries(texts: DataFrame, classes: np.ndarray, n: int, buckets: int, chunk_bytes: int) -> DataFrame:
    """Rows (token, fp, n, pos, listed) of prefix n-grams that several sets have, with the length of their list."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(classes)
    schema = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("tokens", "places", "owners", "fps", "sizes"))])
    entry = pa.schema([("token", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("listed", pa.int32())])

    def chunk_rows(held: dict[int, np.ndarray], classes: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
        fps, sizes, tokens, places, owners, hot = [], [], [], [], [], []
        for owner, (fp, shingles) in enumerate(held.items()):
            kind = classes[(shingles & np.uint64(len(classes) - 1)).astype(np.int64)]
            order = np.lexsort((shingles, kind))[: prefix_length(len(shingles))]
            fps.append(fp)
            sizes.append(len(shingles))
            tokens.append(shingles[order])
            hot.append(kind[order] > 0)
            places.append(np.arange(len(order), dtype=np.int32))
            owners.append(np.full(len(order), owner, np.int32))
        tokens, places, owners, hot = map(np.concatenate, (tokens, places, owners, hot))
        tokens = mixed_all(tokens)
        fps, sizes = np.array(fps, np.int64), np.array(sizes, np.int32)
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        bucket[hot] = -1 - salt
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=buckets, append=buckets))
        codec = pa.Codec("zstd", 1)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            which = order[a:b]
            present, local = np.unique(owners[which], return_inverse=True)
            packed = (places[which], local.astype(np.int32), fps[present], sizes[present])
            blobs = [tokens[which].tobytes(), *(codec.compress(p.tobytes(), asbytes=True) if k != 2 else p.tobytes() for k, p in enumerate(packed))]
            yield batch_of(schema, [[bucket[which[0]]], *([x] for x in blobs)])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, size, salt = Sets(n), {}, 0, 0
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            shingles = sets.of(text)
            if len(shingles):
                held[fingerprint(shingles)] = shingles
                size += len(text)
            if size >= chunk_bytes:
                salt = hash((doc_id, size, len(held), salt)) & 0xFFFFFF
                yield from chunk_rows(held, sent.value, salt)
                held, size = {}, 0
        if held:
            yield from chunk_rows(held, sent.value, hash((size, len(held), salt)) & 0xFFFFFF)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, by_bucket = pa.Codec("zstd"), {}
        for bucket, *row in rows_of(batches, *schema.names):
            by_bucket.setdefault(bucket, []).append(row)
        for bucket, rows in by_bucket.items():
            found = []
            for tokens, places, owners, fps, sizes in rows:
                tokens, fps = np.frombuffer(tokens, np.uint64), np.frombuffer(fps, np.int64)
                whole = [np.frombuffer(codec.decompress(x, 4 * k, asbytes=True), np.int32) for x, k in ((places, len(tokens)), (owners, len(tokens)), (sizes, len(fps)))]
                found.append((tokens.view(np.int64), fps[whole[1]], whole[2][whole[1]], whole[0]))
            token, fp, size, pos = map(np.concatenate, zip(*found, strict=True))
            listed = np.full(len(token), FREQUENT_LIST, np.int32)
            if bucket >= 0:
                order = np.lexsort((fp, token))
                token, fp, size, pos = token[order], fp[order], size[order], pos[order]
                first = np.append(True, (token[1:] != token[:-1]) | (fp[1:] != fp[:-1]))  # of equal sets one
                token, fp, size, pos = token[first], fp[first], size[first], pos[first]
                starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
                lengths = np.diff(np.append(starts, len(token)))
                listed = np.repeat(lengths, lengths).astype(np.int32)
                keep = listed > 1
                token, fp, size, pos, listed = token[keep], fp[keep], size[keep], pos[keep], listed[keep]
            for a in range(0, len(token), 50_000):
                yield batch_of(entry, [x[a : a + 50_000] for x in (token, fp, size, pos, listed)])

    return texts.mapInArrow(releasing(index), PREFIX).repartition(buckets, "bucket").mapInArrow(releasing(shared), ENTRY)


def kept_entries(entries: DataFrame) -> DataFrame:
    """fp, n, weight (how many entries its lists have) and the entries (listed, token, pos) that it keeps, in their order, of each
    set that may have a partner. Buckets have few entries of a set each, so they are dealt as they are: lists of one or two take
    more room."""
    kept = F.array_sort(F.collect_set(F.struct("listed", "token", "pos"))).alias("kept")
    weight = F.sum(F.when(F.col("listed") < FREQUENT_LIST, F.col("listed")).otherwise(0)).alias("weight")
    sets = entries.repartition("fp").groupBy("fp", "n").agg(weight, kept)
    asked = shared_at_least(F.col("n")).cast("int")
    sets = sets.where(F.size("kept") >= asked)
    return sets.withColumn("kept", F.slice("kept", F.lit(1), F.size("kept") - asked + 1))


# --- 3, 4: candidates and verification -------------------------------------------------------------------


def leader_pairs(holders: DataFrame) -> DataFrame:
    """Pairs (a, b) of a list's leader and a member, which sizes do not rule out. Leaders are looked for among sets of similar
    size, so that a small set leaves no others without one. Of those the set in the longest lists leads, so that the lists of a
    group of near copies have the same few leaders."""
    band = F.floor(F.log("n") / float(np.log(DENOMINATOR / NUMERATOR))).cast("int")
    entries = holders.select("fp", "n", "weight", band.alias("band"), F.explode("kept.token").alias("token"))
    lead = entries.groupBy("token", "band").agg(F.max(F.struct("weight", "n", "fp")).alias("lead"))
    rows = entries.join(lead, ["token", "band"]).where(F.col("fp") != F.col("lead.fp"))
    similar = NUMERATOR * F.greatest("n", "lead.n") <= DENOMINATOR * F.least("n", "lead.n")
    return rows.where(similar).select(F.col("lead.fp").alias("a"), F.col("fp").alias("b")).distinct()


def candidate_sets(docs: DataFrame, slim: DataFrame, fps: DataFrame, n: int) -> DataFrame:
    """fp and n-grams of the sets in ``fps``, made again from the text of one document each, and of few others with an equal set."""
    chosen = stage(slim.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(fps, "fp", "left_semi"))
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(chosen, "doc_id"))
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(n)
        for batch in batches:
            ids = batch.column("doc_id")
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero(may_occur(bitmap.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ~named)
            rows = []
            for i in wanted.tolist():
                shingles = sets.of(batch.column("text")[i].as_py())
                if len(shingles):
                    rows.append((ids[i].as_py(), fingerprint(shingles), shingles.view(np.int64)))
            if rows:
                yield batch_of(schema, list(zip(*rows, strict=True)))

    made = keyed_texts(docs).mapInArrow(releasing(run), "doc_id long, fp long, shingles array<long>")
    return made.join(chosen, "fp", "left_semi").dropDuplicates(["fp"]).select("fp", "shingles")  # one shuffle: both by fp


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both sizes, overlap. Sets without a pair are not shuffled where the pairs, a written table, are small."""
    ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    sets = sets.join(ends, "fp", "left_semi")
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select(
        "a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("o")
    )


def linked():
    return (NUMERATOR + DENOMINATOR) * F.col("o") >= NUMERATOR * (F.col("na") + F.col("nb"))


def judged(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Of pairs of entries of one list, the first no larger than the second: those that the bounds leave open, as
    the fp of both."""
    new = (c["seen"][i] & c["seen"][j] == 0) & (c["comp"][i] != c["comp"][j])
    i, j = i[new], j[new]
    n, other = c["n"][i], c["n"][j]
    need = needed(n + other)
    good = NUMERATOR * other <= DENOMINATOR * n
    good &= (c["i"][i] == c["j"][i]) | (c["part"][i] != c["part"][j])
    good &= np.minimum(n - c["pos"][i], other - c["pos"][j]) + np.minimum(c["pos"][i], c["pos"][j]) >= need
    theirs, ours = c["family"][i], c["family"][j]  # 0: none. A family's pairs are answered, as are those with its leader
    good &= ~((theirs == ours) & (ours != 0) | (theirs == c["fp"][j]) | (ours == c["fp"][i]))
    return [c["fp"][i[good]], c["fp"][j[good]]]


def short_lists(c: dict[str, np.ndarray], lists: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Lists of one block each, all together: entries with those that follow them in their list."""
    order = np.lexsort((c["pos"], c["n"], lists))
    c, lists = {k: v[order] for k, v in c.items()}, lists[order]
    for step in range(1, BLOCK):
        i = np.flatnonzero(lists[step:] == lists[:-step])
        if not len(i):
            break
        yield judged(c, i, i + step)


def long_list(c: dict[str, np.ndarray]) -> Iterator[list[np.ndarray]]:
    """A list by length and position in blocks. Blocks whose lengths or first position rule the threshold out are
    skipped."""
    order = np.lexsort((c["pos"], c["n"]))
    c = {k: v[order] for k, v in c.items()}
    starts = np.arange(0, len(order), BLOCK)
    ends = np.append(starts[1:], len(order))
    least_n, most_n = c["n"][starts], c["n"][ends - 1]
    least_pos, most_pos = np.minimum.reduceat(c["pos"], starts), np.maximum.reduceat(c["pos"], starts)
    for i in range(len(order)):
        n, pos = c["n"][i], c["pos"][i]
        most = np.minimum(n - pos, most_n - least_pos) + np.minimum(pos, most_pos)
        blocks = (ends > i + 1) & (NUMERATOR * least_n <= DENOMINATOR * n) & (most >= needed(n + least_n))
        j = np.concatenate([np.empty(0, np.int64), *(np.arange(max(i + 1, starts[b]), ends[b]) for b in np.flatnonzero(blocks).tolist())])
        if len(j):
            yield judged(c, np.full(len(j), i), j)


def bits_of(seen: np.ndarray, owners: np.ndarray, rows: int) -> np.ndarray:
    """For each entry of a list a bit for each of the 64 most frequent n-grams that entries have seen."""
    tokens, place, times = np.unique(seen, return_inverse=True, return_counts=True)
    bit = np.full(len(tokens), 64, np.uint8)
    top = np.argsort(-times, kind="stable")[:64]
    bit[top] = np.arange(len(top))
    which = bit[place]
    out = np.zeros(rows, np.uint64)
    known = which < 64
    np.bitwise_or.at(out, owners[known], np.uint64(1) << which[known].astype(np.uint64))
    return out


def with_component(sets: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("node").alias("fp"), F.col("component").alias("comp"))
    return sets.join(known, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def families(first: DataFrame) -> DataFrame:
    """fp, family (the leader's fp) and comp (the leader's fp where the two are linked) of sets with a quarter of their
    n-grams in common with a leader."""
    near = first.where(4 * F.col("o") >= F.col("nb")).select("a", "b", linked().alias("linked"))
    stars = near.groupBy("a").agg(F.count("*").alias("stars"))
    best = near.join(stars, "a").groupBy(F.col("b").alias("fp")).agg(F.max(F.struct("stars", "a", "linked")).alias("best"))
    return best.select("fp", F.col("best.a").alias("family"), F.when(F.col("best.linked"), F.col("best.a")).otherwise(F.col("fp")).alias("comp"))


def cell_links(fps: list[int], comps: list[int], parts: list[int], crossing: bool, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of the sets of a cell; of sets of different parts only if it is ``crossing``."""
    owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    tokens, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.full(len(tokens), -1)
    frequent = np.argsort(-times, kind="stable")[:COLUMNS_AT_ONCE]
    frequent = frequent[times[frequent] > 1]
    column[frequent] = np.arange(len(frequent))
    column = column[place]
    table = np.zeros((len(sets), len(frequent)), np.float32)
    table[owners[column >= 0], column[column >= 0]] = 1
    beside = (column < 0) & (times[place] > 1)
    left = np.bincount(owners[beside], minlength=len(sets))
    cuts = np.append(0, np.cumsum(left))
    rest = [place[beside][a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    n, comp, part = np.array([len(x) for x in sets]), np.array(comps), np.array(parts)
    root = {c: c for c in comps}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for a in range(0, len(sets), ROWS_AT_ONCE):
        rows = slice(a, a + ROWS_AT_ONCE)
        common = table[rows] @ table[a:].T
        need = needed(n[rows, None] + n[None, a:])
        open_ = (common + np.minimum(left[rows, None], left[None, a:]) >= need) & (comp[rows, None] != comp[None, a:])
        if crossing:
            open_ &= part[rows, None] != part[None, a:]
        for i, j in np.argwhere(np.triu(open_, 1)).tolist():
            x, y = top(comps[a + i]), top(comps[a + j])
            if x != y:
                o = common[i, j] + len(np.intersect1d(rest[a + i], rest[a + j], assume_unique=True))
                if o >= need[i, j]:
                    out.append((fps[a + i], fps[a + j]))
                    root[max(x, y)] = min(x, y)
    return out


def family_links(sets: DataFrame, family: DataFrame, cell: int) -> DataFrame:
    """Links (a, b) that join the components of the sets within each family. ``cell``: n-grams of a part, in which a
    short set counts for ``SHORT``."""
    rows = stage(sets.join(family, "fp"))
    size = F.sum(F.greatest(F.size("shingles"), F.lit(SHORT)))
    mixed = rows.groupBy("family").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), size.alias("size"))
    mixed = mixed.where("low <> high").select("family", F.ceil(F.col("size") / cell).cast("int").alias("parts"))
    rows = rows.join(mixed, "family").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def answered() -> pa.RecordBatch:
            fps, comps, parts, sets = map(list, zip(*held, strict=True))
            found = cell_links(fps, comps, parts, key[1] != key[2], sets) if len(set(comps)) > 1 else []
            return batch_of(schema, list(zip(*found, strict=True)) or [[], []])

        for batch in batches:
            shingles = batch.column("shingles")
            plain = [batch.column(c).to_pylist() for c in ("family", "i", "j", "fp", "comp", "part")]
            for k, (*own, fp, comp, part) in enumerate(zip(*plain, strict=True)):
                if own != key and held:
                    yield answered()
                    held = []
                key = own
                held.append((fp, comp, part, shingles[k].values.to_numpy()))
        if held:
            yield answered()

    dealt = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.select(*(c.split()[0] for c in FAMILY.split(", "))).mapInArrow(releasing(run), PAIR)


def open_pairs(holders: DataFrame, labels: DataFrame, family: DataFrame, cell: int) -> DataFrame:
    """Pairs (a, b) of sets in different components and families that the bounds leave open."""
    sets = stage(with_component(holders.drop("weight"), labels).join(family.select("fp", "family"), "fp", "left").na.fill(0, ["family"]))
    rows = sets.select(*[c for c in sets.columns if c != "kept"], F.col("kept.token").alias("before"), F.posexplode("kept").alias("place", "entry"))
    first = F.greatest(F.col("place") - SEEN, F.lit(0))
    rows = rows.withColumn("seen", F.slice("before", first + 1, F.col("place") - first)).select("*", "entry.token", "entry.pos").drop("before", "entry", "place")
    mixed = sets.select("comp", F.explode("kept.token").alias("token")).groupBy("token").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows")
    )
    long = mixed.where((F.col("low") != F.col("high")) & (F.col("rows") > cell)).select("token", F.ceil(F.col("rows") / cell).cast("int").alias("parts"))
    rows = rows.join(stage(long), "token", "left").na.fill(1, ["parts"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ["token", "i", "j", "fp", "n", "pos", "comp", "family", "part"]

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
        """Rows of whole lists, which come sorted, and where each list begins. Lists of one component are left out;
        what the others' entries have seen becomes bits."""
        held: list[pa.RecordBatch] = []
        total = 0

        def rows(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
            c = {k: table.column(k).to_numpy() for k in names}
            new = np.any([c[k][1:] != c[k][:-1] for k in ("token", "i", "j")], axis=0)
            return c, np.flatnonzero(np.append(True, new))

        def open_lists(table: pa.Table, c: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
            ends = np.append(starts[1:], len(c["n"]))
            mixed = np.minimum.reduceat(c["comp"], starts) != np.maximum.reduceat(c["comp"], starts)
            if mixed.any():
                seen = table.column("seen").combine_chunks()
                offsets, tokens = seen.offsets.to_numpy(), seen.values.to_numpy()
                c["seen"] = np.zeros(len(c["n"]), np.uint64)
                for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
                    cuts = offsets[a : b + 1]
                    c["seen"][a:b] = bits_of(tokens[cuts[0] : cuts[-1]], np.repeat(np.arange(b - a), np.diff(cuts)), b - a)
                keep = np.repeat(mixed, ends - starts)
                sizes = (ends - starts)[mixed]
                yield {k: v[keep] for k, v in c.items()}, np.cumsum(sizes) - sizes

        for batch in batches:
            held.append(batch)
            total += batch.num_rows
            if total >= LISTED:
                table = pa.Table.from_batches(held).combine_chunks()
                c, starts = rows(table)
                last = starts[-1]  # it may go on
                if last:
                    yield from open_lists(table[:last], {k: v[:last] for k, v in c.items()}, starts[:-1])
                rest = table[last:]
                held, total = rest.to_batches(), rest.num_rows
        if total:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from open_lists(table, *rows(table))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for c, starts in complete(batches):
            sizes = np.diff(np.append(starts, len(c["n"])))
            lists = np.repeat(np.arange(len(starts)), sizes)
            short = (sizes <= BLOCK)[lists]
            if short.any():
                yield from short_lists({k: v[short] for k, v in c.items()}, lists[short])
            for k in np.flatnonzero(sizes > BLOCK).tolist():
                yield from long_list({x: v[starts[k] : starts[k] + sizes[k]] for x, v in c.items()})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for found in searched(batches):
            held.append(found)
            total += len(found[0])
            if total >= PAIRS_AT_ONCE:
                yield batch_of(schema, [np.concatenate(x) for x in zip(*held, strict=True)])
                held, total = [], 0
        if total:
            yield batch_of(schema, [np.concatenate(x) for x in zip(*held, strict=True)])

    dealt = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    pairs = dealt.select(*names, "seen").mapInArrow(releasing(search), PAIR)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, n: int = NGRAM, slots: int = SKETCH_SLOTS, chunk_bytes: int = CHUNK_BYTES, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """The documents' sets (doc_id, n_shingles, fp) and links (a, b) between different sets that hold the
    components together: every pair that reaches the threshold is linked or lies inside a component of links."""
    texts = keyed_texts(docs)
    slim = stage(slim_sets(texts, n, slots))
    classes = frequency_class(slim, slots)
    slim = slim.where("part IS NULL").select("doc_id", "n_shingles", "fp")
    entries = prefix_entries(texts, classes, n, partitions(docs.sparkSession), chunk_bytes)
    holders = stage(kept_entries(entries))
    sets = stage(candidate_sets(docs, slim, holders.select("fp"), n))
    first = stage(overlaps(stage(leader_pairs(holders)), sets))
    found = first.where(linked()).select("a", "b")
    family = stage(families(first))
    found = stage(found.unionByName(family_links(sets, family, FAMILY_CELL)))
    second = stage(open_pairs(holders, components(found), family, cell))
    unsettled = stage(second.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    return slim, found.unionByName(overlaps(unsettled, sets).where(linked()).select("a", "b"))


def classes_of(docs: DataFrame, n: int = NGRAM, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    slim, found = links(docs, n, **options)
    labels = components(found).select(F.col("node").alias("fp"), F.col("component").alias("class"))
    sets = slim.groupBy("fp").agg(F.min("doc_id").alias("least")).where("fp IS NOT NULL").join(labels, "fp", "left")
    sets = stage(sets.withColumn("class", F.coalesce("class", "fp")))
    least = sets.groupBy("class").agg(F.min("least").alias("component_id"))
    named = sets.join(least, "class").select("fp", "component_id")
    alone = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return slim.join(named, "fp", "left").select("doc_id", "n_shingles", alone.alias("component_id"))
