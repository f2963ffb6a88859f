"""Near-duplicate vectors by collision-counting projections.

Vectors are scaled to length one, where cosine and distance are the same thing. Every vector is projected on
many random lines. Two vectors collide on a line when the one lies in the window centred on the other; a pair at
the threshold collides on each line with a known chance, so the count of collisions that it reaches with the wished
recall is known too (``calibrated``). Sorted projections give each vector's window as a range; pairs whose count
reaches the calibrated one are compared in double precision, so no link is ever false.

Not all vectors are sorted together: a round deals them into cells by the sides of some more random planes, and
windows are counted inside cells. The number of planes follows the number of vectors, the number of rounds
follows from the planes and the recall. A pair that met in an earlier round is left to that round, so nothing
is counted twice and no pair is ever written: a task passes on, per vector, how many links it found and
a forest of links that joins the same vectors. Equal vectors are one vector with a number of copies; cells
above ``cell`` vectors are cut, and each two of their parts meet in a task of their own.

Edge cases: a vector that is null, empty, zero, or has null, infinite or NaN components, or whose vec_id is null,
links with nothing. Vectors of different lengths do not link. Rows that repeat a vec_id count as vectors
of their own. Empty tables give empty results; other columns, labels included, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import batch_of, components

THRESHOLD = 0.95
RECALL = 0.995
LINES = 24
COLLIDES = 0.9
CELL = 4096
PER_CELL = 8
SEED = 20_240_601
GAP = 64.0
SLOTS = 4_000_000

DEALT = "round int, cell long, rep long, copies long, vector binary"
FOUND = "rep long, links long, parent long"


def calibrated(lines: int, collides: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with the wished chance."""
    chance, below = 0.0, 0
    for count in range(lines + 1):
        chance += math.comb(lines, count) * collides**count * (1 - collides) ** (lines - count)
        if chance > 1 - recall:
            break
        below = count + 1
    return below


class Plan:
    """What all tasks agree on: planes and lines per vector length, rounds, window and count."""

    def __init__(self, vectors: int, threshold: float, recall: float, lines: int, collides: float):
        self.planes = max(4, math.ceil(math.log2(max(2, vectors / PER_CELL))))
        same_side = (1 - math.acos(threshold) / math.pi) ** self.planes
        share = recall + (1 - recall) / 2  # half of what may be missed by the rounds, half by the count
        self.rounds = math.ceil(math.log(1 - share) / math.log(1 - same_side))
        self.threshold, self.lines = threshold, lines
        low, high = 0.0, 8.0
        for _ in range(60):  # half a window, in standard deviations of a pair at the threshold
            middle = (low + high) / 2
            low, high = (middle, high) if math.erf(middle / math.sqrt(2)) < collides else (low, middle)
        self.half = low * math.sqrt(2 - 2 * threshold)
        self.count = calibrated(lines, collides, share)

    def planes_of(self, width: int) -> np.ndarray:
        return np.random.default_rng([SEED, width]).standard_normal((width, self.rounds * self.planes))

    def lines_of(self, width: int) -> np.ndarray:
        return np.random.default_rng([SEED, width, 1]).standard_normal((width, self.lines))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector in each round."""
        sides = (unit @ self.planes_of(unit.shape[1]) > 0).reshape(len(unit), self.rounds, self.planes)
        return sides @ (1 << np.arange(self.planes, dtype=np.int64)) * 4096 + unit.shape[1] % 4096


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    largest = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / largest  # squares neither overflow nor vanish
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def judged(table: DataFrame) -> DataFrame:
    """vec_id, vector (DOUBLEs, -0.0 as 0.0) and whether the row may link."""
    plain = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = table.select(F.col("vec_id").cast("long"), plain.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    return rows.withColumn("good", F.coalesce(good, F.lit(False)))


def distinct_vectors(table: DataFrame) -> DataFrame:
    """rep (smallest vec_id), copies and vector of every distinct vector; copies are counted before the shuffle."""
    return judged(table).where("good").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def dealt(reps: DataFrame, plan: Plan) -> DataFrame:
    """A row per vector and round: its cell."""
    schema = pa.schema([("round", pa.int32()), ("cell", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000).to_pydict()
                widths = np.array([len(v) for v in part["vector"]])
                for width in np.unique(widths).tolist():
                    which = np.flatnonzero(widths == width).tolist()
                    vectors = [np.array(part["vector"][i], np.float64).tobytes() for i in which]
                    cells = plan.cells(unit_rows(vectors))
                    ids, copies = ([part[c][i] for i in which] for c in ("rep", "copies"))
                    for r in range(plan.rounds):
                        yield batch_of(schema, [[r] * len(which), cells[:, r], ids, copies, vectors])

    return reps.mapInArrow(run, DEALT)


def cut_cells(rows: DataFrame, cell: int) -> DataFrame:
    """Cells above ``cell`` vectors in parts; a vector goes to every pair of parts that has its own."""
    sizes = rows.groupBy("round", "cell").agg(F.count("*").alias("n"))
    shared = sizes.where("n > 1").select("round", "cell", F.ceil(F.col("n") / cell).cast("int").alias("parts"))
    rows = rows.join(shared, ["round", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts")


class Forest:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def windows(keys: np.ndarray, half: float, queries: slice) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) of all collisions of one line; ``keys`` hold the cell too, far apart."""
    order = np.argsort(keys, kind="stable")
    line, mine = keys[order], keys[queries]
    low, high = np.searchsorted(line, mine - half), np.searchsorted(line, mine + half, side="right")
    n = high - low
    query = np.repeat(np.arange(len(mine)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return query, order[place]


def counted(unit: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of one cell whose collisions reach the count. Vectors are sorted by cell, cell k from
    ``starts[k]`` on; queries go in blocks whose counters fit in ``SLOTS``."""
    n = len(unit)
    lines = unit @ plan.lines_of(unit.shape[1])
    begin = 0
    while begin < n:
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), SLOTS)))
        width = sizes[begin:end]
        base = np.cumsum(width) - width
        counts = np.zeros(int(width.sum()), np.uint8)
        for k in range(plan.lines):
            query, member = windows(keys * GAP + lines[:, k], plan.half, slice(begin, end))
            counts[base[query] + member - starts[begin + query]] += 1
        slot = np.flatnonzero(counts >= plan.count)
        query = np.searchsorted(base, slot, side="right") - 1
        i, j = begin + query, slot - base[query] + starts[begin + query]
        later = i < j
        yield i[later], j[later]
        begin = end


def links_of_cells(rows: DataFrame, plan: Plan) -> DataFrame:
    """Per vector and task: the weight of the links found, and a link of a forest over them."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])

    def cells(held: dict[str, np.ndarray], vectors: list[bytes], forest: Forest, links: dict[int, int]) -> None:
        order = np.lexsort((held["cell"], held["round"], held["i"], held["j"]))
        held = {k: v[order] for k, v in held.items()}
        unit = unit_rows([vectors[k] for k in order.tolist()])
        edge = np.append(True, np.any([held[c][1:] != held[c][:-1] for c in ("cell", "round", "i", "j")], axis=0))
        keys = (np.cumsum(edge) - 1).astype(np.float64)
        firsts = np.flatnonzero(edge)
        number = np.cumsum(edge) - 1
        sizes = np.diff(np.append(firsts, len(order)))[number]
        codes = plan.cells(unit)
        for i, j in counted(unit, keys, firsts[number], sizes, plan):
            across = (held["i"][i] == held["j"][i]) | (held["part"][i] != held["part"][j])
            i, j = i[across], j[across]
            for a in range(0, len(i), 50_000):
                x, y = i[a : a + 50_000], j[a : a + 50_000]
                met = np.argmax(codes[x] == codes[y], axis=1) < held["round"][x]
                x, y = x[~met], y[~met]
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= plan.threshold
                x, y = x[near], y[near]
                ids, copies = held["rep"], held["copies"]
                for mine, theirs in ((x, y), (y, x)):
                    who, where = np.unique(ids[mine], return_inverse=True)
                    for v, w in zip(who.tolist(), np.bincount(where, copies[theirs]).astype(np.int64).tolist(), strict=True):
                        links[v] = links.get(v, 0) + w
                for v, w in zip(ids[x].tolist(), ids[y].tolist(), strict=True):
                    forest.join(v, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["round", "cell", "i", "j", "part", "rep", "copies"]
        held, vectors, last = [], [], None
        forest, links = Forest(), {}

        def flush() -> None:
            columns = {c: np.concatenate([h[c] for h in held]) for c in names}
            lengths = np.array([len(v) for v in vectors])
            for width in np.unique(lengths).tolist():
                which = np.flatnonzero(lengths == width)
                cells({c: v[which] for c, v in columns.items()}, [vectors[k] for k in which.tolist()], forest, links)

        for batch in batches:  # sorted by cell
            columns = {c: batch.column(c).to_numpy() for c in names}
            blobs = batch.column("vector").to_pylist()
            keys = np.stack([columns[c] for c in ("round", "cell", "i", "j")])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            cuts = [0, *new.tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(keys[:, a].tolist())
                if held and now != last and len(vectors) >= 2 * CELL:
                    flush()
                    held, vectors = [], []
                last = now
                held.append({c: columns[c][a:b] for c in names})
                vectors += blobs[a:b]
        if held:
            flush()
        ids = list(links)
        for a in range(0, len(ids), 10_000):
            part = ids[a : a + 10_000]
            yield batch_of(schema, [part, [links[v] for v in part], [forest.root(v) for v in part]])

    keys = ["round", "cell", "i", "j"]
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_rows.select("round", "cell", "i", "j", "part", "rep", "copies", "vector").mapInArrow(run, FOUND)


def dedup(
    table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, lines: int = LINES,
    collides: float = COLLIDES, cell: int = CELL,
) -> DataFrame:
    """Per row of ``table`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    reps = stage(distinct_vectors(table))
    plan = Plan(reps.count(), threshold, recall, lines, collides)
    found = stage(links_of_cells(cut_cells(stage(dealt(reps, plan)), cell), plan))
    labels = components(found.select(F.col("rep").alias("a"), F.col("parent").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        reps.select("rep", "copies", "vector").join(linked, "rep", "left")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    rows = judged(table)
    good = rows.where("good").join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return good.unionByName(alone).withColumn("kept", kept)
