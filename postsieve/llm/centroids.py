"""Clustering of integer vectors by centroids in exact arithmetic, with a table of distances to pivots.

Every vector is kept as integers, its distances to a few fixed pivots are worked out once, and both are written as a
table (LAESA). In each round the distances from the pivots to all centroids are known as well, and by the triangle
inequality |d(vector, pivot) - d(centroid, pivot)| is at most d(vector, centroid). The largest of these differences over
the pivots bounds each centroid from below; a vector meets centroids in the order of their bounds and gets exact
integer distances to them until a bound exceeds the least distance found. Bounds are rounded down by far more than
floating point can err, so no centroid is lost by them; of equal distances the smaller number wins.

A task gives its sums per centroid, Spark adds them up as decimals, and the driver holds the centroids and their sums
only: as many numbers as centroids and components. Pivots are the starting centroids that lie farthest apart, taken
one by one.

Edge cases: vectors that are null, of another length or with null or non-finite components are left out. Of rows
with one id (repeated rows) each is a vector; as starting centroids they are taken in the order of their components. A null
id comes last in that order. With fewer vectors than centroids there are as many centroids as vectors; an empty table
gives no rows. Components that leave 62 bits as integers, and distances that leave 64, end the query with an
error, as Spark's own arithmetic does. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import batch_of

COMPONENTS = 64
CENTROIDS = 40
ROUNDS = 5
PIVOTS = 8
SCALE = 256
SALT = "2:"
AT_ONCE = 2048
SAFE = 1 << 27  # squares of differences of such numbers, summed over up to 64 components, fit 64 bits
MOST = 1 << 62
ROOM = 1e-9


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two arrays, as integers of any size where 64 bits may not do."""
    if x.size and max(np.abs(x).max(), np.abs(y).max()) > SAFE * (64 / x.shape[1]) ** 0.5:
        x, y = x.astype(object), y.astype(object)
    d = x - y
    return (d * d).sum(1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def integers(batch: pa.RecordBatch, components: int) -> tuple[pa.Array, np.ndarray]:
    """The ids of the vectors that count, and their components as integers."""
    vectors = batch.column("vector")
    fit = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == components)
    vectors, ids = vectors.take(pa.array(fit)), batch.column("id").take(pa.array(fit))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, components)
    good = np.isfinite(flat).all(1)  # nulls have become NaN
    scaled = np.floor(SCALE * flat[good])
    if scaled.size and np.abs(scaled).max() > MOST:
        raise OverflowError("a component leaves 62 bits")
    return ids.filter(pa.array(good)), scaled.astype(np.int64)


def integer_vectors(vectors: DataFrame, key: str, vector: str, components: int) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = integers(batch, components)
            yield batch_of(schema, [ids, [row.tobytes() for row in x]])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "id long, x binary")


def first_centroids(rows: DataFrame, count: int, salt: str) -> np.ndarray:
    """The vectors with the smallest hashes of their id, in that order."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    found = rows.orderBy(digest.asc_nulls_last(), "x").limit(count).select("x").collect()
    return np.array([np.frombuffer(r.x, np.int64) for r in found])


def far_apart(centroids: np.ndarray, count: int) -> np.ndarray:
    """Pivots: the first centroid, then again and again the one farthest from all taken."""
    taken = [0]
    nearest = squared(centroids, centroids[:1].repeat(len(centroids), 0))
    while len(taken) < count and max(nearest) > 0:
        taken.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, squared(centroids, centroids[taken[-1:]].repeat(len(centroids), 0)))
    return centroids[taken]


def with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The pivot table: id, components and the distance to each pivot."""
    schema = pa.schema([("id", pa.int64()), ("x", pa.binary()), ("d", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = numbers(batch, pivots.shape[1])
            d = np.stack([roots(squared(x, p[None].repeat(len(x), 0))) for p in pivots], 1)
            yield batch_of(schema, [batch.column("id"), batch.column("x"), [row.tobytes() for row in d]])

    return rows.mapInArrow(run, "id long, x binary, d binary")


def numbers(batch: pa.RecordBatch, components: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(-1, components)


def nearest(x: np.ndarray, d: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of each vector, and how many distances that took."""
    bound = np.zeros((len(x), len(centroids)))
    for p in range(d.shape[1]):
        mine, theirs = d[:, p, None], to_pivots[None, :, p]
        np.maximum(bound, np.abs(mine - theirs) - ROOM * (mine + theirs), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1) ** 2 * (1 - ROOM)
    number = order[:, 0].copy()
    least = squared(x, centroids[number])
    done = len(x)
    rows = np.arange(len(x))
    for k in range(1, len(centroids)):
        rows = rows[bound[rows, k] <= least[rows].astype(np.float64)]
        if not len(rows):
            break
        other = order[rows, k]
        found = squared(x[rows], centroids[other])
        done += len(rows)
        better = (found < least[rows]) | (found == least[rows]) & (other < number[rows])
        if found.dtype == object and least.dtype != object:
            least = least.astype(object)
        least[rows[better]], number[rows[better]] = found[better], other[better]
    return number, least, done


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, to_pivots: np.ndarray) -> Iterator[tuple]:
    """Per some rows: ids, vectors, numbers of their centroids, squared distances, distances worked out."""
    for whole in batches:
        for a in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(a, AT_ONCE)
            x = numbers(batch, centroids.shape[1])
            d = np.frombuffer(b"".join(batch.column("d").to_pylist()), np.float64).reshape(len(x), -1)
            yield batch.column("id"), x, *nearest(x, d, centroids, to_pivots)


SUMS = "cluster int, n long, done long, sums array<decimal(38,0)>"


def moved(table: DataFrame, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after one round, and how many distances were worked out."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("done", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, total = np.zeros((k, width), object), np.zeros(k, np.int64), 0
        for _, x, number, _, done in assigned(batches, centroids, to_pivots):
            total += done
            counts += np.bincount(number, minlength=k)
            wide = x if np.abs(x).max(initial=0) <= SAFE else x.astype(object)
            for c in np.unique(number).tolist():
                sums[c] += wide[number == c].sum(0)
        rows = [(c, int(counts[c]), 0, [Decimal(int(s)) for s in sums[c]]) for c in np.flatnonzero(counts).tolist()]
        yield batch_of(schema, list(zip(*rows, (0, 0, total, [Decimal(0)] * width), strict=True)))

    parts = table.mapInArrow(run, SUMS)
    counts = [F.sum(c).alias(c) for c in ("n", "done")]
    found = parts.groupBy("cluster").agg(*counts, *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width))).collect()
    new = centroids.copy()
    for row in found:
        if row.n:
            new[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(width)]
    return new, sum(row.done for row in found)


def with_clusters(table: DataFrame, centroids: np.ndarray, to_pivots: np.ndarray) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, least, _ in assigned(batches, centroids, to_pivots):
            yield batch_of(schema, [ids, number.astype(np.int32), least.tolist()])

    return table.mapInArrow(run, "id long, cluster int, distance long")


def pivot_distances(centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([roots(squared(centroids, p[None].repeat(len(centroids), 0))) for p in pivots], 1)


def clusters(
    vectors: DataFrame,
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    salt: str = SALT,
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """A written table of id, cluster and squared distance; the final centroids; and for each round how many exact
    distances were worked out."""
    rows = stage(integer_vectors(vectors, key, vector, components))
    centroids = first_centroids(rows, count, salt)
    if not len(centroids):
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, []
    fixed = far_apart(centroids, pivots)
    table = stage(with_pivots(rows, fixed))
    worked = []
    for _ in range(rounds):
        centroids, done = moved(table, centroids, pivot_distances(centroids, fixed))
        worked.append(done)
    return stage(with_clusters(table, centroids, pivot_distances(centroids, fixed))), centroids, worked


def clustering(vectors: DataFrame, key: str = "vec_id", **options) -> DataFrame:
    """Per vector: its id, cluster, distance, cluster_inertia, inertia and the digest of its centroid."""
    found, centroids, _ = clusters(vectors, key=key, **options)
    spark = vectors.sparkSession
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row per centroid
    total = sum(int(row.s) for row in sums)
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    rows = [(row.cluster, int(row.s), total, digests[row.cluster]) for row in sums]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(of), "cluster")
    return joined.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
