"""Joins that stay balanced when one key holds a large share of the rows.

The hot keys are found by a counting pass with map-side combine, which shuffles one row per key and
task. At most ``MAX_HOT_KEYS`` 64-bit hashes are broadcast (80 kB), whatever the size of the data; keys
outside that list hold less than 1/``MAX_HOT_KEYS`` of all rows each and take the ordinary shuffle
join. Rows of a hot key are dealt to slices by a hash of their own columns, so a repeated task deals them
out the same way; the counting pass has told how many slices of at most ``hot_rows / 4`` rows a key needs,
and the matching row of the other side is repeated per slice. Rows with a null key match nothing and are dealt
out as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
NULL_SLICES = 1 << 20  # tasks take what hashes to them: there may be more of these than tasks

_HASH, _SLICE, _SLICES = "_key_hash", "_slice", "_slices"


def hot_keys(
    rows: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS, count: Column | None = None
) -> DataFrame:
    """Hashes of the keys with at least ``hot_rows`` rows, and the slices each needs.

    ``count`` names a column of ready counts, for callers that have them from an aggregation already.
    """
    hashed = F.xxhash64(*on).alias(_HASH)
    counts = (
        rows.select(hashed, count.alias("n"))
        if count is not None
        else rows.select(hashed).groupBy(_HASH).agg(F.count("*").alias("n"))
    )
    return (
        counts.where(F.col("n") >= hot_rows)
        .orderBy(F.desc("n"), _HASH)
        .limit(MAX_HOT_KEYS)
        .groupBy(_HASH)
        .agg(F.ceil(F.sum("n") * 4 / hot_rows).cast("int").alias(_SLICES))
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    hot: DataFrame,
    hot_on: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join (``left``, ``inner``, ``left_semi``, ``left_anti``) that deals out hot left keys.

    ``right`` holds few rows per key (one, as a rule). ``hot_on``: the columns the hot hashes were
    taken of, a subset of ``on``.
    """
    hashed = F.xxhash64(*(hot_on or on))
    flags = F.broadcast(hot)

    def flagged(df: DataFrame) -> DataFrame:
        return df.withColumn(_HASH, hashed).join(flags, _HASH, "left")

    unmatched = reduce(or_, [F.col(c).isNull() for c in on])
    dealt = flagged(left).withColumn(
        _SLICE,
        F.when(unmatched, F.pmod(F.xxhash64(*spread_by), F.lit(NULL_SLICES)))
        .when(F.col(_SLICES).isNotNull(), F.pmod(F.xxhash64(*spread_by), F.col(_SLICES)))
        .otherwise(F.lit(0))
        .cast("int"),
    )
    repeated = flagged(right).withColumn(
        _SLICE,
        F.explode(
            F.when(F.col(_SLICES).isNotNull(), F.sequence(F.lit(0), F.col(_SLICES) - 1)).otherwise(F.array(F.lit(0)))
        ),
    )
    joined = dealt.join(repeated.drop(_HASH, _SLICES), [*on, _SLICE], how)
    return joined.drop(_HASH, _SLICES, _SLICE)
