"""Ordering and bounds: O1, O2, O3, U1, U2, W5, A2, F17 and the digest rows of K4."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fixed
from ..functions.text import score_bar
from ..schemas import ORDER
from .predicates import in_lane, score_kept


def by_score(df: DataFrame, order: Sequence[str] = tuple(ORDER)) -> DataFrame:
    """O1. Score descending, ties in arrival order."""
    return df.orderBy(F.desc("score"), *order)


def top_per_lane(
    df: DataFrame,
    k: int = fixed.DIGEST_ROWS,
    lane: str = "category",
    score: str = "score",
    order: Sequence[str | Column] = tuple(ORDER),
    rank: str = "rank",
) -> DataFrame:
    """W5. The best ``k`` of each lane with their rank.

    The group limit below the shuffle passes on at most ``k`` rows per lane and task.
    """
    best = Window.partitionBy(lane).orderBy(F.desc(score), *order)
    return df.withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= k)


def first_per_group(df: DataFrame, group: str, n: int, order: Sequence[str]) -> DataFrame:
    """O3. The first ``n`` rows each query asks of its feed."""
    nth = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= n).drop("_nth")


def lane_counts(df: DataFrame, lane: str = "category") -> DataFrame:
    """A2. All kept rows of each lane, not only those shown."""
    return df.groupBy(lane).agg(F.count("*").alias("rows"))


def split_by_score(df: DataFrame, threshold: int = fixed.KEEP_SCORE) -> tuple[DataFrame, DataFrame]:
    """F17. Kept rows and their complement."""
    kept = score_kept("score", threshold)
    return df.where(kept), df.where(~kept)


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """U1. Bag union; the order is in ``batch_seq`` and ``pos``."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def bounded_store(
    kept: DataFrame,
    existing: DataFrame | None,
    rows: int = fixed.STORE_ROWS,
    run: str = "added",
    order: Sequence[str] = tuple(ORDER),
) -> DataFrame:
    """O2, U2, T3. New rows before existing ones, newest run first, arrival order within a run."""
    stored = kept if existing is None else kept.unionByName(existing)
    return stored.orderBy(F.desc(run), *order).limit(rows)


def digest(
    kept: DataFrame, lanes: Sequence[str] = tuple(fixed.LANES), k: int = fixed.DIGEST_ROWS
) -> DataFrame:
    """K4. The best rows of each lane with bar and lane count.

    The counts are a table with one row per lane; its size is the number of lanes given.
    """
    shown = kept.where(in_lane("category", lanes))
    ranked = top_per_lane(shown, k)
    counts = lane_counts(shown).withColumnRenamed("rows", "lane_rows")
    return (
        ranked.join(F.broadcast(counts), "category")
        .select(
            "category", "rank", "title", "url", "company", "salary",
            score_bar("score").alias("dots"), "score", "score_reason", "lane_rows",
        )
    )
