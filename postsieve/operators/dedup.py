"""First-wins operators: W1, W2, W3, W6, A3 and the cross-batch url test J3.

Arrival order is data (``batch_seq``, ``pos``); nothing here depends on partition order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import ORDER
from .skew import HOT_ROWS, hot_keys, spread_join


def keep_lowest(
    df: DataFrame,
    key: str,
    rank: str,
    spread_by: Sequence[str] = tuple(ORDER),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All rows whose ``rank`` is the lowest one of their key; ties stay.

    A window would send every row of a key to one task. Here the lowest rank per key comes from an
    aggregation that combines before its shuffle, and the rows meet it in a join which deals out hot
    keys. ``df`` is read twice: stage it first where it is expensive.
    """
    lowest = df.groupBy(key).agg(F.min(rank).alias(rank), F.count("*").alias("_rows"))
    # Both readers of this aggregation keep both of its columns, so its one shuffle serves both.
    lowest = lowest.where(F.col(key).isNotNull() & F.col(rank).isNotNull() & (F.col("_rows") > 0))
    hot = hot_keys(lowest, [key], hot_rows, count=F.col("_rows"))
    return spread_join(
        df, lowest.drop("_rows"), [key, rank], "left_semi", spread_by, hot, hot_on=[key]
    ).select(df.columns)


def first_batch_wins(
    df: DataFrame, key: str = "url", batch: str = "batch_seq", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """W1, J3. Rows of the first batch that brought the url; repeats inside that batch stay.

    Filter first: only rows that passed their policy register a url.
    """
    return keep_lowest(df, key, batch, ORDER, hot_rows)


def strategy_fallback(
    df: DataFrame, key: str, strategy: str = "strategy", spread_by: Sequence[str] = ("pos",), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """W6. Rows of the lowest strategy that gave anything for their message."""
    return keep_lowest(df, key, strategy, spread_by, hot_rows)


def first_row_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column] = tuple(ORDER)) -> DataFrame:
    """W2, W3. One row per key, the first by ``order``.

    The filter on the row number gives a group limit before the shuffle, so each task passes on at
    most one row per key and a hot key cannot pile up in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def first_row_per_url(df: DataFrame, url: str = "url", order: Sequence[str | Column] = ("msg_seq", "pos")) -> DataFrame:
    """W3. Empty urls are dropped."""
    return first_row_per_key(df.where(F.coalesce(F.col(url), F.lit("")) != ""), url, order)


def shortest_per_key(
    df: DataFrame, keys: Sequence[str], text: str = "title", pos: str = "pos", length: Column | None = None
) -> DataFrame:
    """A3. The row with the shortest text per key, the earliest among equals, at the position where
    the key first appeared. ``length`` replaces the plain text length."""
    by = F.struct(length if length is not None else F.length(text), F.col(pos))
    rest = [c for c in df.columns if c not in (*keys, pos)]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), by).alias("_row"), F.min(pos).alias(pos))
        .select(*keys, pos, "_row.*")
        .select(df.columns)
    )
