"""Lookups as joins: enrichment (J1) and long term lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schemas import ORDER
from .skew import HOT_ROWS, hot_keys, spread_join
from .term_index import rows_with_terms


def enrich(
    rows: DataFrame,
    details: DataFrame,
    key: str = "external_id",
    value: str = "detail",
    into: str = "description",
    spread_by: Sequence[str] = tuple(ORDER),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """J1. Detail text by id, empty on a miss or without an id. Should a detail have landed more than
    once, the same one is taken each time, and not an empty one.

    The rows are read twice, for the hot ids and for the join: stage them first where they are costly.
    """
    found = details.groupBy(key).agg(F.max(value).alias("_detail"))
    joined = spread_join(rows, found, [key], "left", spread_by, hot_keys(rows.where(F.col(key).isNotNull()), [key], hot_rows))
    columns = [c for c in rows.columns if c != into]
    return joined.select(*columns, F.coalesce("_detail", F.lit("")).alias(into))


def by_terms(rows: DataFrame, terms: DataFrame, text: str, how: str = "left_anti", term: str = "term", **sizes: int) -> DataFrame:
    """J4. Rows with none (``left_anti``) or any (``left_semi``) of the listed terms in their text: literals for a short
    list, an automaton for a longer one, an index of grams beyond that (``term_index``)."""
    return rows_with_terms(rows, terms, text, how, term, **sizes)
