"""Result cards and detail pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions.html import records_of
from ..functions.text import strip, truncate
from ..functions.urls import without_query
from ..operators.predicates import has_required
from .landed import position, posting


def card_postings(landed: DataFrame, source: str = fixed.CARDS) -> DataFrame:
    """S5. One row per card; the description comes later, by enrichment."""
    fields = [("h3", fixed.CARD_TITLE_CLASS), ("h4", fixed.CARD_COMPANY_CLASS), ("a", fixed.CARD_LINK_CLASS)]
    cards = records_of("payload", ("div", fixed.CARD_CLASS), fields, stripped=False)
    pages = landed.select("batch_seq", "payload_seq", cards.alias("cards"))
    rows = pages.select("batch_seq", "payload_seq", F.posexplode("cards").alias("index", "card"))
    title, company, link = (F.get("card", F.lit(k)) for k in range(3))
    text = F.lit("")
    return rows.select(
        *posting(
            source,
            title=F.coalesce(strip(title.text), text),
            company=F.coalesce(strip(company.text), text),
            url=without_query(link.href),
        ),
        "batch_seq",
        position(F.col("index")),
    ).where(has_required("title", "url"))


def detail_text(
    html: Column | str,
    containers: Sequence[tuple[str, str]] = tuple(fixed.DETAIL_CONTAINERS),
    chars: int = fixed.DETAIL_CHARS,
) -> Column:
    """S6. Text of the first container that exists, else of the whole page."""
    found = records_of(html, None, containers, whole=True)
    picked = F.get(F.filter(F.get(found, F.lit(0)), lambda field: field.isNotNull()), F.lit(0))
    return truncate(picked.text, chars)


def detail_pages(pages: DataFrame, key: str = "external_id", html: str = "payload") -> DataFrame:
    """S6. One detail text per external id, for the enrichment join."""
    return pages.select(key, detail_text(html).alias("detail"))
