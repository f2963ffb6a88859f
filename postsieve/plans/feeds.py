"""From one landed table to the feeds of a run."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.predicates import attributes_match
from ..sources.cards import card_postings
from ..sources.json_feeds import (
    array_feed_postings,
    category_feed_postings,
    paged_search_postings,
    search_api_postings,
)
from ..sources.mail import mail_postings
from ..sources.rss import rss_postings
from .mail import with_pages

READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "search_api": search_api_postings,
    "array_feed": array_feed_postings,
    "category_feed": category_feed_postings,
    "rss": rss_postings,
    "paged_search": paged_search_postings,
}


def landed_feeds(
    landed: DataFrame,
    messages: DataFrame | None = None,
    pages: DataFrame | None = None,
    wanted: Mapping[str, Sequence] | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """S1-S9 by kind of feed, for ``fetched_rows``. Nothing is planned before a feed is called.

    ``landed``: responses whose ``source`` names their kind, a partition column at best; ``wanted``: its
    attributes to filter on (F15). ``messages``: alert mail. ``pages``: landed detail pages with
    ``external_id``; cards and mail take their description from there (J1). Only pages that a
    posting asks for are parsed.
    """

    def of(kind: str) -> DataFrame:
        rows = landed.where(F.col("source") == kind)
        return rows.where(attributes_match(rows, wanted)) if wanted else rows

    def enriched(postings: DataFrame) -> DataFrame:
        return postings if pages is None else with_pages(postings, pages)

    feeds: dict[str, Callable[[], DataFrame]] = {}
    if messages is not None:
        feeds["mail"] = lambda: enriched(mail_postings(messages))
    feeds["cards"] = lambda: enriched(card_postings(of("cards")))
    for kind, read in READERS.items():
        feeds[kind] = lambda kind=kind, read=read: read(of(kind))
    return feeds
