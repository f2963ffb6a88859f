"""Alert mail with its enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.urls import external_id
from ..operators.joins import enrich
from ..session import stage
from ..sources.cards import detail_pages
from ..sources.mail import mail_postings


def with_details(postings: DataFrame, details: DataFrame) -> DataFrame:
    """J1 by the external id in the url; empty on a miss. The join reads its rows more than once, so
    they are staged: the messages behind them are parsed once."""
    keyed = stage(postings.withColumn("external_id", external_id("url")))
    return enrich(keyed, details).select(postings.columns)


def wanted_pages(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """The landed pages (``external_id``) that a posting asks for: what nobody wants is not parsed."""
    asked = postings.select(external_id("url").alias("external_id")).where(F.col("external_id").isNotNull()).distinct()
    return pages.join(asked, "external_id", "left_semi")


def with_pages(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """J1 with the details (S6) of landed pages."""
    rows = stage(postings)
    return with_details(rows, stage(detail_pages(wanted_pages(rows, pages))))


def enriched_mail(messages: DataFrame, details: DataFrame) -> DataFrame:
    return with_details(mail_postings(messages), details)
