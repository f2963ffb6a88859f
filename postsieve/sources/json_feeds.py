"""JSON responses to postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fixed
from .. import schemas
from ..functions.salary import salary_plain, salary_with_currency, salary_with_unit
from ..functions.text import lower_tags, strip, strip_tags, text, truncate
from ..functions.urls import domain_ok, first_url
from ..operators.predicates import has_required, region_ok, relevant_tags_or_title
from .landed import json_payload, position, posting

_BLOCKED = tuple(fixed.BLOCKED_DOMAINS)


def _items(landed: DataFrame, schema: str, member: str | None) -> DataFrame:
    parsed = json_payload(schema)
    items = parsed.getField(member) if member else parsed
    return landed.select("batch_seq", "payload_seq", F.posexplode(items).alias("index", "j"))


def search_api_postings(
    landed: DataFrame,
    source: str = fixed.SEARCH_API,
    blocked: Sequence[str] = _BLOCKED,
    chars: int = fixed.FEED_CHARS,
) -> DataFrame:
    """S1."""
    rows = _items(landed, schemas.SEARCH_API_PAYLOAD, "results")
    j = F.col("j")
    return rows.select(
        *posting(
            source,
            title=strip(j.title),
            company=strip(j.company.display_name),
            url=first_url(j.redirect_url, j.adref),
            description=truncate(j.description, chars),
            salary=salary_with_unit(j.salary_min, j.salary_max),
            posted=text(j.created),
        ),
        "batch_seq",
        position(F.col("index")),
    ).where(has_required("title", "url") & domain_ok("url", blocked))


def array_feed_postings(
    landed: DataFrame,
    source: str = fixed.ARRAY_FEED,
    blocked: Sequence[str] = _BLOCKED,
    wanted_tags: Sequence[str] = tuple(fixed.RELEVANT_TAGS),
    title_terms: Sequence[str] = tuple(fixed.RELEVANT_TITLE_TERMS),
    chars: int = fixed.FEED_CHARS,
) -> DataFrame:
    """S2. The first element of the array describes the feed and is no posting."""
    rows = _items(landed, schemas.ARRAY_FEED_PAYLOAD, None).where("index >= 1")
    j = F.col("j")
    return (
        rows.where(relevant_tags_or_title(lower_tags(j.tags), strip(j.position), wanted_tags, title_terms))
        .select(
            *posting(
                source,
                title=strip(j.position),
                company=strip(j.company),
                url=first_url(j.apply_url, j.url),
                description=truncate(strip_tags(j.description), chars),
                salary=salary_plain(j.salary_min, j.salary_max),
            ),
            "batch_seq",
            position(F.col("index")),
        )
        .where(has_required("title", "url") & domain_ok("url", blocked))
    )


def category_feed_postings(
    landed: DataFrame,
    source: str = fixed.CATEGORY_FEED,
    blocked: Sequence[str] = _BLOCKED,
    skipped: Sequence[str] = tuple(fixed.SKIPPED_REGIONS),
    rescued: Sequence[str] = tuple(fixed.RESCUED_REGIONS),
    chars: int = fixed.FEED_CHARS,
) -> DataFrame:
    """S3. One response per category; all categories are one batch."""
    rows = _items(landed, schemas.CATEGORY_FEED_PAYLOAD, "jobs")
    j = F.col("j")
    return (
        rows.where(region_ok(j.candidate_required_location, skipped, rescued))
        .select(
            *posting(
                source,
                title=strip(j.title),
                company=strip(j.company_name),
                url=text(j.url),
                description=truncate(strip_tags(j.description), chars),
                salary=text(j.salary),
                posted=text(j.publication_date),
            ),
            "batch_seq",
            position(F.col("index")),
        )
        .where(has_required("title", "url") & domain_ok("url", blocked))
    )


def paged_search_postings(
    landed: DataFrame,
    source: str = fixed.PAGED_SEARCH,
    blocked: Sequence[str] = _BLOCKED,
    chars: int = fixed.FEED_CHARS,
) -> DataFrame:
    """S9. One response per page."""
    rows = _items(landed, schemas.PAGED_SEARCH_PAYLOAD, "data")
    j = F.col("j")
    return rows.select(
        *posting(
            source,
            title=strip(j.job_title),
            company=strip(j.employer_name),
            url=first_url(j.job_apply_link, j.job_url),
            description=truncate(j.job_description, chars),
            salary=salary_with_currency(
                j.job_min_salary, j.job_max_salary, j.job_salary_currency, j.job_salary_period
            ),
            posted=text(j.job_posted_at_datetime_utc),
        ),
        "batch_seq",
        position(F.col("index")),
    ).where(has_required("title", "url") & domain_ok("url", blocked))
