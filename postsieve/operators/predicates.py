"""Filters F1-F18. Each predicate is a Column; null text counts as empty."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions.match import contains_any, matches_any, pattern
from ..functions.stamps import instant, utc
from ..functions.text import as_column, default_text, strip, text
from ..functions.urls import domain_ok

__all__ = [
    "title_ok", "domain_ok", "remote_clean", "remote_signal", "residency_only", "senior_title",
    "relevant_tags_or_title", "region_ok", "has_required", "anchor_url_ok", "anchor_text_ok",
    "loose_anchor_ok", "location_only", "line_title_ok", "recent", "attributes_match", "gate_open",
    "score_kept", "in_lane",
]


def title_ok(title: Column | str, excluded: Sequence[str] = tuple(fixed.EXCLUDED_TITLE_TERMS)) -> Column:
    """F1. No excluded term is a substring of the lower-cased title."""
    return ~contains_any(F.lower(text(title)), excluded)


def _title_and_description(title: Column | str, description: Column | str) -> Column:
    return F.lower(F.concat(text(title), F.lit(" "), text(description)))


def remote_clean(
    title: Column | str, description: Column | str, signals: Sequence[str] = tuple(fixed.ON_SITE_SIGNALS)
) -> Column:
    """F3. None of the on-site signals occurs."""
    return ~contains_any(_title_and_description(title, description), signals)


def remote_signal(
    title: Column | str, description: Column | str, signals: Sequence[str] = tuple(fixed.REMOTE_SIGNALS)
) -> Column:
    """F4. At least one remote signal occurs."""
    return contains_any(_title_and_description(title, description), signals)


def residency_only(
    description: Column | str,
    restricting: Sequence[str] = tuple(fixed.RESIDENCY_PATTERNS),
    opening: Sequence[str] = tuple(fixed.OPENNESS_PATTERNS),
    needs_word: Sequence[str] = tuple(fixed.RESIDENCY_WORDS),
) -> Column:
    """F5. The description restricts residency and nothing in it opens it up again.

    The restricting side is tested first: it is rarely found, so the opening patterns seldom run.
    """
    value = strip(description)
    return (value != "") & matches_any(value, restricting, needs_word) & ~matches_any(value, opening)


def senior_title(
    title: Column | str, alternatives: Sequence[str] = tuple(fixed.SENIOR_TITLE_ALTERNATIVES)
) -> Column:
    """F6. One of the title alternatives, word-bounded."""
    return text(title).rlike(pattern(alternatives, word_bounded=True))


def relevant_tags_or_title(
    tags: Column,
    title: Column | str,
    wanted_tags: Sequence[str] = tuple(fixed.RELEVANT_TAGS),
    title_terms: Sequence[str] = tuple(fixed.RELEVANT_TITLE_TERMS),
) -> Column:
    """F7. A wanted tag is among the (lower-cased) tags, or a term is in the title."""
    wanted = F.array(*[F.lit(t) for t in wanted_tags]).cast("array<string>")
    return F.coalesce(F.arrays_overlap(tags, wanted), F.lit(False)) | contains_any(F.lower(text(title)), title_terms)


def region_ok(
    location: Column | str,
    skipped: Sequence[str] = tuple(fixed.SKIPPED_REGIONS),
    rescued: Sequence[str] = tuple(fixed.RESCUED_REGIONS),
    default: str = fixed.DEFAULT_LOCATION,
) -> Column:
    """F8. A skipped region without a rescuing one drops the row (``us`` rescues "Australia")."""
    place = F.lower(default_text(location, default))
    return ~(contains_any(place, skipped) & ~contains_any(place, rescued))


def has_required(*columns: Column | str) -> Column:
    """F9. All given texts are non-empty."""
    hit = F.lit(True)
    for c in columns:
        hit = hit & (text(c) != "")
    return hit


def anchor_url_ok(
    href: Column | str, site: str = fixed.MAIL_SITE, markers: Sequence[str] = tuple(fixed.ANCHOR_URL_MARKERS)
) -> Column:
    """F10."""
    return F.contains(text(href), F.lit(site)) & contains_any(href, markers)


def anchor_text_ok(title: Column | str, scaffolding: Sequence[str] = tuple(fixed.ANCHOR_SCAFFOLDING)) -> Column:
    """F11, posting anchors: 4 to 200 characters, no scaffolding phrase."""
    return F.length(text(title)).between(4, 200) & ~contains_any(F.lower(text(title)), scaffolding)


def loose_anchor_ok(
    href: Column | str,
    title: Column | str,
    sites: Sequence[str] = (fixed.MAIL_SITE, fixed.MAIL_SHORT_SITE),
    scaffolding: Sequence[str] = tuple(fixed.LOOSE_SCAFFOLDING),
    signals: Sequence[str] = tuple(fixed.STRONG_TITLE_SIGNALS),
) -> Column:
    """F11, other anchors: 9 to 99 characters, no scaffolding phrase, a strong title signal."""
    lowered = F.lower(text(title))
    return (
        contains_any(href, sites)
        & F.length(text(title)).between(9, 99)
        & ~contains_any(lowered, scaffolding)
        & contains_any(lowered, signals)
    )


def location_only(
    title: Column | str,
    full_pattern: str = fixed.LOCATION_PATTERN,
    words: Sequence[str] = tuple(fixed.LOCATION_WORDS),
) -> Column:
    """F12. The whole text looks like a place and names one."""
    lowered = F.lower(text(title))
    return lowered.rlike(rf"\A(?:{full_pattern})\z") & contains_any(lowered, words)


def line_title_ok(title: Column | str, scaffolding: Sequence[str] = tuple(fixed.LINE_SCAFFOLDING)) -> Column:
    """F13, the line before a posting url."""
    return (F.length(text(title)) > 4) & ~contains_any(F.lower(text(title)), scaffolding)


def recent(posted: Column | str, run_ts: Column | dt.datetime, days: int) -> Column:
    """F14. Posted at most ``days`` before the run. ``posted`` is a timestamp; null (a date that could
    not be read) is kept.
    """
    stamp = as_column(posted)
    at = run_ts if isinstance(run_ts, Column) else instant(run_ts)
    return stamp.isNull() | (stamp >= at - F.expr(f"INTERVAL {int(days)} DAYS"))


def attributes_match(df: DataFrame, wanted: Mapping[str, Sequence]) -> Column:
    """F15. Equality on landed attributes, for those the landed table has."""
    hit = F.lit(True)
    for name, values in wanted.items():
        if name in df.columns:
            hit = hit & F.col(name).isin(list(values))
    return hit


def gate_open(run_ts: dt.datetime, days: int = fixed.GATE_DAYS) -> bool:
    """F16. Decided on the driver, so that a source that is skipped is never scanned."""
    return utc(run_ts).day % days == 0


def gate_column(run_ts: Column, days: int = fixed.GATE_DAYS) -> Column:
    """F16 for a table of runs."""
    return F.dayofmonth(run_ts) % days == 0


def score_kept(score: Column | str, threshold: int = fixed.KEEP_SCORE) -> Column:
    """F17."""
    return F.coalesce(as_column(score), F.lit(0)) >= threshold


def in_lane(category: Column | str, lanes: Sequence[str] = tuple(fixed.LANES)) -> Column:
    """F18. Other values stay in the store but show in no lane."""
    return F.coalesce(as_column(category).isin(list(lanes)), F.lit(False))
