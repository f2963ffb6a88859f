"""Which predicates apply is a matter of the source, looked up in a small policy table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fixed
from ..functions.text import text
from . import predicates as p

MAX_POLICIES = 10_000


@dataclass(frozen=True)
class Policy:
    """Tests one source has to pass besides the title and residency tests, which always apply."""

    source: str
    need_clean: bool = False
    need_signal: bool = False
    need_senior_title: bool = False


# The policy of each kind of source.
POLICIES = [
    Policy("mail"),
    Policy("cards", need_clean=True),
    Policy("search_api", need_clean=True, need_signal=True),
    Policy("array_feed", need_clean=True),
    Policy("category_feed", need_clean=True, need_senior_title=True),
    Policy("rss", need_clean=True, need_senior_title=True),
    Policy("paged_search", need_clean=True),
]


@dataclass(frozen=True)
class Terms:
    """Lists and patterns of the predicates."""

    excluded_titles: Sequence[str] = field(default_factory=lambda: tuple(fixed.EXCLUDED_TITLE_TERMS))
    on_site: Sequence[str] = field(default_factory=lambda: tuple(fixed.ON_SITE_SIGNALS))
    remote: Sequence[str] = field(default_factory=lambda: tuple(fixed.REMOTE_SIGNALS))
    restricting: Sequence[str] = field(default_factory=lambda: tuple(fixed.RESIDENCY_PATTERNS))
    opening: Sequence[str] = field(default_factory=lambda: tuple(fixed.OPENNESS_PATTERNS))
    restricting_words: Sequence[str] | None = None
    senior_titles: Sequence[str] = field(default_factory=lambda: tuple(fixed.SENIOR_TITLE_ALTERNATIVES))
    blocked_domains: Sequence[str] = field(default_factory=lambda: tuple(fixed.BLOCKED_DOMAINS))

    def guard_words(self) -> Sequence[str]:
        """Words of which every match of ``restricting`` holds one. The default patterns have such words; for other
        patterns the caller may name some, else every text meets the patterns."""
        if self.restricting_words is not None:
            return self.restricting_words
        return fixed.RESIDENCY_WORDS if tuple(self.restricting) == tuple(fixed.RESIDENCY_PATTERNS) else ()


DEFAULT_TERMS = Terms()


def policy_table(spark: SparkSession, policies: Sequence[Policy]) -> DataFrame:
    """The policies as rows."""
    columns = {
        "policy_source": pa.array([x.source for x in policies], pa.string()),
        "need_clean": pa.array([x.need_clean for x in policies], pa.bool_()),
        "need_signal": pa.array([x.need_signal for x in policies], pa.bool_()),
        "need_senior_title": pa.array([x.need_senior_title for x in policies], pa.bool_()),
    }
    return spark.createDataFrame(pa.table(columns))


def residency_flag(terms: Terms = DEFAULT_TERMS, description: str = "description") -> Column:
    return p.residency_only(description, terms.restricting, terms.opening, terms.guard_words())


def passes_titles_and_signals(
    terms: Terms = DEFAULT_TERMS, title: str = "title", description: str = "description"
) -> Column:
    """The policy test of a row that carries its policy columns, but for the residency test; cheap tests
    come first."""
    return (
        p.title_ok(title, terms.excluded_titles)
        & (~F.col("need_senior_title") | p.senior_title(title, terms.senior_titles))
        & (~F.col("need_clean") | p.remote_clean(title, description, terms.on_site))
        & (~F.col("need_signal") | p.remote_signal(title, description, terms.remote))
    )


def passes(terms: Terms = DEFAULT_TERMS, title: str = "title", description: str = "description") -> Column:
    """The whole policy test."""
    return passes_titles_and_signals(terms, title, description) & ~residency_flag(terms, description)


def with_policy(rows: DataFrame, policies: Sequence[Policy], source: str = "kind") -> DataFrame:
    """J6. Joins the policy of the source; a source without one needs nothing extra."""
    table = policy_table(rows.sparkSession, policies)
    if len(policies) <= MAX_POLICIES:  # beyond that size it is joined like any other table
        table = F.broadcast(table)
    joined = rows.join(table, F.col(source) == F.col("policy_source"), "left")
    needs = [F.coalesce(n, F.lit(False)).alias(n) for n in ("need_clean", "need_signal", "need_senior_title")]
    return joined.select(*[rows[c] for c in rows.columns], *needs)


def apply_policy(
    rows: DataFrame,
    policies: Sequence[Policy] = tuple(POLICIES),
    terms: Terms = DEFAULT_TERMS,
    source: str = "kind",
) -> DataFrame:
    """F19. Rows that pass the policy of their source."""
    return with_policy(rows, policies, source).where(passes(terms)).select(rows.columns)


def judged(
    rows: DataFrame,
    policies: Sequence[Policy] = tuple(POLICIES),
    terms: Terms = DEFAULT_TERMS,
    source: str = "kind",
) -> DataFrame:
    """F19 with its verdicts kept as columns ``kept``, ``restricted`` and ``enriched``.

    Every predicate runs once per row, for the funnel and the filter alike. Rows that fail keep their
    place and their verdicts but none of their text, so a table of them stays small.
    """
    verdicts = with_policy(rows, policies, source).withColumns(
        {"restricted": residency_flag(terms), "enriched": text("description") != ""}
    )
    verdicts = verdicts.withColumn("kept", passes_titles_and_signals(terms) & ~F.col("restricted"))
    texts = ["title", "company", "url", "description", "salary", "posted"]
    place = [c for c in rows.columns if c not in texts]
    return verdicts.select(
        *[F.when(F.col("kept"), F.col(c)).alias(c) for c in texts], *place, "kept", "restricted", "enriched"
    )
