import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from helpers import column, posting_rows, values
from postsieve import fixed_values as fixed
from postsieve.functions.text import lower_tags
from postsieve.operators import predicates as p
from postsieve.operators.policy import Policy, Terms, apply_policy, judged, residency_flag
from postsieve.operators.report import funnel


def test_title_terms_are_substrings(spark):
    df = values(spark, "t string", [("International Brand Lead",), ("Creative Director",), (None,), ("UX DESIGNER",)])
    assert column(df, p.title_ok("t")) == [False, True, True, False]


def test_on_site_and_remote_signals(spark):
    df = values(spark, "t string, d string", [("Lead", "Hybrid role"), ("Remote Lead", None), ("In-Office", ""), (None, None)])
    assert column(df, p.remote_clean("t", "d")) == [False, True, False, True]
    assert column(df, p.remote_signal("t", "d")) == [False, True, False, False]


DESCRIPTIONS = [
    "US residents only.", "Open to US citizens only; Canada welcome", "   ", None, "must be a U.S. citizen",
    "Must reside in the United States", "authorized to work in the US", "focus only on status", "usa based only",
    "open only to US applicants", "Continental United States only", "U.S. only", "muſt be a US national",
]


def test_residency(spark):
    df = values(spark, "d string", [(d,) for d in DESCRIPTIONS])

    def brute(d):
        d = (d or "").strip()
        opening = re.search("|".join(fixed.OPENNESS_PATTERNS), d, re.IGNORECASE)
        return bool(d and not opening and re.search("|".join(fixed.RESIDENCY_PATTERNS), d, re.IGNORECASE))

    want = [brute(d) for d in DESCRIPTIONS]
    assert column(df, p.residency_only("d")) == want and sum(want) >= 7


def test_every_residency_pattern_needs_a_guard_word(spark):
    for pattern in fixed.RESIDENCY_PATTERNS:
        assert any(re.search(rf"(?<!\?){w}(?!\??\))", pattern) for w in fixed.RESIDENCY_WORDS), pattern


def test_senior_title(spark):
    titles = ["Executive Creative Director", "SVP of Brand", "Head of Design Ops", "Director, Content", "Acd", "Ecdysis", "Designer"]
    df = values(spark, "t string", [(t,) for t in titles])
    assert column(df, p.senior_title("t")) == [True, True, True, True, True, False, False]


def test_tags_or_title(spark):
    df = values(
        spark, "tags array<string>, t string",
        [(["Design"], "x"), (["dev"], "Tech Lead"), (None, "x"), (["designs"], "VP"), ([], "vp sales")],
    )
    assert column(df, p.relevant_tags_or_title(lower_tags("tags"), "t")) == [True, True, False, False, True]


def test_region(spark):
    places = ["Africa, Australia", "Europe", None, "", "Asia", "EMEA, Americas", "Middle East", "Brazil"]
    df = values(spark, "l string", [(x,) for x in places])
    assert column(df, p.region_ok("l")) == [True, False, True, True, False, True, False, True]


def test_location_only(spark):
    df = values(spark, "t string", [("Toronto, Ontario",), ("Toronto, Ontario (3)",), ("Remote",), ("Lead",), ("x" * 41 + " remote",)])
    assert column(df, p.location_only("t")) == [True, False, True, False, False]


def test_anchor_text_bounds(spark):
    df = values(spark, "t string", [("abc",), ("abcd",), ("a" * 200,), ("a" * 201,), ("Easy Apply",)])
    assert column(df, p.anchor_text_ok("t")) == [False, True, True, False, False]


def test_loose_anchor(spark):
    rows = [
        ("https://li.com/x", "Creative Lead"), ("https://other.com", "Creative Lead"),
        ("https://linkedin.com", "VP Creative at linkedin"), ("https://linkedin.com", "Creative Lead " + "x" * 90),
    ]
    df = values(spark, "h string, t string", rows)
    assert column(df, p.loose_anchor_ok("h", "t")) == [True, False, False, False]


def test_recency_keeps_unreadable_dates(spark):
    run = dt.datetime(2026, 3, 10, 12)
    df = values(spark, "p string", [("2026-03-08T12:00:00Z",), ("2026-03-07T11:59:59+00:00",), ("yesterday",), ("",)])
    assert column(df, p.recent(F.try_to_timestamp("p"), run, 3)) == [True, False, True, True]


def test_gate_is_decided_before_planning():
    assert p.gate_open(dt.datetime(2026, 3, 9)) and not p.gate_open(dt.datetime(2026, 3, 10))
    late = dt.datetime(2026, 3, 9, 23, tzinfo=dt.timezone(dt.timedelta(hours=-5)))
    assert not p.gate_open(late)


MATRIX = {  # source: tests it needs besides title and residency
    "mail": set(), "cards": {"clean"}, "search_api": {"clean", "signal"}, "array_feed": {"clean"},
    "category_feed": {"clean", "senior"}, "rss": {"clean", "senior"}, "paged_search": {"clean"},
}
ROWS = {  # row: tests it fails
    ("Creative Director", "remote"): set(),
    ("Creative Director", "hybrid remote"): {"clean"},
    ("Creative Director", "plain"): {"signal"},
    ("Designer", "remote"): {"senior"},
    ("Junior Creative Director", "remote"): {"title"},
    ("Creative Director", "remote, US only"): {"residency"},
}


@pytest.mark.parametrize("kind", MATRIX)
def test_policy_matrix(spark, kind):
    rows = [(t, "", f"u{i}", d, kind, 1, i) for i, (t, d) in enumerate(ROWS)]
    got = {(r.title, r.description) for r in apply_policy(posting_rows(spark, rows)).collect()}
    needed = MATRIX[kind] | {"title", "residency"}
    assert got == {row for row, fails in ROWS.items() if not fails & needed}


def test_policy_without_needs_is_identity(spark):
    rows = posting_rows(spark, [("a", "", "u", "hybrid", "x", 1, 0), ("b", "", "v", "", "y", 1, 1)])
    assert apply_policy(rows, [Policy("x")]).count() == 2


def test_policy_join_is_broadcast_without_shuffle(spark):
    plan = apply_policy(posting_rows(spark, [("a", "", "u", "", "x", 1, 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_funnel_counts_residency_over_all_fetched_rows(spark):
    rows = posting_rows(
        spark,
        [
            ("Junior", "", "u1", "US only", "mail", 1, 0), ("Lead", "", "u2", "US only", "mail", 1, 1),
            ("Lead", "", "u3", "", "mail", 1, 2), ("Lead", "", "u4", "fine", "mail", 1, 3),
        ],
    )
    row = funnel(judged(rows)).collect()[0]
    assert (row.fetched, row.kept, row.residency_dropped, row.enriched) == (4, 2, 2, 3)


def test_judged_rows_keep_place_and_verdict_but_not_the_text(spark):
    rows = posting_rows(spark, [("Junior", "C", "u1", "d", "mail", 1, 0), ("Lead", "C", "u2", "US only", "mail", 1, 1), ("Lead", "C", "u3", "d", "mail", 1, 2)])
    got = [(r.pos, r.title, r.description, r.kept, r.restricted) for r in judged(rows).orderBy("pos").collect()]
    assert got == [(0, None, None, False, False), (1, None, None, False, True), (2, "Lead", "d", True, False)]


def test_own_patterns_need_no_default_words(spark):
    rows = values(spark, "t string", [("work from france exclusively",), ("anywhere",)])
    own = Terms(restricting=[r"\bfrance\s+exclusively\b"], opening=[])
    assert [r[0] for r in rows.select(residency_flag(own, "t")).collect()] == [True, False]
