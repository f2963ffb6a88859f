"""All feeds landed, one run from payloads to the digest."""

import datetime as dt
import json

from helpers import values
from postsieve.plans.daily import fetched_rows, run_day
from postsieve.plans.daily import posted_lately
from postsieve.plans.feeds import landed_feeds
from test_mail import JOB, html, messages

GATED = dt.datetime(2026, 3, 9, 12)
OPEN = dt.datetime(2026, 3, 10, 12)

CARD = (
    '<div class="base-card"><h3 class="base-search-card__title">Card Lead</h3><h4 class="base-search-card__subtitle">Acme</h4>'
    '<a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/card-4000009?x=1"></a></div>'
)
PAYLOADS = {
    "cards": CARD,
    "search_api": json.dumps({"results": [
        {"title": "Search Lead", "redirect_url": "https://s.org/1", "description": "remote", "created": "2026-03-08T00:00:00Z"},
        {"title": "Silent Lead", "redirect_url": "https://s.org/2", "description": "nothing said"},
    ]}),
    "array_feed": json.dumps([{}, {"position": "Array Lead", "url": "https://r.org/1"}, {"position": "Array Lead", "url": "https://s.org/1"}]),
    "category_feed": json.dumps({"jobs": [{"title": "Brand Director", "url": "https://c.org/1"}, {"title": "Designer", "url": "https://c.org/2"}]}),
    "rss": "<rss><channel><item><title>Acme: Creative Director</title><link>https://w.org/1</link></item></channel></rss>",
    "paged_search": json.dumps({"data": [{"job_title": "Paged Lead", "job_url": "https://p.org/1"}]}),
}


def landed(spark):
    rows = [(kind, batch, 0, payload) for batch, (kind, payload) in enumerate(PAYLOADS.items(), start=2)]
    return values(spark, "source string, batch_seq int, payload_seq long, payload string", rows)


def feeds(spark):
    mail = messages(spark, html(f'<a href="{JOB % 4000009}">Mail Lead</a>'))
    pages = values(spark, "external_id string, payload string", [("4000009", '<div class="description__text">US only, hybrid</div>')])
    return landed_feeds(landed(spark), mail, pages)


def test_every_feed_arrives_with_its_details(spark):
    rows = {(r.kind, r.title): r.description for r in fetched_rows(feeds(spark), GATED).collect()}
    assert rows[("mail", "Mail Lead")] == rows[("cards", "Card Lead")] == "US only, hybrid"
    assert len(rows) == 9 and ("paged_search", "Paged Lead") in rows
    kinds = {k for k, _ in [(r.kind, 0) for r in fetched_rows(feeds(spark), OPEN).collect()]}
    assert "paged_search" not in kinds


def test_run_over_all_feeds(spark, tmp_path):
    out = run_day(spark, str(tmp_path), fetched_rows(feeds(spark), GATED), GATED)
    assert {r.title for r in out["kept"].collect()} == {"Search Lead", "Array Lead", "Brand Director", "Creative Director", "Paged Lead"}
    funnel = {r.source: (r.fetched, r.kept, r.residency_dropped) for r in out["funnel"].collect()}
    assert funnel["LinkedIn"] == (2, 0, 2) and funnel["Adzuna"] == (2, 1, 0) and funnel["Remotive"] == (2, 1, 0)


def test_recency_on_fetched_rows(spark):
    rows = fetched_rows(feeds(spark), OPEN)
    assert posted_lately(rows, OPEN).count() == rows.count()
    late = posted_lately(rows, OPEN + dt.timedelta(days=9))
    assert rows.count() - late.count() == 1
