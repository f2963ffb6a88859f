import json

import pytest
from helpers import values
from postsieve.sources.cards import card_postings, detail_pages
from postsieve.sources.json_feeds import array_feed_postings, category_feed_postings, paged_search_postings, search_api_postings
from postsieve.sources.landed import read_landed_files, rejected_payloads
from postsieve.sources.requests import evaluation_inputs
from postsieve.sources.rss import rss_postings

LANDED = "source string, batch_seq int, payload_seq long, payload string"


def landed(spark, *payloads):
    rows = [("s", 4, i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return values(spark, LANDED, rows)


def rows(df):
    return [r.asDict() for r in df.orderBy("batch_seq", "pos").collect()]


def test_search_api(spark):
    page = {
        "results": [
            {"title": " Lead ", "company": {"display_name": "Acme "}, "redirect_url": "https://a.org/1", "description": "d" * 1300,
             "salary_min": 90000, "salary_max": 120000.9, "created": "2026-03-01T00:00:00Z"},
            {"title": "No company", "company": None, "redirect_url": "", "adref": "https://b.org/2", "salary_min": 5},
            {"title": "", "redirect_url": "https://a.org/3"},
            {"title": "Blocked", "redirect_url": "https://x.mytalent.com/4"},
            {"title": "No url"},
        ]
    }
    got = rows(search_api_postings(landed(spark, page, "{ cut off", {"results": None})))
    assert [(r["title"], r["company"], r["url"], len(r["description"]), r["salary"], r["posted"]) for r in got] == [
        ("Lead", "Acme", "https://a.org/1", 1200, "$90,000–$120,000 USD/year", "2026-03-01T00:00:00Z"),
        ("No company", "", "https://b.org/2", 0, "$5+ USD/year", ""),
    ]
    assert [(r["batch_seq"], r["pos"], r["source"]) for r in got] == [(4, 0, "Adzuna"), (4, 1, "Adzuna")]


def test_a_bad_row_does_not_end_its_page(spark):
    page = {"results": [{"title": "A", "company": {"display_name": None}, "redirect_url": "https://a.org"}, {"title": "B", "redirect_url": "https://b.org"}]}
    assert [r["title"] for r in rows(search_api_postings(landed(spark, page)))] == ["A", "B"]


def test_unreadable_payloads_are_set_apart(spark):
    bad = rejected_payloads(landed(spark, {"results": []}, "{ cut", "[] trailing", ""))
    assert sorted(r.payload_seq for r in bad.collect()) == [1, 2, 3]


def test_array_feed(spark):
    feed = [
        {"legal": "about", "position": "Lead meta", "url": "https://m.org"},
        {"position": "Coder", "company": "Acme", "apply_url": "", "url": "https://a.org/1", "tags": ["Design", "x"],
         "description": "<p>Hi</p>&amp;", "salary_min": 1000, "salary_max": 2000},
        {"position": "Brand Lead", "url": "https://a.org/2", "tags": None, "salary_min": 1000, "salary_max": 0},
        {"position": "Coder", "url": "https://a.org/3", "tags": ["designs"]},
    ]
    got = rows(array_feed_postings(landed(spark, feed, feed[:1])))
    assert [(r["title"], r["url"], r["description"], r["salary"], r["pos"]) for r in got] == [
        ("Coder", "https://a.org/1", " Hi &amp;", "$1,000–$2,000", 1), ("Brand Lead", "https://a.org/2", "", "$1,000+", 2),
    ]


def test_category_feed(spark):
    first = {"jobs": [
        {"title": "A", "company_name": "C", "url": "https://a.org", "salary": "$1", "candidate_required_location": "Africa, Australia", "publication_date": "2026"},
        {"title": "B", "url": "https://b.org", "candidate_required_location": "Europe"},
    ]}
    second = {"jobs": [{"title": "D", "url": "https://d.org", "description": "<b>x</b>"}]}
    got = rows(category_feed_postings(landed(spark, first, second)))
    assert [(r["title"], r["salary"], r["posted"], r["description"], r["pos"]) for r in got] == [
        ("A", "$1", "2026", "", 0), ("D", "", "", " x ", 1 << 20),
    ]


def test_rss(spark):
    feed = """<?xml version="1.0"?><rss version="2.0"><channel><title>x</title>
      <item><title>A: B: C</title><link>https://a.org</link><description>&lt;p&gt;hi&lt;/p&gt; &amp;amp;</description></item>
      <item><title><![CDATA[Solo & Co]]></title><link>https://mytalent.com</link></item>
      <item><title>No link: x</title></item></channel></rss>"""
    got = rows(rss_postings(landed(spark, feed, "<rss><channel></channel></rss>", "junk")))
    assert [(r["title"], r["company"], r["url"], r["description"]) for r in got] == [
        ("B: C", "A", "https://a.org", " hi  &amp;"), ("Solo & Co", "", "https://mytalent.com", ""),
    ]


def test_paged_search(spark):
    page = {"data": [
        {"job_title": "A", "employer_name": "E", "job_apply_link": None, "job_url": "https://a.org", "job_min_salary": 10, "job_max_salary": 20,
         "job_salary_currency": None, "job_salary_period": "hour", "job_posted_at_datetime_utc": "2026-03-01"},
        {"job_title": "B", "job_apply_link": "https://b.org", "job_min_salary": 10, "job_salary_currency": "CAD", "job_salary_period": "hour"},
    ]}
    got = rows(paged_search_postings(landed(spark, page)))
    assert [(r["title"], r["salary"], r["posted"]) for r in got] == [("A", "$10–$20 USD/hour", "2026-03-01"), ("B", "$10+ CAD", "")]


CARDS = """<ul><li><div class="base-card x"><h3 class="base-search-card__title">
   Big <b>Job</b>
 </h3><h4 class="base-search-card__subtitle"><a>Acme &amp; Co</a></h4><a class="y base-card__full-link" href="https://a.org/1?trk=2">go</a></div>
 <div class="base-card"><h3 class="base-search-card__title">No link</h3></div>
 <div class="base-cards"><h3 class="base-search-card__title">Other class</h3><a class="base-card__full-link" href="https://a.org/2"></a></div>
 <div class="base-card"><a class="base-card__full-link" href="https://a.org/3">x</a></div>"""


def test_cards(spark):
    got = rows(card_postings(landed(spark, CARDS, "", "<p>none")))
    assert [(r["title"], r["company"], r["url"], r["description"]) for r in got] == [("Big Job", "Acme & Co", "https://a.org/1", "")]


@pytest.mark.parametrize(
    "html, text",
    [
        ('<p>x</p><section class="show-more-less-html"><div class="show-more-less-html__markup a"> A <b> b </b></div> c</section>', "A b"),
        ('<section class="show-more-less-html"> s <i>t</i></section><div class="description__text">d</div>', "s t"),
        ('<div class="description__text">d<script>no()</script></div>tail', "d"),
        ('<div class="show-more-less-html__markup"></div><div class="description__text">d</div>', ""),
        ("<style>s</style><p>one<br>two</p><!-- c -->three &copy;", "one two three ©"),
        ("<p>" + "a" * 5000, "a" * 4000),
    ],
)
def test_detail_pages(spark, html, text):
    df = values(spark, "external_id string, payload string", [("1", html)])
    assert detail_pages(df).collect()[0].detail == text


def test_landed_files_keep_their_place(spark, tmp_path):
    for batch, seq, title in ((3, 0, "A"), (3, 1, "B"), (5, 0, "C")):
        folder = tmp_path / "source=search" / f"batch_seq={batch}" / f"payload_seq={seq}"
        folder.mkdir(parents=True)
        (folder / "page.json").write_text(json.dumps({"results": [{"title": title, "redirect_url": "https://a.org"}]}, indent=1))
    got = rows(search_api_postings(read_landed_files(spark, str(tmp_path))))
    assert [(r["title"], r["batch_seq"], r["pos"]) for r in got] == [("A", 3, 0), ("B", 3, 1 << 20), ("C", 5, 0)]


def test_evaluation_requests(spark):
    bodies = ['{"title": "T", "company": "C", "salary": 5}', '{"title": "T"}', "{", '{"title": "", "company": "C"}', '{"title":"T","company":"C"} x']
    df = values(spark, "request_id int, payload string", list(enumerate(bodies)))
    got = [(r.status, r.salary) for r in evaluation_inputs(df).orderBy("request_id").collect()]
    missing, invalid = "Missing title or company", "Invalid JSON"
    assert got == [(None, "5"), (missing, ""), (invalid, ""), (missing, ""), (invalid, "")]
