import base64

import pytest
from pyspark.sql import functions as F

from helpers import column, values
from postsieve.functions import match, responses, salary, text, urls


def test_strip_takes_all_whitespace(spark):
    raw = ["  a b　\x1f", "\x85", None, "", "x​"]
    df = values(spark, "t string", [(r,) for r in raw])
    assert column(df, text.strip("t")) == [(r or "").strip() for r in raw]


def test_tags_go_before_truncation(spark):
    df = values(spark, "t string", [("<p>" + "a" * 1500 + "</p>",), ("x<br/>y &amp; <i",), (None,)])
    got = column(df, text.truncate(text.strip_tags("t"), 1200))
    assert got == [" " + "a" * 1199, "x y &amp; <i", ""]


def test_company_title_split(spark):
    df = values(spark, "t string", [("A: B: C",), ("Solo",), ("A:B",), (None,)])
    got = [(r.c.company, r.c.title) for r in df.select(text.company_and_title("t").alias("c")).collect()]
    assert got == [("A", "B: C"), ("", "Solo"), ("", "A:B"), ("", "")]


def test_content_id_ignores_case_marks_and_length(spark):
    long = "Creative Director of Everything Under the Sun"
    df = values(
        spark, "t string, c string",
        [(long, "Acme Inc"), (long.upper() + " and more", "ACME, Inc."), ("クリエイティブ", ""), ("デザイナー", None)],
    )
    a, b, c, d = column(df, text.content_id("t", "c"))
    assert a == b and c == d and a != c and len(a) == 12


def test_score_bar(spark):
    df = values(spark, "s int", [(9,), (3,), (0,), (-2,), (None,)])
    assert column(df, text.score_bar("s")) == ["●●●●●", "●●●○○", "○○○○○", "○○○○○○○", "○○○○○"]


def test_base64url(spark):
    body = "é>?ÿ body"
    good = base64.urlsafe_b64encode(body.encode()).decode()
    broken = base64.urlsafe_b64encode(b"ab\xff").decode()
    df = values(spark, "t string", [(good,), (good[:2] + "\r\n!" + good[2:],), (good.rstrip("="),), (broken,), (None,)])
    padded = len(good.rstrip("=")) % 4 == 0
    got = column(df, text.base64url_text("t"))
    assert got[:2] == [body, body] and got[2] == (body if padded else None)
    assert got[3] == "ab�" and got[4] is None


@pytest.mark.parametrize(
    "low, high, fixed_unit, plain, currency",
    [
        (50000.9, 90000.0, "$50,000–$90,000 USD/year", "$50,000–$90,000", "$50,000–$90,000 CAD/month"),
        (1234567.0, None, "$1,234,567+ USD/year", "$1,234,567+", "$1,234,567+ CAD"),
        (1234.0, 0.0, "$1,234+ USD/year", "$1,234+", "$1,234+ CAD"),
        (0.0, 90000.0, "", "", ""),
        (None, None, "", "", ""),
    ],
)
def test_salary(spark, low, high, fixed_unit, plain, currency):
    df = values(spark, "a double, b double", [(low, high)])
    assert column(df, salary.salary_with_unit("a", "b")) == [fixed_unit]
    assert column(df, salary.salary_plain("a", "b")) == [plain]
    assert column(df, salary.salary_with_currency("a", "b", F.lit("CAD"), F.lit("month"))) == [currency]


def test_salary_currency_defaults(spark):
    df = values(spark, "a double, b double, c string, p string", [(1.0, 2.0, None, None)])
    assert column(df, salary.salary_with_currency("a", "b", "c", "p")) == ["$1–$2 USD/year"]


def test_netloc_and_domains(spark):
    cases = {
        "https://user@www.Talent.com:80/x?y": ("user@talent.com:80", False),
        "http://mytalent.com": ("mytalent.com", False),
        "//a.b/c": ("a.b", True),
        "talent.com/x": ("", True),
        "http://[::1/x": ("", True),
        "http://[::1]:80/x": ("[::1]:80", True),
        " \thttps://x.org#f": ("x.org", True),
        None: ("", True),
    }
    df = values(spark, "u string", [(u,) for u in cases])
    got = list(zip(column(df, urls.netloc("u")), column(df, urls.domain_ok("u"))))
    assert got == list(cases.values())


def test_canonical_url_and_external_id(spark):
    cases = {
        "https://www.linkedin.com/jobs/search?x=1&currentJobId=77": ("https://www.linkedin.com/jobs/view/77/", "77"),
        "https://l/x?currentJobId=&b=1#q?currentJobId=5": ("https://l/x", "5"),
        "https://l/comm/jobs/view/creative-director-at-x-4414195118?trk=1": (
            "https://l/comm/jobs/view/creative-director-at-x-4414195118", "4414195118"),
        "https://l/jobs/4414195118#a": ("https://l/jobs/4414195118#a", "4414195118"),
        "https://l/p/1234567": ("https://l/p/1234567", "1234567"),
        "https://l/p/123456": ("https://l/p/123456", None),
        "": ("", None),
    }
    df = values(spark, "u string", [(u,) for u in cases])
    assert list(zip(column(df, urls.canonical_url("u")), column(df, urls.external_id("u")))) == list(cases.values())


def test_first_url(spark):
    df = values(spark, "a string, b string", [("", "y"), (None, None), ("x", "y")])
    assert column(df, urls.first_url("a", "b")) == ["y", "", "x"]


RESPONSES = {
    '{"score": 7, "category": "core", "reason": "x"}': (7, "CORE", "x", "claude"),
    'Sure {"score": 7.9}\n': (7, "ADJACENT", "", "claude"),
    '{"score": "7"}': (7, "ADJACENT", "", "claude"),
    '{"score": " +1_0 "}': (10, "ADJACENT", "", "claude"),
    '{"score": "7.5"}': (3, "ADJACENT", None, "fallback"),
    '{"score": null}': (3, "ADJACENT", None, "fallback"),
    '{"score": [7]}': (3, "ADJACENT", None, "fallback"),
    '{"score": true}': (1, "ADJACENT", "", "claude"),
    '{"score": -2.7}': (-2, "ADJACENT", "", "claude"),
    '{"score": 42}': (42, "ADJACENT", "", "claude"),
    '{"category": "lane"}': (3, "LANE", "", "claude"),
    '{"score": 8, "category": null}': (3, "ADJACENT", None, "fallback"),
    '{"score": 8, "category": 5}': (3, "ADJACENT", None, "fallback"),
    '{"score": 4, "reason": 5}': (3, "ADJACENT", "5", "fallback"),
    '{"score": 2, "reason": 5}': (2, "ADJACENT", "5", "claude"),
    '{"score": 9, "reason": 0}': (9, "ADJACENT", "0", "claude"),
    '{"score": 9, "reason": null}': (9, "ADJACENT", None, "claude"),
    '{"score": 9, "reason": ["a"]}': (9, "ADJACENT", '["a"]', "claude"),
    "no json": (3, "ADJACENT", None, "fallback"),
    "} reversed {": (3, "ADJACENT", None, "fallback"),
    '{"score": 1} and {"score": 2}': (3, "ADJACENT", None, "fallback"),
    None: (3, "ADJACENT", None, "fallback"),
}


def test_response_coercion(spark):
    df = values(spark, "t string", [(t,) for t in RESPONSES])
    got = [tuple(r.r) for r in df.select(responses.parsed_response("t").alias("r")).collect()]
    assert dict(zip(RESPONSES, got)) == RESPONSES


def test_pattern_keeps_meaning_when_bound_is_shared(spark):
    import re

    alternatives = [r"\bus\s+only\b", r"\bu\.s\.\s*citizens?\b"]
    texts = ["bus only", "US only", "the U.S. citizen", "us onlyx", "Us\x1fOnly!"]
    df = values(spark, "t string", [(t,) for t in texts])
    want = [bool(re.search("|".join(alternatives), t, re.IGNORECASE)) for t in texts]
    assert column(df, match.matches_any("t", alternatives)) == want
    assert column(df, match.matches_any("t", alternatives, ["only", "citizen"])) == want


def test_keyword_score(spark):
    df = values(spark, "t string", [("Remote brand lead",), ("remote remote",), ("none",), (None,)])
    assert column(df, match.keyword_score("t", {"remote": 4, "brand": 3.5, "lead": 6})) == [10.0, 4.0, 0.0, 0.0]


def test_base64url_padding(spark):
    import binascii

    coded = ["YWJj", "YWI=", "YWI", "YQ==", "YQ=", "YQ", "Y", "", "YW Jj", "YQ =", "Y Q==", "YWJj\n", "Y*Q==", "YW\tI="]

    def python(t):
        try:
            return base64.urlsafe_b64decode(t).decode("utf-8", errors="replace")
        except binascii.Error:
            return None

    df = values(spark, "t string", [(c,) for c in coded])
    assert column(df, text.base64url_text("t")) == [python(c) for c in coded]
