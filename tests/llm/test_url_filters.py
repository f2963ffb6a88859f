"""Rules for urls against a plain loop over rules."""

import random

import pytest
from postsieve.llm import url_filters

SCHEMA = "page_id long, url string, host int, path string, rule long, verdict string, key string, n int, range int"


def plain(url, rules, default="allow"):
    _, mark, rest = (url or "").partition("://")
    rest = rest if mark else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = []
    for rule, verdict in rules:
        if rule is None or verdict not in ("allow", "block") or not rule.split("/")[0]:
            continue
        h, slash, p = rule.partition("/")
        h = "".join(c.lower() if "A" <= c <= "Z" else c for c in h)
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(h + slash + p), len(h), h + slash + p, verdict))
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judged(spark, urls, rules, **options):
    frame = spark.createDataFrame([(k, u, 1, "p", 2, "v", "k", 3, 4) for k, u in urls], SCHEMA).repartition(3)
    made = spark.createDataFrame(rules, "rule string, verdict string, host int, path int")
    rows = url_filters.judge(frame, made, **options)
    assert rows.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(map(tuple, rows.collect()), key=repr)


def expected(urls, rules, **options):
    return sorted(((k, *plain(u, rules, **options)) for k, u in urls), key=repr)


EDGES = [
    (1, None), (2, ""), (3, "no mark"), (4, "http://"), (5, "http:///x"), (6, "HTTP://EXAMPLE.Org/EN/1"), (7, "http://example.org"), (7, "http://example.org"),
    (None, "http://a.example.org/en/12?q=/es/"), (8, "http://example.org.:80/en/1"), (9, "http://u@example.org/en/1"), (10, "x://a..org/"), (11, "x://.org/"),
    (12, "x://.../"), (13, "x://org?x"), (14, "x://org/\nnew"), (15, "x://É.ORG/É"), (16, "x://notexample.org/en/1"), (17, "x://b.com/" + "y" * 100_000),
    (18, "a://b.com/x://c.com/"), (19, "x://" + "a." * 3000 + "example.org/en/1"), (20, "x://\U0010ffff.org/\U0010ffff\U0010ffff"), (21, "x://b.com/ÿ"),
]
RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("example.org/en/1", "allow"), ("example.org/en/12", "allow"),
    ("org", "block"), ("com/", "block"), ("b.com/" + "y" * 500, "allow"), ("b.com/" + "y" * 501, "block"), (".org/", "block"), ("/x", "block"), (None, "block"),
    ("com/ÿ", "allow"), ("org/\U0010ffff", "block"), ("É.ORG/É", "block"), ("b.com/x", None), ("b.com/x", "maybe"), ("a.b.com", "allow"),
]


@pytest.mark.parametrize("default", ["allow", "block"])
def test_edges(spark, default):
    rules = [(*r, 1, 2) for r in RULES]
    assert judged(spark, EDGES, rules, default=default) == expected(EDGES, RULES, default=default)


def test_random_rules(spark):
    dice = random.Random(1)
    part = lambda: dice.choice(["a", "b", "aa", "ab", "c"])
    path = lambda: "".join(dice.choice("/ab") for _ in range(dice.randrange(6)))
    rules = [(".".join(part() for _ in range(dice.randint(1, 3))) + "/" + path(), dice.choice(["allow", "block"])) for _ in range(400)]
    urls = [(k, "x://" + ".".join(part() for _ in range(dice.randint(1, 4))) + "/" + path()) for k in range(3000)]
    assert judged(spark, urls, [(*r, 1, 2) for r in rules]) == expected(urls, rules)


def test_one_host_has_all_urls_and_rules(spark):
    rules = [("a.b/" + "x" * k, "block" if k % 2 else "allow") for k in range(200)]
    urls = [(k, "x://c.a.b/" + "x" * (k % 250)) for k in range(4000)] + [(k, "x://a.b/") for k in range(3000)]
    assert judged(spark, urls, [(*r, 1, 2) for r in rules]) == expected(urls, rules)


def test_nothing_given(spark):
    assert judged(spark, [], [(*r, 1, 2) for r in RULES]) == []
    assert judged(spark, EDGES, [], default="block") == expected(EDGES, [], default="block")


def test_no_python_on_executors(spark):
    frame = spark.createDataFrame([(1, "x://a.org/")], "page_id long, url string")
    plan = url_filters.judge(frame, url_filters.fixed_rules(spark, RULES[:2]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
