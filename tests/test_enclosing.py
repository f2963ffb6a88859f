"""The structural joins against climbs from parent to parent and against lookups on node arrays."""

import random
import time

import pytest
from postsieve.functions.html import html_nodes, nodes_of
from postsieve.operators.enclosing import _OpenPage, in_document_order, nearby_texts, with_enclosing
from postsieve.sources.mail import anchors, with_nearby_text
from pyspark.sql import functions as F

TAGS = ["td", "div", "table", "tr"]


def random_page(seed):
    r = random.Random(seed)
    words = ["a", "ab", "cd", "Lead  Engineer", " x ", "y" * 99, "z" * 100, "\n"]
    pieces = ["<div>", "</div>", "<table><tr><td>", "</td></tr></table>", "<span>", "</span>", "<p>", "</p>", "<a href='/x'>", "</a>", "<li>", "<a>"]
    return "".join(r.choice(pieces if r.random() < 0.6 else words) for _ in range(r.randint(0, 120)))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, random_page(i)) for i in range(150)] + [(200, None), (201, ""), (202, "no element"), (None, random_page(7)), (None, random_page(8))]
    return spark.createDataFrame(rows, "page long, html string").repartition(3)


def test_enclosing_is_the_climb_from_parent_to_parent(pages):
    found = with_enclosing(html_nodes(pages.where("page IS NOT NULL"), "page", "html"), "page", TAGS).collect()
    by_page = {}
    for row in found:
        by_page.setdefault(row.page, []).append(row)
    assert len(by_page) > 100
    for rows in by_page.values():
        rows.sort(key=lambda n: n.pos)
        for row in rows:
            at = row.parent_pos
            while at >= 0 and rows[at].tag not in TAGS:
                at = rows[at].parent_pos
            assert row.block == at


def test_order_of_a_table_is_made_where_it_is_lost(pages):
    nodes = html_nodes(pages.where("page IS NOT NULL"), "page", "html")
    shuffled = in_document_order(nodes.orderBy(F.xxhash64("page", "pos")), "page")
    expected = sorted((r.page, r.pos, r.block) for r in with_enclosing(nodes, "page", TAGS).collect())
    assert sorted((r.page, r.pos, r.block) for r in with_enclosing(shuffled, "page", TAGS).collect()) == expected


def test_nearby_texts_are_those_of_the_arrays(pages):
    """Also for pages that share the key null."""
    nodes = F.col("nodes")
    arrays = pages.select("page", nodes_of("html").alias("nodes")).withColumn("found", anchors(nodes))
    expected = arrays.select("page", F.explode(with_nearby_text(nodes, F.col("found"))).alias("c")).select("page", "c.title", "c.href", "c.company")
    found = nearby_texts(html_nodes(pages, "page", "html"), "page").where("href IS NOT NULL").drop("nth")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, expected.collect())))


def test_no_shuffle_after_the_parse(pages):
    plan = nearby_texts(html_nodes(pages.coalesce(1), "page", "html"), "page")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == pages.coalesce(1)._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_rows_without_place_and_clashing_names(spark):
    node = "page string, pos int, end_pos int, tag string, href string, text string, block string, nth string"
    rows = [
        ("p", 0, 3, "div", None, None, "mine", "mine"), ("p", None, 9, "div", None, None, "mine", None), ("p", 1, 2, "a", "/u", None, None, None),
        ("p", 2, 2, "#text", None, " t ", None, None), ("p", 3, 3, "#text", None, None, None, None), ("p", 4, 4, "p", None, None, None, None),
    ]
    nodes = spark.createDataFrame(rows, node).coalesce(1)
    assert [r.block for r in with_enclosing(nodes, "page", ["div"]).collect()] == [-1, -1, 0, 0, 0, -1]
    assert [tuple(r) for r in nearby_texts(nodes, "page").collect()] == [("p", 1, "t", "/u", "")]
    assert nearby_texts(nodes.limit(0), "page").collect() == []


def nested(depth):
    """Tables in tables, an anchor and the same text at each level."""
    rows = "<table><tr><td><span>same</span><a href='/x'>t</a>" * depth
    return rows + "<p>other</p>" + "</td></tr></table>" * depth


def test_deeply_nested_tables(spark):
    pages = spark.createDataFrame([(1, nested(300))], "page long, html string")
    found = nearby_texts(html_nodes(pages, "page", "html"), "page").collect()
    assert [r.nth for r in found] == list(range(1, 301))
    # The innermost cell has its own texts first, as every cell around it.
    assert {r.company for r in found} == {"same"} and {r.title for r in found} == {"t"}


def test_work_is_linear_in_the_nodes(spark):
    """Node rows of one page, nested ever deeper, told by their intervals alone."""
    def seconds(depth):
        best = 9.0
        for _ in range(3):
            page = _OpenPage(frozenset(TAGS), frozenset(["span", "td"]), 2, 99)
            size = 4 * depth
            started = time.perf_counter()
            for level in range(depth):
                at = 4 * level
                for row in ((at, size, "td", None, None), (at + 1, at + 2, "span", None, None), (at + 2, at + 2, "#text", None, "same"), (at + 3, at + 3, "a", "/x", None)):
                    page.row(*row)
            page.close(float("inf"))
            best = min(best, time.perf_counter() - started)
        assert len(page.found) == depth
        return best

    assert seconds(40_000) < 16 * seconds(5_000)
