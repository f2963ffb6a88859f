"""The quick tokeniser against the standard library's parser, and records against node arrays."""

import random

import pytest
from helpers import values
from postsieve.functions import html as h
from pyspark.sql import functions as F

PIECES = [
    "<p>", "</p>", "<div class='a b'>", "<DIV CLASS=\"a\">", "</div>", "<br>", "<br/>", "<i class=a />", "</I>", "<a href=\"/x?a=1&amp;b=2&copy=3\" class>", "</a>",
    "text", " &amp; &copy &nbsp;", "  ", "\n", "<!-- c -->", "<!---->", "<!-- a -- b -->", "<!doctype html>", "<script>if (a </b) '</p>'</script>", "<style>p{}</style>",
    "<title>t &lt; &amp;</title>", "<title><b>x</title>", "<textarea>\n<p>", "</textarea>", "<template>", "</template>", "a < b", "<", "<3", "</", "<a title=\"x class=y\" href=z>",
    "<a data-class=\"q\" href='u'>", "<noscript>", "</noscript>", "<svg>", "<p class=>", "<p/class=\"k\">", "<x:y>", "<?pi?>", "<![CDATA[x]]>", "&#x41;", "é", "<é>", "<a href=x/>",
    "<td class='a\nb'>", "<a class=\"a\" class=\"b\">", "</br>", "</script>", "<script/>", "<SCRIPT>x</Script >", "<rt>hid</rt>",
]


def nodes(page, quick):
    columns = {name: [] for name in h._NAMES}
    tree = h._Nodes(columns)
    if quick:
        h._parse(page, tree)
    else:
        slow = h._Slow(tree)
        slow.feed(page)
        slow.close()
        tree.finish()
    return columns


def test_quick_and_slow_agree():
    dice = random.Random(6)
    taken = 0
    for _ in range(6000):
        page = "".join(dice.choice(PIECES) for _ in range(dice.randrange(1, 9)))
        assert nodes(page, True) == nodes(page, False), page
        taken += h._quick(page, h._Nodes({name: [] for name in h._NAMES}))
    assert taken > 1000


FIELDS = [("h3", "t"), ("b", None), ("a", "l")]


def by_nodes(nodes, root, fields, stripped):
    """The same records by lookups on the node array."""
    inside = [None] if root is None else [n for n in nodes if n.tag == root[0] and (root[1] is None or root[1] in n.classes)]
    joint = " " if stripped else ""

    def text(part):
        pieces = [n.text.strip(h.SPACE) if stripped else n.text for n in part if n.tag == h.TEXT]
        return joint.join(p for p in pieces if p)

    out = []
    for top in inside:
        part = nodes if top is None else nodes[top.pos + 1 : top.end_pos + 1]
        record = []
        for tag, token in fields:
            hit = next((n for n in part if n.tag == tag and (token is None or token in n.classes)), None)
            record.append(None if hit is None else (hit.href, text(nodes[hit.pos + 1 : hit.end_pos + 1])))
        out.append(record)
    return out


@pytest.mark.parametrize("root", [None, ("div", "card"), ("div", None)])
@pytest.mark.parametrize("stripped", [True, False])
def test_records_are_those_of_the_nodes(spark, root, stripped):
    dice = random.Random(8)
    parts = ["<div class='card x'>", "<div>", "</div>", "<h3 class=t>", "</h3>", "<b>", "</b>", "<a class='l' href='/u'>", "</a>", " some ", "text", "<br>", "<p>", "</p>", "\n", "<", "<script>no</script>"]
    pages = ["".join(dice.choice(parts) for _ in range(dice.randrange(0, 40))) for _ in range(300)] + [None, "", "<div class=card>" * 50 + "<b>deep" + "</div>" * 20]
    frame = values(spark, "k int, html string", list(enumerate(pages))).coalesce(1)
    rows = frame.select("k", h.nodes_of("html").alias("nodes"), h.records_of("html", root, FIELDS, stripped).alias("records")).collect()
    for row in rows:
        got = [[None if f is None else (f.href, f.text) for f in record] for record in row.records]
        assert got == by_nodes(row.nodes, root, FIELDS, stripped), pages[row.k]


def test_whole_page_where_no_field_is(spark):
    frame = values(spark, "html string", [("<p>a <i>b</i></p>",), ("<p>a</p><b> c</b>",), (None,)])
    found = h.records_of("html", None, [("b", None)], whole=True)
    assert [[f and f.text for f in r[0][0]] for r in frame.select(found).collect()] == [[None, "a b"], ["c", None], [None, ""]]


def test_no_subtree_is_copied(spark):
    """Nested cards share one list of pieces: time and size follow the page."""
    page = "<div class=card><b>x</b>" * 3000
    record = values(spark, "html string", [(page,)]).select(F.size(h.records_of("html", ("div", "card"), [("b", None)]))).first()
    assert record[0] == 3000
