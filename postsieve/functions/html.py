"""HTML pages as arrays of nodes (X4), and lookups on such arrays.

Only the parse runs in Python, called with Arrow batches: plain markup goes through one pattern, anything else
through the standard library's parser. A page becomes one array of nodes in document order, where ``pos`` is the index
into the array and the descendants of an element are the slice up to ``end_pos``. Lookups (by tag, class token,
enclosing element, text of a subtree) are expressions on that array, without any shuffle or self-join.

Who knows which elements are wanted takes ``records_of``: no nodes are made, the page is one list of text pieces, an
element is the span of pieces between its tags, and a field is a slice of that list. Each field is put with its record
while the page is read, in time linear in the page.
"""

from __future__ import annotations

import html.parser
import re
from collections import Counter
from collections.abc import Sequence
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..shipping import ship_by_value
from .text import SPACE, as_column, strip

ship_by_value(__name__)

NODE = T.StructType(
    [T.StructField(name, T.IntegerType()) for name in ("pos", "end_pos", "depth", "parent_pos")]
    + [
        T.StructField("tag", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("href", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
NODES = T.ArrayType(NODE)
TEXT = "#text"

# Elements that never hold content, and elements whose text is not visible.
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
])
HIDDEN_TEXT_TAGS = frozenset(["rt", "rp", "script", "style", "template"])


class _Tree:
    """The open elements of a page and its visible text, for what is made of them."""

    def __init__(self):
        self.open: list = []
        self.open_tags: Counter[str] = Counter()
        self.buffer: list[str] = []

    def flush(self) -> None:
        if not self.buffer:
            return
        data = "".join(self.buffer)
        self.buffer.clear()
        if any(self.open_tags[tag] for tag in HIDDEN_TEXT_TAGS):
            return
        if not data.strip(" \t\n\r\f\x0b"):
            data = "\n" if "\n" in data else " "
        self.text(data)

    def start(self, tag: str, classes: list[str], href: str | None, closed: bool = False) -> None:
        self.flush()
        element = self.element(tag, classes, href)
        if tag not in VOID_TAGS:
            self.open.append((tag, element))
            self.open_tags[tag] += 1
            if closed:
                self.close_last()

    def close_last(self) -> str:
        tag, element = self.open.pop()
        self.open_tags[tag] -= 1
        self.closed(element)
        return tag

    def end(self, tag: str) -> None:
        self.flush()
        if self.open_tags[tag]:
            while self.close_last() != tag:
                pass

    def finish(self) -> None:
        self.flush()
        while self.open:
            self.close_last()


class _Nodes(_Tree):
    """Appends the nodes of one page to shared columns."""

    def __init__(self, columns: dict[str, list]):
        super().__init__()
        self.columns = columns
        self.first = len(columns["tag"])

    def reset(self) -> None:
        for column in self.columns.values():
            del column[self.first :]
        self.__init__(self.columns)

    def _add(self, tag: str, classes: list[str] | None, href: str | None, text: str | None) -> int:
        c = self.columns
        row = len(c["tag"])
        c["pos"].append(row - self.first)
        c["end_pos"].append(row - self.first)
        c["depth"].append(len(self.open))
        c["parent_pos"].append(self.open[-1][1] - self.first if self.open else -1)
        c["tag"].append(tag)
        c["classes"].append(classes)
        c["href"].append(href)
        c["text"].append(text)
        return row

    def element(self, tag: str, classes: list[str], href: str | None) -> int:
        return self._add(tag, classes, href, None)

    def text(self, data: str) -> None:
        self._add(TEXT, None, None, data)

    def closed(self, row: int) -> None:
        self.columns["end_pos"][row] = len(self.columns["tag"]) - 1 - self.first


class _Records(_Tree):
    """The records of a page: for each element ``root`` (the page, if None) the first element of each of ``fields``
    inside it, as [href, first piece of text, piece after the last]."""

    def __init__(self, root: tuple | None, fields: Sequence[tuple], stripped: bool):
        super().__init__()
        self.root, self.fields, self.stripped = root, fields, stripped
        self.pieces: list[str] = []
        self.records: list[list] = []
        self.inside: list[list] = []  # records whose element is open
        if root is None:
            self.records.append([None] * len(fields))
            self.inside.append(self.records[0])

    def reset(self) -> None:
        self.__init__(self.root, self.fields, self.stripped)

    def element(self, tag: str, classes: list[str], href: str | None) -> tuple | None:
        span = None
        for k, (wanted, token) in enumerate(self.fields):
            if tag == wanted and (token is None or token in classes):
                for record in self.inside:
                    if record[k] is None:
                        span = span or [href, len(self.pieces), len(self.pieces)]
                        record[k] = span
        opened = self.root is not None and tag == self.root[0] and (self.root[1] is None or self.root[1] in classes)
        if opened:
            self.records.append([None] * len(self.fields))
            if tag not in VOID_TAGS:
                self.inside.append(self.records[-1])
        return (span, opened) if span or opened else None

    def text(self, data: str) -> None:
        if self.stripped:
            data = data.strip(SPACE)
        if data:
            self.pieces.append(data)

    def closed(self, element: tuple | None) -> None:
        if element:
            span, opened = element
            if span:
                span[2] = len(self.pieces)
            if opened:
                self.inside.pop()


class _Slow(HTMLParser):
    """Any markup, by the standard library."""

    def __init__(self, tree: _Tree):
        super().__init__(convert_charrefs=True)
        self.tree = tree

    def handle_starttag(self, tag, attrs, closed=False):
        known = {name: value or "" for name, value in attrs}
        self.tree.start(tag, known.get("class", "").split(), known.get("href"), closed)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        self.tree.end(tag)

    def handle_data(self, data):
        self.tree.buffer.append(data)

    def handle_comment(self, data):
        self.tree.flush()

    def handle_decl(self, decl):
        self.tree.flush()


_ATTRIBUTE = r"""[a-z_][\w:.-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[\w.:#%-]+(?!/)))?"""
_TOKEN = re.compile(
    rf"</([a-z][a-z0-9]*)\s*>|<([a-z][a-z0-9]*)((?:\s+{_ATTRIBUTE})*)\s*(/?)>|<!--(?!-?>)(?:(?!--).)*-->|<!doctype[^<>\"'\[]*>",
    re.IGNORECASE | re.ASCII | re.DOTALL,
)
_VALUE = re.compile(r"""\s(class|href)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([\w.:#%-]+)))?(?=\s|$)""", re.IGNORECASE | re.ASCII)
_QUOTED = re.compile(r"""\"[^"]*"|'[^']*'""")
# Elements whose content is text up to their own end tag. With tags inside one of the first, and for the others, the
# standard library decides.
_TEXT_TAGS = frozenset(["title", "textarea"])
_CODE_TAGS = frozenset(["script", "style"])
_LEFT_TO_LIBRARY = frozenset(["xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"])
_attribute_value = getattr(html.parser, "_unescape_attrvalue", unescape)


def _quick(page: str, tree: _Tree) -> bool:
    """Plain markup: tags, quoted attributes, comments and a doctype as they are written in most pages. False, with
    the tree in any state, if there is anything else."""
    at = 0
    while True:
        tag_at = page.find("<", at)
        data = page[at : tag_at if tag_at >= 0 else len(page)]
        if data:
            tree.buffer.append(unescape(data) if "&" in data else data)
        if tag_at < 0:
            return True
        found = _TOKEN.match(page, tag_at)
        if found is None:
            return False
        at = found.end()
        ending, tag, attributes, closed = found.groups()
        if ending:
            tree.end(ending.lower())
        elif tag:
            tag = tag.lower()
            classes, href = [], None
            if attributes:
                values = {}
                for value in _VALUE.finditer(attributes):
                    name, *parts = value.groups()
                    values[name.lower()] = next((p for p in parts if p is not None), "")
                if len(values) and ("class" in attributes.lower() or "href" in attributes.lower()):
                    if any("class" in q.lower() or "href" in q.lower() for q in _QUOTED.findall(attributes)):
                        return False  # a value that looks like an attribute
                    values = {k: _attribute_value(v) if "&" in v else v for k, v in values.items()}
                    classes, href = values.get("class", "").split(), values.get("href")
            if tag in _LEFT_TO_LIBRARY:
                return False
            tree.start(tag, classes, href, bool(closed))
            if tag in _CODE_TAGS or tag in _TEXT_TAGS:
                if closed:
                    return False
                low = page.find("</", at) if tag in _CODE_TAGS else page.find("<", at)
                while tag in _CODE_TAGS and low >= 0 and page[low + 2 : low + 2 + len(tag)].lower() != tag:
                    low = page.find("</", low + 2)
                end = _TOKEN.match(page, low) if low >= 0 else None
                if end is None or (end.group(1) or "").lower() != tag:
                    return False
                data = page[at:low]
                if data:
                    tree.buffer.append(data if tag in _CODE_TAGS else unescape(data))
                tree.end(tag)
                at = end.end()
        else:
            tree.flush()


def _parse(page: str, tree: _Tree) -> None:
    if not _quick(page, tree):
        tree.reset()
        slow = _Slow(tree)
        slow.feed(page)
        slow.close()
    tree.finish()


_NAMES = ["pos", "end_pos", "depth", "parent_pos", "tag", "classes", "href", "text"]
_CHUNK_NODES = 100_000


def _as_arrow(columns: dict[str, list], offsets: list[int]) -> pa.Array:
    ints, strings = pa.int32(), pa.string()
    types = [ints, ints, ints, ints, strings, pa.list_(strings), strings, strings]
    nodes = pa.StructArray.from_arrays([pa.array(columns[n], t) for n, t in zip(_NAMES, types)], _NAMES)
    return pa.ListArray.from_arrays(pa.array(offsets, ints), nodes)


def _parse_batch(pages: pa.Array) -> pa.Array:
    """Turns into Arrow every so many nodes, so that only a chunk of them is ever held as objects."""
    chunks: list[pa.Array] = []
    columns: dict[str, list] = {name: [] for name in _NAMES}
    offsets = [0]
    for page in pages:
        html = page.as_py()
        if html:
            _parse(html, _Nodes(columns))
        offsets.append(len(columns["tag"]))
        if offsets[-1] >= _CHUNK_NODES:
            chunks.append(_as_arrow(columns, offsets))
            columns, offsets = {name: [] for name in _NAMES}, [0]
    chunks.append(_as_arrow(columns, offsets))
    return pa.concat_arrays(chunks)


@F.arrow_udf(NODES)
def _nodes_of(pages: pa.Array) -> pa.Array:
    return _parse_batch(pages)


def nodes_of(html: Column | str) -> Column:
    """X4. The node array of a page; empty for null.

    Marked as not deterministic so that a filter on the result is not pushed below the parse, which
    would parse every page twice.
    """
    return _nodes_of.asNondeterministic()(as_column(html))


def html_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """X4 as a table: one row per node, with the key of its page."""
    return pages.select(key, nodes_of(html).alias("nodes")).select(key, F.inline("nodes"))


RECORDS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])))


def records_of(
    html: Column | str,
    root: tuple[str, str | None] | None,
    fields: Sequence[tuple[str, str | None]],
    stripped: bool = True,
    whole: bool = False,
) -> Column:
    """The records of a page: one for each element ``root`` (tag, class token), or one for the page if that is None,
    with href and text of the first element of each of ``fields`` inside it; null where there is none. Text pieces are
    stripped and joined by blanks, or joined as they are. With ``whole`` a record without any field has a last one, the
    text of the whole page. Null and empty pages are pages without elements."""
    fields = list(fields)

    @F.arrow_udf(RECORDS)
    def records(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages:
            tree = _Records(root, fields, stripped)
            _parse(page.as_py() or "", tree)
            joint = " " if stripped else ""

            def text(span: list) -> dict:
                return {"href": span[0], "text": joint.join(tree.pieces[span[1] : span[2]])}  # noqa: B023

            rows = [[text(span) if span else None for span in record] for record in tree.records]
            if whole:
                rows = [[*row, None if any(row) else text([None, 0, len(tree.pieces)])] for row in rows]
            out.append(rows)
        return pa.array(out, pa.list_(pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))))

    return records.asNondeterministic()(as_column(html))


# --- lookups on a node array -----------------------------------------------------------------------


def has_class(node: Column, token: str) -> Column:
    return F.array_contains(node.classes, token)


def subtree(nodes: Column, element: Column) -> Column:
    """The descendants of an element, in document order."""
    return F.slice(nodes, element.pos + 2, element.end_pos - element.pos)


def elements(nodes: Column, tag: str, token: str | None = None) -> Column:
    def wanted(node: Column) -> Column:
        hit = node.tag == tag
        return hit & has_class(node, token) if token else hit

    return F.filter(nodes, wanted)


def first_element(nodes: Column, tag: str, token: str | None = None) -> Column:
    return F.get(elements(nodes, tag, token), F.lit(0))


def joined_text(nodes: Column, separator: str = " ", stripped: bool = True) -> Column:
    """The text nodes of an array, joined; stripped pieces that are empty are left out."""
    texts = F.filter(nodes, lambda n: n.tag == TEXT)
    if not stripped:
        return F.array_join(F.transform(texts, lambda n: n.text), separator)
    return F.array_join(F.filter(F.transform(texts, lambda n: strip(n.text)), lambda p: p != ""), separator)


def element_text(nodes: Column, element: Column, separator: str = " ", stripped: bool = True) -> Column:
    """Text of an element. ``element`` is a bound variable: it is read three times."""
    return joined_text(subtree(nodes, element), separator, stripped)


def enclosing(nodes: Column, element: Column, tags: Sequence[str]) -> Column:
    """J5. Position of the nearest enclosing element with one of the tags, -1 when there is none.

    Climbs parent by parent: as many steps as the element is deep.
    """

    def climb(at: Column, _: Column) -> Column:
        node = F.get(nodes, at)
        return F.when((at < 0) | node.tag.isin(*tags), at).otherwise(node.parent_pos)

    steps = F.when(element.depth > 0, F.sequence(F.lit(1), element.depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps,
        element.parent_pos,
        climb,
        lambda last: F.when((last >= 0) & F.get(nodes, last).tag.isin(*tags), last).otherwise(F.lit(-1)),
    )
