"""J5 as a structural join on node rows: what lies inside an element is told by intervals, ``pos`` to ``end_pos``.

Both joins are one merge over the rows in document order. The elements that are open at a row stand on a stack; a row
takes those off that end before it, so that each element is put on and taken off once and the work is linear in the
rows, however deeply they are nested. A task holds the open elements of one page and, for ``nearby_texts``, its
pieces of text.

``html_nodes`` gives out the rows of a page one after another, so the merge follows it in the same task without a
shuffle. Rows that come in another order, from a table, go through ``in_document_order`` first. A page ends where its key
changes or the position does not grow: pages that repeat a key one after the other stay apart. Rows may be left out
(elements that nobody asks for); a row with a null position or end is inside nothing and encloses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..functions.html import TEXT
from ..functions.text import SPACE
from ..shipping import ship_by_value

ship_by_value(__name__)

OUT_ROWS = 10_000
OUT_CHARS = 4 << 20


def in_document_order(nodes: DataFrame, page: str) -> DataFrame:
    """Node rows of a table, each page in one task and in order. Here ``page`` must tell pages apart: rows of pages
    that share a key would mix."""
    return nodes.repartition(page).sortWithinPartitions(page, "pos")


class _Pages:
    """Tells where a page begins."""

    def __init__(self) -> None:
        self.key, self.last = None, None

    def begins(self, key, pos: int) -> bool:
        new = self.last is None or key != self.key or pos <= self.last
        self.key, self.last = key, pos
        return new


def with_enclosing(nodes: DataFrame, page: str, tags: Sequence[str], name: str = "block") -> DataFrame:
    """Each node row with the position of the nearest element around it that has one of the tags, -1 where there is
    none. An existing column ``name`` is replaced."""
    nodes = nodes.drop(name)
    wanted = frozenset(tags)
    schema = T.StructType([*nodes.schema.fields, T.StructField(name, T.IntegerType())])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, around = _Pages(), []
        for batch in batches:
            found = []
            for key, pos, end, tag in zip(*(batch.column(c).to_pylist() for c in (page, "pos", "end_pos", "tag")), strict=True):
                if pos is None or end is None:
                    found.append(-1)
                    continue
                if pages.begins(key, pos):
                    around.clear()
                while around and around[-1][1] < pos:
                    around.pop()
                found.append(around[-1][0] if around else -1)
                if tag in wanted and end > pos:
                    around.append((pos, end))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, name])

    return nodes.mapInArrow(joined, schema)


class _Block:
    """An open block: the first two distinct texts inside it, by where their elements begin, and its anchors. Two are enough to
    find the first that differs from a title."""

    def __init__(self) -> None:
        self.texts: list[tuple[int, str]] = []
        self.anchors: list[list] = []

    def offer(self, pos: int, text: str) -> None:
        first: dict[str, int] = {}
        for at, known in [*self.texts, (pos, text)]:
            first[known] = min(at, first.get(known, at))
        self.texts = sorted((at, known) for known, at in first.items())[:2]


class _OpenPage:
    """The elements of a page that are open, innermost last. Texts of blocks are handed on to the block around them when
    they end, so no text is offered to more than one block at a time."""

    def __init__(self, blocks: frozenset, texts: frozenset, shortest: int, longest: int):
        self.blocks, self.texts, self.shortest, self.longest = blocks, texts, shortest, longest
        self.open: list[tuple] = []
        self.pieces: list[str] = []
        self.length = 0
        self.found: list[list] = []

    def row(self, pos: int, end: int, tag: str, href: str | None, text: str | None) -> None:
        self.close(pos)
        if tag == TEXT:
            piece = (text or "").strip(SPACE)
            if piece:
                self.pieces.append(piece)
                self.length += len(piece)
            return
        anchor = ["", href, ""] if tag == "a" else None
        block = _Block() if tag in self.blocks else None
        if anchor is None and block is None and tag not in self.texts:
            return
        around = self.inside()
        if anchor is not None:
            self.found.append(anchor)
            if around is not None:
                around.anchors.append(anchor)
        self.open.append((pos, end, tag, len(self.pieces), self.length, anchor, block, block or around))

    def inside(self) -> _Block | None:
        return self.open[-1][7] if self.open else None

    def close(self, pos: float) -> None:
        while self.open and self.open[-1][1] < pos:
            start, _, tag, piece, length, anchor, block, _ = self.open.pop()
            around = self.inside()
            if anchor is not None:
                anchor[0] = " ".join(self.pieces[piece:])
            if around is not None and tag in self.texts and self.shortest <= self.length - length <= self.longest:
                around.offer(start, "".join(self.pieces[piece:]))
            if block is not None:
                for inner in block.anchors:
                    inner[2] = next((text for _, text in block.texts if text != inner[0]), "")
                if around is not None:
                    for at, text in block.texts:
                        around.offer(at, text)


def nearby_texts(
    nodes: DataFrame,
    page: str,
    blocks: Sequence[str] = tuple(fixed.ANCHOR_BLOCK_TAGS),
    texts: Sequence[str] = tuple(fixed.COMPANY_TAGS),
    shortest: int = 2,
    longest: int = 99,
) -> DataFrame:
    """J5. One row per anchor: ``page``, ``nth`` (from 1 in its page), ``title`` (its text), ``href``, and as ``company``
    the first text of an element with one of the tags ``texts`` inside the nearest block around the anchor that is
    not the title, or the empty string. Only texts of ``shortest`` to ``longest`` letters count, so no longer
    one is put together but the titles themselves. Pages without anchors give no row.

    Columns other than those of a node and ``page`` are not read."""
    wanted = (frozenset(blocks), frozenset(texts), shortest, longest)
    out = T.StructType(
        [nodes.schema[page], T.StructField("nth", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("title", "href", "company")]
    )
    columns = [page, "pos", "end_pos", "tag", "href", "text"]
    names = [page, "nth", "title", "href", "company"]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, current, rows, chars, key_type = _Pages(), _OpenPage(*wanted), [], 0, pa.null()

        def ended(key) -> int:
            current.close(float("inf"))
            rows.extend((key, nth, *anchor) for nth, anchor in enumerate(current.found, 1))
            return sum(len(anchor[0]) + len(anchor[1] or "") for anchor in current.found)

        def batch_of() -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], names)

        for batch in batches:
            key_type = batch.column(page).type
            for key, pos, end, tag, href, text in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if pos is None or end is None:
                    continue
                before = pages.key
                if pages.begins(key, pos):
                    chars += ended(before)
                    current = _OpenPage(*wanted)
                    if len(rows) >= OUT_ROWS or chars >= OUT_CHARS:
                        yield batch_of()
                        rows, chars = [], 0
                current.row(pos, end, tag, href, text)
        ended(pages.key)
        if rows:
            yield batch_of()

    return nodes.select(*columns).mapInArrow(merged, out)
