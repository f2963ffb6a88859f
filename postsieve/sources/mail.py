"""Alert mail to postings.

Everything up to the candidate rows happens inside the row of a message: its parts, its best body, the
anchors of the body, the lines of the body and the choice of strategy. Only the candidates, small rows,
are shuffled, by message and url and then by url.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..functions.html import (
    element_text,
    elements,
    enclosing,
    nodes_of,
    subtree,
)
from ..functions.text import as_column, base64url_text, bind, strip
from ..functions.urls import canonical_url, url_in_line, without_query
from ..operators import predicates as p
from ..operators.dedup import first_row_per_url, shortest_per_key
from ..shipping import ship_by_value
from .landed import position

ship_by_value(__name__)

PARTS = T.ArrayType(
    T.StructType([T.StructField("mime", T.StringType()), T.StructField("data", T.StringType())])
)
CANDIDATE = "struct<title:string,company:string,url:string>"


@F.arrow_udf(PARTS)
def _mime_parts(payloads: pa.Array) -> pa.Array:
    """S8. Text parts of the tree in pre-order. A tree of any depth has no fixed schema for from_json,
    and a recursive query would run one job per level over all messages."""
    offsets, mimes, data = [0], [], []
    for payload in payloads:
        try:
            open_parts = [json.loads(payload.as_py() or "null")]
        except ValueError:
            open_parts = []
        while open_parts:
            part = open_parts.pop()
            if not isinstance(part, dict):
                continue
            body = part.get("body")
            content = body.get("data") if isinstance(body, dict) else None
            if isinstance(content, str) and content and part.get("mimeType") in ("text/html", "text/plain"):
                mimes.append(part["mimeType"])
                data.append(content)
            inner = part.get("parts")
            open_parts.extend(reversed(inner if isinstance(inner, list) else []))
        offsets.append(len(mimes))
    parts = pa.StructArray.from_arrays([pa.array(mimes, pa.string()), pa.array(data, pa.string())], ["mime", "data"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)


def mime_bodies(payload: Column | str) -> Column:
    """S8. Array of ``mime, body``; parts that cannot be decoded are left out."""
    decoded = F.transform(
        _mime_parts.asNondeterministic()(as_column(payload)),
        lambda part: F.struct(part.mime.alias("mime"), base64url_text(part.data).alias("body")),
    )
    return F.filter(decoded, lambda part: part.body.isNotNull())


def preferred_body(bodies: Column) -> Column:
    """P21. The first HTML part unless empty, else the first plain part; null when there is neither."""

    def first(mime: str) -> Column:
        return F.get(F.filter(bodies, lambda part: part.mime == mime), F.lit(0)).body

    html = F.nullif(first("text/html"), F.lit(""))
    plain = F.nullif(first("text/plain"), F.lit(""))
    return F.struct(F.coalesce(html, plain).alias("body"), html.isNotNull().alias("is_html"))


def anchors(nodes: Column) -> Column:
    """Anchors with a target: their text, target and position in the page."""
    return F.transform(
        F.filter(elements(nodes, "a"), lambda a: a.href.isNotNull()),
        lambda a: F.struct(
            element_text(nodes, a).alias("title"),
            a.href.alias("href"),
            enclosing(nodes, a, fixed.ANCHOR_BLOCK_TAGS).alias("block"),
        ),
    )


def block_texts(nodes: Column, blocks: Column, tags: Sequence[str] = tuple(fixed.COMPANY_TAGS)) -> Column:
    """J5. For each block, the first two distinct texts of length 2 to 99 among its elements.

    Two are enough to find the first that differs from a given title, and a block that encloses many
    anchors is looked at once.
    """

    def texts(block: Column) -> Column:
        inside = F.filter(subtree(nodes, F.get(nodes, block)), lambda n: n.tag.isin(*tags))
        read = F.transform(inside, lambda n: element_text(nodes, n, ""))
        return F.slice(F.array_distinct(F.filter(read, lambda t: F.length(t).between(2, 99))), 1, 2)

    return F.map_from_entries(F.transform(blocks, lambda b: F.struct(b, texts(b))))


def with_nearby_text(nodes: Column, found: Column, tags: Sequence[str] = tuple(fixed.COMPANY_TAGS)) -> Column:
    """J5. Anchors (``title, href, block``) with the text nearby as ``company``."""
    blocks = F.array_distinct(F.filter(F.transform(found, lambda a: a.block), lambda b: b >= 0))
    return bind(
        block_texts(nodes, blocks, tags),
        lambda texts: F.transform(
            found,
            lambda a: F.struct(
                a.title.alias("title"), nearby_text(texts, a.block, a.title).alias("company"), a.href.alias("href")
            ),
        ),
    )


def nearby_text(texts_by_block: Column, block: Column, title: Column) -> Column:
    """J5. First text of the enclosing block that is not the title, empty when there is none."""
    other = F.filter(F.try_element_at(texts_by_block, block), lambda t: t != title)
    return F.coalesce(F.get(other, F.lit(0)), F.lit(""))


def posting_anchors(found: Column) -> Column:
    """Strategy 1a: anchors with a posting url, before the company is looked up."""
    return F.filter(
        found,
        lambda a: p.anchor_url_ok(a.href) & p.anchor_text_ok(a.title) & ~p.location_only(a.title),
    )


def loose_anchors(found: Column) -> Column:
    """Strategy 1b: anchors whose text alone looks like a posting; the target stays as it is."""
    kept = F.filter(found, lambda a: p.loose_anchor_ok(a.href, a.title))
    return F.transform(
        kept, lambda a: F.struct(a.title.alias("title"), F.lit("").alias("company"), a.href.alias("url"))
    )


def with_preceding(lines: Column) -> Column:
    """W4. Each line with the two lines before it, stripped; empty where there is none.

    The lines are read from the array of their own body, so no window and no shuffle is needed.
    """

    def before(i: Column, n: int) -> Column:
        return F.when(i >= n, strip(F.get(lines, i - n))).otherwise("")

    return F.transform(
        lines,
        lambda line, i: F.struct(
            strip(line).alias("line"), before(i, 1).alias("title"), before(i, 2).alias("company")
        ),
    )


def preceding_lines(messages: DataFrame, key: str, body: str) -> DataFrame:
    """W4 as a table: one row per line of a body."""
    lines = messages.select(key, F.split(body, "\n").alias("lines"))
    rows = lines.select(key, F.posexplode(with_preceding(F.col("lines"))).alias("pos", "w"))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), "w.*")


def line_postings(lines: Column) -> Column:
    """Strategy 2, F13: a line with a posting url; the two lines before are title and company."""
    marked = F.filter(with_preceding(lines), lambda w: p.contains_any(w.line, fixed.LINE_URL_MARKERS))
    candidates = F.transform(
        marked,
        lambda w: F.struct(
            w.title.alias("title"), w.company.alias("company"), without_query(url_in_line(w.line)).alias("url")
        ),
    )
    return F.filter(candidates, lambda c: (c.url != "") & p.line_title_ok(c.title))


def mail_candidates(messages: DataFrame) -> DataFrame:
    """W6 included: per message the rows of the first strategy that gives any, tagged 1, 2 or 3."""
    bodies = messages.select("msg_id", "msg_seq", mime_bodies("payload").alias("bodies"))
    best = bodies.select("msg_id", "msg_seq", preferred_body(F.col("bodies")).alias("best"))
    best = best.select("msg_id", "msg_seq", "best.*").where(F.coalesce("body", F.lit("")) != "")
    as_html = F.col("is_html") | F.contains(F.lower("body"), F.lit("<html"))
    parsed = best.withColumn("nodes", nodes_of(F.when(as_html, F.col("body"))))
    found = parsed.withColumn("found", anchors(F.col("nodes")))
    picked = found.withColumn("direct", posting_anchors(F.col("found"))).withColumn(
        "loose", loose_anchors(F.col("found"))
    )
    near = picked.withColumn("direct", with_nearby_text(F.col("nodes"), F.col("direct")))
    direct = F.transform(
        "direct",
        lambda a: F.struct(a.title.alias("title"), a.company.alias("company"), canonical_url(a.href).alias("url")),
    )
    rows = near.withColumn("lines", F.split("body", "\n")).select(
        "msg_id",
        "msg_seq",
        F.when(F.size("direct") > 0, F.lit(1)).when(F.size("loose") > 0, F.lit(2)).otherwise(F.lit(3)).alias("strategy"),
        F.posexplode(
            F.when(F.size("direct") > 0, direct.cast(f"array<{CANDIDATE}>"))
            .when(F.size("loose") > 0, F.col("loose").cast(f"array<{CANDIDATE}>"))
            .otherwise(line_postings(F.col("lines")).cast(f"array<{CANDIDATE}>"))
        ).alias("pos", "c"),
    )
    return rows.select("msg_id", "msg_seq", "strategy", F.col("pos").cast("long").alias("pos"), "c.*")


def mail_postings(messages: DataFrame, source: str = fixed.MAIL, batch_seq: int = 1) -> DataFrame:
    """S7 without its enrichment: A3 per message and url, then W3 across messages.

    The title length only counts for posting anchors; the other strategies keep the first row.
    """
    rows = mail_candidates(messages)
    length = F.when(F.col("strategy") == 1, F.length("title")).otherwise(F.lit(0))
    shortest = shortest_per_key(rows, ["msg_id", "msg_seq", "url"], "title", "pos", length)
    unique = first_row_per_url(shortest, "url", ("msg_seq", "pos"))
    return unique.select(
        "title", "company", "url",
        F.lit("").alias("description"), F.lit("").alias("salary"),
        F.lit(source).alias("source"), F.lit("").alias("posted"),
        F.lit(batch_seq).alias("batch_seq"),
        position(F.col("pos"), "msg_seq"),
    )
