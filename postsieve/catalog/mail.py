"""S7, S8, P21, F10-F13 as queries: each page becomes a mail message with plain and HTML parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from ..functions.urls import netloc
from ..operators import predicates as p
from ..plans.mail import with_details
from ..sources.mail import mail_candidates, mail_postings, mime_bodies, preferred_body
from .base import HEADING_SQL, contains_any_sql, heading, netloc_sql, query, strip_sql, table
from .. import fixed_values as fixed


def _coded(c: Column) -> Column:
    return F.translate(F.base64(F.encode(c, "UTF-8")), "+/\r\n", "-_")


def _part(mime: str, body: Column) -> Column:
    return F.concat(F.lit('{"mimeType":"%s","body":{"data":"' % mime), _coded(body), F.lit('"}}'))


def _title() -> Column:
    return F.concat(F.lit("Creative Lead "), F.col("page_id").cast("string"))


def messages(spark, sf) -> DataFrame:
    """By page: a mail with posting anchors, one with loose anchors, one with plain lines only, one whose
    HTML part is nested. The whole page follows in the HTML part, its text without tags in the plain one. Every tenth
    number shares its posting id with its neighbours."""
    number = F.col("page_id").cast("string")
    page = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(page, "<[^>]*>?", " ")
    job = (F.floor(F.col("page_id") / 10) * 10 + 4000000000).cast("string")
    posting_url = F.concat(F.lit("https://www.linkedin.com/comm/jobs/view/"), job, F.lit("?trk="), number)
    direct = F.concat(
        F.lit('<html><body><a href="https://www.linkedin.com/help">Creative Lead help</a><table><tr><td><a href="'), posting_url,
        F.lit('"><b>'), _title(), F.lit('</b> Remote</a><p>'), _title(), F.lit("</p><span>"), netloc("url"),
        F.lit('</span></td></tr><tr><td><a href="'), posting_url, F.lit('">'), _title(), F.lit("</a><p>"), netloc("url"),
        F.lit('</p></td></tr></table><a href="'), posting_url, F.lit('">Easy Apply</a></body></html>'), page,
    )
    loose = F.concat(
        F.lit('<html><body><p>'), heading(), F.lit('</p><a href="https://www.linkedin.com/e/'), number, F.lit('">'), _title(),
        F.lit('</a><a href="https://www.linkedin.com/u">Unsubscribe creative lead</a></body></html>'), page,
    )
    lines = F.concat(
        netloc("url"), F.lit("\r\n "), _title(), F.lit(" \r\nView: https://www.linkedin.com/jobs/view/"), job,
        F.lit("?x=1 now\r\nSee all\nhttps://www.linkedin.com/jobs/view/1\n"), bare,
    )
    kind = F.col("page_id") % 4
    plain = _part("text/plain", F.when(kind == 2, lines).otherwise(F.concat(F.lit("no postings here\n"), bare)))
    html = _part("text/html", F.when(kind == 1, loose).otherwise(direct))
    broken = F.lit('{"mimeType":"text/html","body":{"data":"AAAAA"}}')
    inner = F.when(kind == 2, plain).when(
        kind == 3,
        F.concat(F.lit('{"mimeType":"multipart/alternative","parts":['), plain, F.lit(","), broken, F.lit(","), html, F.lit("]}")),
    ).otherwise(F.concat(plain, F.lit(","), html))
    payload = F.concat(F.lit('{"mimeType":"multipart/mixed","parts":['), inner, F.lit("]}"))
    return table(spark, sf, "pages").select(
        F.concat(F.lit("m"), number).alias("msg_id"), F.col("page_id").alias("msg_seq"), payload.alias("payload")
    )


_JOB = "CAST(4000000000 + CAST(floor(page_id / 10) AS BIGINT) * 10 AS VARCHAR)"
_LEAD = "'Creative Lead ' || page_id"
_CANDIDATES = f"""
    SELECT page_id, 1 AS strategy, CAST(0 AS BIGINT) AS pos, {_LEAD} || ' Remote' AS title,
           {_LEAD} AS company, 'https://www.linkedin.com/comm/jobs/view/' || {_JOB} AS url FROM pages WHERE page_id % 4 IN (0, 3)
    UNION ALL
    SELECT page_id, 1, 1, {_LEAD}, {netloc_sql("url")}, 'https://www.linkedin.com/comm/jobs/view/' || {_JOB} FROM pages WHERE page_id % 4 IN (0, 3)
    UNION ALL
    SELECT page_id, 2, 0, {_LEAD}, '', 'https://www.linkedin.com/e/' || page_id FROM pages WHERE page_id % 4 = 1
    UNION ALL
    SELECT page_id, 3, 0, {_LEAD}, {netloc_sql("url")}, 'https://www.linkedin.com/jobs/view/' || {_JOB} FROM pages WHERE page_id % 4 = 2"""


_POSTING = f"'https://www.linkedin.com/comm/jobs/view/' || {_JOB} || '?trk=' || page_id"
_BARE = "regexp_replace(coalesce(html, ''), '<[^>]*>?', ' ', 'g')"
_PLAIN = f"""CASE WHEN page_id % 4 = 2 THEN {netloc_sql("url")} || chr(13) || chr(10) || ' ' || {_LEAD} || ' ' || chr(13) || chr(10)
    || 'View: https://www.linkedin.com/jobs/view/' || {_JOB} || '?x=1 now' || chr(13) || chr(10) || 'See all' || chr(10)
    || 'https://www.linkedin.com/jobs/view/1' || chr(10) ELSE 'no postings here' || chr(10) END || {_BARE}"""
_HTML = f"""CASE WHEN page_id % 4 = 1 THEN '<html><body><p>' || {HEADING_SQL} || '</p><a href="https://www.linkedin.com/e/' || page_id || '">' || {_LEAD}
    || '</a><a href="https://www.linkedin.com/u">Unsubscribe creative lead</a></body></html>'
    ELSE '<html><body><a href="https://www.linkedin.com/help">Creative Lead help</a><table><tr><td><a href="' || {_POSTING} || '"><b>' || {_LEAD}
    || '</b> Remote</a><p>' || {_LEAD} || '</p><span>' || {netloc_sql("url")} || '</span></td></tr><tr><td><a href="' || {_POSTING} || '">' || {_LEAD}
    || '</a><p>' || {netloc_sql("url")} || '</p></td></tr></table><a href="' || {_POSTING} || '">Easy Apply</a></body></html>' END || coalesce(html, '')"""
_BODIES = f"SELECT page_id, {_PLAIN} AS plain, CASE WHEN page_id % 4 <> 2 THEN {_HTML} END AS html FROM pages"


@query(
    "mime_bodies",
    f"""SELECT page_id, CASE WHEN html IS NULL THEN 1 ELSE 2 END AS parts, CASE WHEN html IS NULL THEN 'text/plain' ELSE 'text/plain,text/html' END AS mimes,
              CAST(length(plain) + coalesce(length(html), 0) AS BIGINT) AS chars, md5(plain) || coalesce(',' || md5(html), '') AS digests
       FROM ({_BODIES})""",
)
def mime_bodies_query(spark, sf):
    bodies = messages(spark, sf).select(F.col("msg_seq").alias("page_id"), mime_bodies("payload").alias("b"))
    return bodies.select(
        "page_id", F.size("b").alias("parts"), F.array_join(F.transform("b", lambda x: x.mime), ",").alias("mimes"),
        F.aggregate("b", F.lit(0).cast("long"), lambda n, x: n + F.length(x.body)).alias("chars"),
        F.array_join(F.transform("b", lambda x: F.md5(x.body.cast("binary"))), ",").alias("digests"),
    )


@query(
    "preferred_body",
    f"""SELECT page_id, html IS NOT NULL AS is_html, CAST(length(coalesce(html, plain)) AS BIGINT) AS chars, md5(coalesce(html, plain)) AS digest
       FROM ({_BODIES})""",
)
def preferred_body_query(spark, sf):
    best = messages(spark, sf).select(F.col("msg_seq").alias("page_id"), mime_bodies("payload").alias("b")).select(
        "page_id", preferred_body(F.col("b")).alias("best")
    )
    return best.select("page_id", "best.is_html", F.length("best.body").cast("long").alias("chars"), F.md5(F.col("best.body").cast("binary")).alias("digest"))


@query("mail_candidates", f"SELECT page_id, strategy, pos, title, company, url FROM ({_CANDIDATES})")
def mail_candidates_query(spark, sf):
    return mail_candidates(messages(spark, sf)).select(
        F.col("msg_seq").alias("page_id"), "strategy", "pos", "title", "company", "url"
    )


@query(
    "alert_mail_source",
    f"""WITH c AS ({_CANDIDATES}),
             s AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY CASE strategy WHEN 1 THEN length(title) ELSE 0 END, pos) AS r,
                          min(pos) OVER (PARTITION BY page_id, url) AS first FROM c),
             u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, first) AS n FROM s WHERE r = 1)
        SELECT title, company, url, page_id * 1048576 + first AS pos,
               coalesce((SELECT 'quality ' || quality FROM labels WHERE '40' || lpad(CAST(doc_id * 10 AS VARCHAR), 8, '0') = regexp_extract(url, '/(\\d{{7,}})$', 1)), '') AS description
        FROM u WHERE n = 1""",
)
def alert_mail_source(spark, sf):
    details = table(spark, sf, "labels").select(
        F.format_string("40%08d", F.col("doc_id") * 10).alias("external_id"),
        F.format_string("quality %d", "quality").alias("detail"),
    )
    return with_details(mail_postings(messages(spark, sf)), details).select("title", "company", "url", "pos", "description")


_ANCHOR_SQL = """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS title FROM pages)"""


def _anchors(spark, sf):
    pattern = '<a href="([^"]*)">([^<]*)</a>'
    pairs = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("href"),
        F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("title"),
    )
    return table(spark, sf, "pages").select("page_id", F.inline(pairs))


@query(
    "anchor_url_filter",
    f"{_ANCHOR_SQL} SELECT page_id, href FROM t WHERE contains(href, '/') AND {contains_any_sql('href', ['th', 'qu', 'en'])}",
)
def anchor_url_filter(spark, sf):
    return _anchors(spark, sf).where(p.anchor_url_ok("href", "/", ["th", "qu", "en"])).select("page_id", "href")


_SCAFFOLD = ["the", "est", "qu"]


@query(
    "anchor_text_filter",
    f"{_ANCHOR_SQL} SELECT page_id, title FROM t WHERE length(title) BETWEEN 4 AND 200 AND NOT {contains_any_sql('lower(title)', _SCAFFOLD)}",
)
def anchor_text_filter(spark, sf):
    return _anchors(spark, sf).where(p.anchor_text_ok("title", _SCAFFOLD)).select("page_id", "title")


@query(
    "loose_anchor_filter",
    f"""{_ANCHOR_SQL} SELECT page_id, title FROM t WHERE contains(href, '/') AND length(title) BETWEEN 9 AND 99
        AND NOT {contains_any_sql('lower(title)', _SCAFFOLD)} AND {contains_any_sql('lower(title)', ['tion', 'lich', 'ea'])}""",
)
def loose_anchor_filter(spark, sf):
    rows = _anchors(spark, sf)
    return rows.where(p.loose_anchor_ok("href", "title", ["/"], _SCAFFOLD, ["tion", "lich", "ea"])).select("page_id", "title")


@query(
    "line_title_filter",
    f"""SELECT doc_id, i, title FROM (
          SELECT doc_id, i, {strip_sql("line")} AS title FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))
        WHERE length(title) > 4 AND NOT {contains_any_sql("lower(title)", [*fixed.LINE_SCAFFOLDING, "est"])}""",
)
def line_title_filter(spark, sf):
    """F13 on every line of the documents."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    titles = lines.select("doc_id", F.col("i").cast("long").alias("i"), strip("line").alias("title"))
    return titles.where(p.line_title_ok("title", [*fixed.LINE_SCAFFOLDING, "est"]))
