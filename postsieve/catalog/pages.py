"""X4, J5, S5, S6 as queries over the raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import TEXT, html_nodes
from ..functions.urls import netloc
from ..operators.enclosing import nearby_texts
from ..sources.cards import card_postings, detail_pages
from .base import HEADING_SQL, heading, netloc_sql, query, strip_sql, table
from .feeds import _DECODED

_BODY_ENTITIES = "replace(replace(" + _DECODED + ", '&copy;', '©'), '&middot;', '·')"


_HREF_SQL = _DECODED.format("regexp_extract(token, 'href=\"([^\"]*)\"', 1)")

# A walk over the tokens of each page with the open elements as two lists. The code of scripts and styles is no text.
HTML_NODES_SQL = rf"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|[^<]+') AS tokens
  FROM pages
),
w AS (
  SELECT page_id, 0 AS i, 0 AS pos, CAST([] AS VARCHAR[]) AS tags, CAST([] AS INT[]) AS places, 'gap' AS kind, '' AS name, '' AS token,
    0 AS depth, -1 AS parent_pos, CAST([] AS INT[]) AS ended
  FROM t
  UNION ALL
  SELECT page_id, i + 1, pos + CAST(k IN ('open', 'void', 'text') AS INT),
    CASE WHEN k = 'open' THEN list_append(tags, n) WHEN k = 'close' AND hit > 0 THEN tags[1 : hit - 1] ELSE tags END,
    CASE WHEN k = 'open' THEN list_append(places, pos) WHEN k = 'close' AND hit > 0 THEN places[1 : hit - 1] ELSE places END,
    k, n, x, len(tags), coalesce(places[len(places)], -1), CASE WHEN k = 'close' AND hit > 0 THEN places[hit:] ELSE CAST([] AS INT[]) END
  FROM (
    SELECT *, CASE WHEN list_contains(tags, n) THEN len(tags) - list_position(list_reverse(tags), n) + 1 ELSE 0 END AS hit
    FROM (
      SELECT *, lower(regexp_extract(x, '^</?([A-Za-z0-9]+)', 1)) AS n,
        CASE WHEN x LIKE '<!%' THEN 'gap' WHEN x LIKE '</%' THEN 'close' WHEN x NOT LIKE '<%' THEN 'text'
          WHEN regexp_matches(x, '^<(script|style|meta|br|img|hr|link|input)[ />]') THEN 'void' ELSE 'open' END AS k
      FROM (SELECT w.*, tokens[i + 1] AS x FROM w JOIN t USING (page_id) WHERE i < len(tokens))
    )
  )
),
e AS (SELECT page_id, unnest(ended) AS pos, w.pos - 1 AS end_pos FROM w),
z AS (SELECT page_id, max(pos) - 1 AS last FROM w GROUP BY page_id),
o AS (SELECT page_id, unnest(places) AS pos FROM w JOIN t USING (page_id) WHERE i = len(tokens)),
n AS (SELECT page_id, pos - 1 AS pos, kind, name, token, depth, parent_pos FROM w WHERE kind IN ('open', 'void', 'text'))
SELECT n.page_id, CAST(n.pos AS INT) AS pos, CAST(coalesce(e.end_pos, CASE WHEN o.pos IS NOT NULL THEN z.last END, n.pos) AS INT) AS end_pos,
  CAST(depth AS INT) AS depth, CAST(parent_pos AS INT) AS parent_pos, CASE WHEN kind = 'text' THEN '#text' ELSE name END AS tag,
  CASE WHEN kind = 'text' THEN '' ELSE regexp_extract(regexp_extract(token, '^<[^>]*>'), 'class="([^"]*)"', 1) END AS classes,
  CASE WHEN kind <> 'text' AND contains(regexp_extract(token, '^<[^>]*>'), 'href="') THEN {_HREF_SQL} END AS href,
  CASE WHEN kind = 'text' THEN CASE WHEN trim(token, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''
    THEN CASE WHEN contains(token, chr(10)) THEN chr(10) ELSE ' ' END ELSE {_BODY_ENTITIES.format("token")} END END AS text
FROM n LEFT JOIN e USING (page_id, pos) LEFT JOIN o USING (page_id, pos) JOIN z USING (page_id)
"""


@query("html_nodes", HTML_NODES_SQL)
def html_nodes_query(spark, sf):
    return html_nodes(table(spark, sf, "pages"), "page_id", "html").withColumn(
        "classes", F.concat_ws(" ", "classes")
    )


@query(
    "html_node_counts",
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
       SELECT page_id, tag, count(*) AS n FROM t GROUP BY page_id, tag""",
)
def html_node_counts(spark, sf):
    nodes = html_nodes(table(spark, sf, "pages"), "page_id", "html")
    return nodes.where(F.col("tag") != TEXT).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "nearest_ancestor",
    f"""WITH a AS (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1),
                          lambda t: {strip_sql(_DECODED.format("t"))}) AS titles FROM pages),
             b AS (SELECT page_id, unnest(titles) AS title, generate_subscripts(titles, 1) AS nth, titles FROM a)
        SELECT page_id, nth, title,
               coalesce(list_filter(titles, lambda t: length(t) BETWEEN 2 AND 99 AND t <> title)[1], '') AS company
        FROM b""",
)
def nearest_ancestor(spark, sf):
    """For each anchor the first other text inside its enclosing navigation block."""
    nodes = html_nodes(table(spark, sf, "pages"), "page_id", "html")
    near = nearby_texts(nodes, "page_id", ["nav", "div"], ["li"])
    return near.select("page_id", "nth", "title", "company")


@query(
    "card_source",
    f"""WITH p AS (SELECT page_id, url, {strip_sql(_DECODED.format(HEADING_SQL))} AS h, {netloc_sql("url")} AS host FROM pages)
        SELECT h AS title, host AS company, split_part(url, '?', 1) AS url, page_id * 1048576 AS pos FROM p WHERE h <> ''
        UNION ALL
        SELECT 'Lead ' || h, '', 'https://jobs.example.org/' || page_id, page_id * 1048576 + 1 FROM p""",
)
def card_source(spark, sf):
    """Three cards after the text of each page; the last one has no link and is no posting."""
    number = F.col("page_id").cast("string")
    cards = F.concat(
        "html",
        F.lit('<div class="base-card wide"><h3 class="base-search-card__title">\n '), heading(),
        F.lit('\n</h3><h4 class="x base-search-card__subtitle"> <b>'), netloc("url"),
        F.lit('</b></h4><a class="base-card__full-link" href="'), F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit('">open</a></div><div class="base-card"><a href="/no">x</a><h3 class="base-search-card__title">Lead <i>'),
        heading(),
        F.lit('</i></h3><a class="base-card__full-link" href="https://jobs.example.org/'), number,
        F.lit('">open</a></div><div class="base-card"><h3 class="base-search-card__title">No link</h3></div>'),
    )
    rows = table(spark, sf, "pages").select(
        F.lit("cards").alias("source"), F.lit(2).alias("batch_seq"), F.col("page_id").alias("payload_seq"), cards.alias("payload")
    )
    return card_postings(rows).select("title", "company", "url", "pos")


_VISIBLE = r"""array_to_string(list_filter(list_transform(string_split_regex(
    regexp_replace(html, '<style[^>]*>[^<]*</style>|<script>.*?</script>|<!--.*?-->', '<x>', 'g'), '<[^>]*>'),
    lambda t: trim(t, ' ' || chr(10) || chr(9) || chr(13) || chr(160))), lambda t: t <> ''), ' ')"""


@query(
    "detail_source",
    f"""SELECT page_id AS external_id, substr(CASE WHEN contains(url, '/en/') THEN {_BODY_ENTITIES.format(_VISIBLE)}
               ELSE {strip_sql(_DECODED.format(HEADING_SQL))} || CASE WHEN {HEADING_SQL} = '' THEN '' ELSE ' ' END || 'at ' || {netloc_sql("url")} END, 1, 4000) AS detail
        FROM pages""",
)
def detail_source(spark, sf):
    """Some pages as they are, the others with a section and, as first choice, a marked-up container."""
    marked = F.concat(
        "html", F.lit('<section class="show-more-less-html"><p>outer</p><div class="a show-more-less-html__markup"><p>'),
        heading(), F.lit(" </p>at <b>"), netloc("url"), F.lit("</b><script>x()</script></div></section>"),
    )
    payload = F.when(F.contains("url", F.lit("/en/")), F.col("html")).otherwise(marked)
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("external_id"), payload.alias("payload"))
    return detail_pages(rows)
