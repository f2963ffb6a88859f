"""P1-P12, P15-P17, P22 as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import salary, text, urls
from ..functions.responses import json_in_text
from .base import (
    FIRST_LINE_SQL,
    HEADING_SQL,
    content_id_sql,
    heading,
    netloc_sql,
    query,
    strip_sql,
    table,
    tags_out_sql,
    thousands_sql,
)


@query(
    "strip_whitespace",
    "SELECT doc_id, "
    + strip_sql("chr(160) || chr(10) || chr(9) || text || ' ' || chr(12288) || chr(13)")
    + " AS stripped FROM documents",
)
def strip_whitespace(spark, sf):
    padded = F.concat(F.lit("\u00a0\n\t"), "text", F.lit(" \u3000\r"))
    return table(spark, sf, "documents").select("doc_id", text.strip(padded).alias("stripped"))


@query(
    "html_strip_truncate",
    f"SELECT page_id, substr({tags_out_sql('html')}, 1, 1200) AS description FROM pages",
)
def html_strip_truncate(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.truncate(text.strip_tags("html"), 1200).alias("description")
    )


@query(
    "salary_min_text",
    f"SELECT p_partkey, '$' || {thousands_sql('p_retailprice * 100')} || '+ USD/year' AS salary FROM part",
)
def salary_min_text(spark, sf):
    low, none = F.col("p_retailprice") * 100, F.lit(None).cast("double")
    return table(spark, sf, "part").select("p_partkey", salary.salary_with_unit(low, none).alias("salary"))


@query(
    "salary_range_text",
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
        CASE WHEN l_discount = 0 THEN ''
             WHEN l_tax = 0 THEN '$' || {thousands_sql('l_extendedprice')} || '+'
             ELSE '$' || {thousands_sql('l_extendedprice')} || '–$' || {thousands_sql('l_extendedprice * 2')} END AS salary
        FROM lineitem""",
)
def salary_range_text(spark, sf):
    low = F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice"))
    high = F.when(F.col("l_tax") == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice") * 2)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", salary.salary_plain(low, high).alias("salary")
    )


@query(
    "salary_currency_text",
    f"""SELECT c_custkey,
        CASE WHEN c_acctbal = 0 THEN ''
             WHEN c_nationkey < 12 THEN '$' || {thousands_sql('c_acctbal')} || '–$' || {thousands_sql('c_acctbal + 500')}
                  || ' ' || coalesce(CASE WHEN c_mktsegment <> 'MACHINERY' THEN substr(c_mktsegment, 1, 3) END, 'USD') || '/year'
             ELSE '$' || {thousands_sql('c_acctbal')} || '+ '
                  || coalesce(CASE WHEN c_mktsegment <> 'MACHINERY' THEN substr(c_mktsegment, 1, 3) END, 'USD') END AS salary
        FROM customer""",
)
def salary_currency_text(spark, sf):
    code = F.when(F.col("c_mktsegment") != "MACHINERY", F.substring("c_mktsegment", 1, 3))
    high = F.when(F.col("c_nationkey") < 12, F.col("c_acctbal") + 500)
    return table(spark, sf, "customer").select(
        "c_custkey",
        salary.salary_with_currency("c_acctbal", high, code, F.lit(None).cast("string")).alias("salary"),
    )


@query(
    "company_title_split",
    f"""WITH h AS (SELECT page_id, CASE WHEN length(url) > 36 THEN {HEADING_SQL}
                  ELSE lower(substr(url, 1, 12)) || ': ' || {HEADING_SQL} || ': more' END AS raw FROM pages)
        SELECT page_id,
               CASE WHEN position(': ' IN raw) > 0 THEN substr(raw, 1, position(': ' IN raw) - 1) ELSE '' END AS company,
               CASE WHEN position(': ' IN raw) > 0 THEN substr(raw, position(': ' IN raw) + 2) ELSE raw END AS title
        FROM h""",
)
def company_title_split(spark, sf):
    prefixed = F.concat(F.lower(F.substring("url", 1, 12)), F.lit(": "), heading(), F.lit(": more"))
    raw = F.when(F.length("url") > 36, heading()).otherwise(prefixed)
    rows = table(spark, sf, "pages").select("page_id", text.company_and_title(raw).alias("t"))
    return rows.select("page_id", "t.company", "t.title")


@query(
    "first_nonempty_url",
    """SELECT page_id, coalesce(nullif(CASE WHEN contains(url, '?') THEN '' ELSE url END, ''),
              nullif(split_part(url, '?', 1), ''), '') AS url FROM pages""",
)
def first_nonempty_url(spark, sf):
    own = F.when(F.contains("url", F.lit("?")), F.lit("")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", urls.first_url(own, F.split_part("url", F.lit("?"), F.lit(1))).alias("url"))


@query(
    "canonical_url",
    r"""WITH u AS (SELECT page_id, CASE WHEN length(url) > 36
                     THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'currentJobId=' || page_id || '%41'
                     ELSE url END AS u FROM pages),
             q AS (SELECT *, regexp_extract(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '(?:^|&)currentJobId=([^&]+)', 1) AS v FROM u)
        SELECT page_id, CASE WHEN v <> '' THEN 'https://www.linkedin.com/jobs/view/' || url_decode(v) || '/'
                             ELSE split_part(u, '?', 1) END AS url FROM q""",
)
def canonical_url(spark, sf):
    joined = F.concat(
        "url",
        F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?")),
        F.lit("currentJobId="),
        F.col("page_id").cast("string"),
        F.lit("%41"),
    )
    raw = F.when(F.length("url") > 36, joined).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(raw).alias("url"))


@query(
    "external_id",
    r"""WITH u AS (SELECT page_id, CASE page_id % 5
                     WHEN 0 THEN url
                     WHEN 1 THEN 'https://site.example/jobs/view/a-title-at-' || page_id || '-' || (4000000000 + page_id) || '?x=1'
                     WHEN 2 THEN 'https://site.example/jobs/' || (1000000 + page_id) || '/'
                     WHEN 3 THEN 'https://site.example/search?a=b&currentJobId=' || page_id
                     ELSE 'https://site.example/p/' || (70000000 + page_id) || '#top' END AS u FROM pages)
        SELECT page_id, coalesce(nullif(regexp_extract(u, 'currentJobId=(\d+)', 1), ''),
                 nullif(regexp_extract(u, '/(?:comm/)?jobs/view/[^/?\s#]*?(\d{6,})(?:[/?#]|$)', 1), ''),
                 nullif(regexp_extract(u, '/jobs/(\d{6,})(?:[/?#]|$)', 1), ''),
                 nullif(regexp_extract(u, '(\d{7,})(?:[/?#]|$)', 1), '')) AS external_id FROM u""",
)
def external_id(spark, sf):
    def numbered(start: str, base: int, end: str = ""):
        return F.concat(F.lit(start), (F.col("page_id") + base).cast("string"), F.lit(end))

    kind = F.col("page_id") % 5
    raw = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat(numbered("https://site.example/jobs/view/a-title-at-", 0), numbered("-", 4000000000, "?x=1")))
        .when(kind == 2, numbered("https://site.example/jobs/", 1000000, "/"))
        .when(kind == 3, numbered("https://site.example/search?a=b&currentJobId=", 0))
        .otherwise(numbered("https://site.example/p/", 70000000, "#top"))
    )
    return table(spark, sf, "pages").select("page_id", urls.external_id(raw).alias("external_id"))


@query(
    "content_id",
    f"SELECT page_id, {content_id_sql(HEADING_SQL, netloc_sql('url'))} AS id FROM pages",
)
def content_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.content_id(heading(), urls.netloc("url")).alias("id"))


@query("netloc", f"SELECT page_id, {netloc_sql('url')} AS host FROM pages")
def netloc(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.netloc("url").alias("host"))


@query(
    "lower_tags",
    "SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda t: lower(t)), ' ') AS tags FROM documents",
)
def lower_tags(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.lower_tags(F.split("text", " ")), " ").alias("tags")
    )


@query(
    "json_in_text",
    r"""SELECT event_id, nullif(regexp_extract(CASE WHEN value < 3 THEN 'no answer ' || props
                 WHEN value < 6 THEN 'none' ELSE 'Sure:' || chr(10) || '{"a": ' || props || chr(10) || '} ok' END,
                 '(?s)\{.*\}', 0), '') AS found FROM events""",
)
def json_object_in_text(spark, sf):
    raw = (
        F.when(F.col("value") < 3, F.concat(F.lit("no answer "), "props"))
        .when(F.col("value") < 6, F.lit("none"))
        .otherwise(F.concat(F.lit('Sure:\n{"a": '), "props", F.lit("\n} ok")))
    )
    return table(spark, sf, "events").select("event_id", json_in_text(raw).alias("found"))


@query(
    "score_bar",
    """WITH s AS (SELECT event_id, CAST(trunc(value / 10) AS INT) - 2 AS score FROM events)
       SELECT event_id, repeat('●', greatest(least(score, 5), 0)) || repeat('○', greatest(0, 5 - least(score, 5))) AS dots FROM s""",
)
def score_bar(spark, sf):
    score = (F.col("value") / 10).cast("int") - 2
    return table(spark, sf, "events").select("event_id", text.score_bar(score).alias("dots"))


@query(
    "base64url_roundtrip",
    "SELECT doc_id, CASE WHEN lang = 'en' OR strlen(text) % 3 = 0 THEN text END AS body FROM documents",
)
def base64url_roundtrip(spark, sf):
    """Padded for one language, unpadded for the others, where only whole groups can be read."""
    coded = F.translate(F.base64(F.encode("text", "UTF-8")), "+/", "-_")
    sent = F.when(F.col("lang") == "en", coded).otherwise(F.rtrim(coded, F.lit("=")))
    return table(spark, sf, "documents").select("doc_id", text.base64url_text(sent).alias("body"))


@query(
    "default_location",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Worldwide' ELSE o_orderpriority END AS location FROM orders",
)
def default_location(spark, sf):
    place = F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", text.default_text(place, "Worldwide").alias("location"))


@query(
    "url_in_line",
    r"""SELECT doc_id, i, regexp_extract(CASE WHEN i % 3 = 0 THEN line ELSE 'see <https://a.linkedin.com/jobs/view/' || doc_id || '?x=' || lang || '> ' || line END,
                'https?://[^\s<>"]+linkedin\.com[^\s<>"]*jobs[^\s<>"]*', 0) AS url
        FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)""",
)
def url_in_line(spark, sf):
    """P22 on every line of the documents; two of three get a url."""
    lines = table(spark, sf, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    marked = F.concat(F.lit("see <https://a.linkedin.com/jobs/view/"), F.col("doc_id").cast("string"), F.lit("?x="), "lang", F.lit("> "), "line")
    line = F.when(F.col("i") % 3 == 0, F.col("line")).otherwise(marked)
    return lines.select("doc_id", F.col("i").cast("long").alias("i"), urls.url_in_line(line).alias("url"))
