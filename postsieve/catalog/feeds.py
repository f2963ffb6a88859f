"""S1-S4, S9 as queries: each row of a table is landed as a response in the shape of the feed, then
read back by the source operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.json_feeds import (
    array_feed_postings,
    category_feed_postings,
    paged_search_postings,
    search_api_postings,
)
from ..sources.landed import rejected_payloads
from ..sources.rss import rss_postings
from .base import (
    FIRST_LINE_SQL,
    HEADING_SQL,
    contains_any_sql,
    first_line,
    heading,
    netloc_sql,
    query,
    strip_sql,
    table,
    tags_out_sql,
    thousands_sql,
)

BLOCKED = ["cheap-pills.example.com", "spam-farm.example.org"]
SHOWN = ["title", "company", "url", "description", "salary", "posted", "batch_seq", "pos"]


def landed(rows: DataFrame, payload: Column, seq: str) -> DataFrame:
    """One response per row: the source number is the batch, the row id the response number."""
    return rows.select(
        F.lit("landed").alias("source"),
        F.col("batch").cast("int").alias("batch_seq"),
        F.col(seq).alias("payload_seq"),
        payload.alias("payload"),
    )


def documents(spark, sf):
    return table(spark, sf, "documents").withColumn("batch", F.substring("source", 4, 9).cast("int"))


def pages(spark, sf):
    return table(spark, sf, "pages").withColumn("batch", F.lit(30))


_BATCH = "CAST(substr(source, 4) AS INT)"
_POS = "doc_id * 1048576"


def _money(expr: str, unit: str) -> str:
    return f"CASE WHEN {expr} > 0 THEN '$' || {thousands_sql(expr)} || '–$' || {thousands_sql(f'{expr} * 2.5')} || '{unit}' ELSE '' END"


_SEARCH_URL = "'https://' || CASE lang WHEN 'de' THEN 'www.cheap-pills.example.com' ELSE 'jobs.example.org' END || '/' || doc_id"


@query(
    "search_api_source",
    f"""SELECT {strip_sql(FIRST_LINE_SQL)} AS title, source AS company, {_SEARCH_URL} AS url, substr(text, 1, 1200) AS description,
               {_money("n_chars", " USD/year")} AS salary, '2024-01-0' || (doc_id % 9) AS posted, {_BATCH} AS batch_seq, {_POS} AS pos
        FROM documents WHERE {strip_sql(FIRST_LINE_SQL)} <> '' AND NOT {contains_any_sql(netloc_sql(_SEARCH_URL), BLOCKED)}
        UNION ALL
        SELECT 'second', '', 'https://adref.example.org/' || doc_id, '', '$' || {thousands_sql("n_chars")} || '+ USD/year', '', {_BATCH}, {_POS} + 1
        FROM documents""",
)
def search_api_source(spark, sf):
    url = F.concat(
        F.lit("https://"),
        F.when(F.col("lang") == "de", F.lit("www.cheap-pills.example.com")).otherwise(F.lit("jobs.example.org")),
        F.lit("/"), F.col("doc_id").cast("string"),
    )
    size = F.col("n_chars").cast("double")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    first = F.struct(
        F.concat(F.lit("  "), first_line(), F.lit("\t")).alias("title"),
        F.struct(F.col("source").alias("display_name")).alias("company"),
        url.alias("redirect_url"), F.lit("unused").alias("adref"), F.col("text").alias("description"),
        size.alias("salary_min"), (size * 2.5).alias("salary_max"),
        F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9).cast("string")).alias("created"),
    )
    second = F.struct(
        F.lit("second").alias("title"), F.struct(text.alias("display_name")).alias("company"),
        F.lit("").alias("redirect_url"),
        F.concat(F.lit("https://adref.example.org/"), F.col("doc_id").cast("string")).alias("adref"),
        text.alias("description"), size.alias("salary_min"), number.alias("salary_max"), text.alias("created"),
    )
    payload = F.to_json(F.struct(F.array(first, second).alias("results")))
    return search_api_postings(landed(documents(spark, sf), payload, "doc_id"), blocked=BLOCKED).select(SHOWN)


@query(
    "array_feed_source",
    f"""SELECT {strip_sql(HEADING_SQL)} AS title, {netloc_sql("url")} AS company, url, substr({tags_out_sql("html")}, 1, 1200) AS description,
               CASE WHEN page_id = 0 THEN '' ELSE '$' || {thousands_sql("page_id")} || '–$' || {thousands_sql("page_id + 10000")} END AS salary,
               '' AS posted, 30 AS batch_seq, page_id * 1048576 + 1 AS pos
        FROM pages WHERE {strip_sql(HEADING_SQL)} <> '' AND NOT {contains_any_sql(netloc_sql("url"), BLOCKED)}
          AND (contains(url, '/en/') OR {contains_any_sql(f"lower({HEADING_SQL})", ["est", "lead"])})""",
)
def array_feed_source(spark, sf):
    from ..functions.urls import netloc

    lang = F.when(F.contains("url", F.lit("/en/")), F.lit("Remote")).otherwise(F.lit("None"))
    none = F.lit(None).cast("string")
    item = F.struct(
        heading().alias("position"), netloc("url").alias("company"), F.lit("").alias("apply_url"), F.col("url"),
        F.array(lang).alias("tags"), F.col("html").alias("description"),
        F.col("page_id").cast("double").alias("salary_min"), (F.col("page_id") + 10000.0).alias("salary_max"),
    )
    about = F.struct(
        F.lit("est lead").alias("position"), none.alias("company"), none.alias("apply_url"), F.lit("https://x.example/").alias("url"),
        F.array(F.lit("remote")).alias("tags"), none.alias("description"),
        F.lit(1.0).alias("salary_min"), F.lit(2.0).alias("salary_max"),
    )
    rows = landed(pages(spark, sf), F.to_json(F.array(about, item)), "page_id")
    return array_feed_postings(rows, blocked=BLOCKED, wanted_tags=["remote"], title_terms=["est", "lead"]).select(SHOWN)


_PLACE_SQL = "lower(CASE lang WHEN 'de' THEN 'Europe' WHEN 'fr' THEN 'Africa, Australia' WHEN 'es' THEN 'Worldwide' ELSE 'Canada' END)"


@query(
    "category_feed_source",
    f"""SELECT {strip_sql(FIRST_LINE_SQL)} AS title, source AS company, 'https://jobs.example.org/' || doc_id AS url,
               substr({tags_out_sql("'<p>' || text || '</p>'")}, 1, 1200) AS description, 'about ' || n_chars AS salary, lang AS posted,
               {_BATCH} AS batch_seq, {_POS} AS pos
        FROM documents WHERE {strip_sql(FIRST_LINE_SQL)} <> '' AND {_PLACE_SQL} <> 'europe'""",
)
def category_feed_source(spark, sf):
    place = (
        F.when(F.col("lang") == "de", F.lit("Europe"))
        .when(F.col("lang") == "fr", F.lit("Africa, Australia"))
        .when(F.col("lang") != "es", F.lit("Canada"))
    )
    item = F.struct(
        first_line().alias("title"), F.col("source").alias("company_name"),
        F.concat(F.lit("https://jobs.example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("description"),
        F.concat(F.lit("about "), F.col("n_chars").cast("string")).alias("salary"),
        place.alias("candidate_required_location"), F.col("lang").alias("publication_date"),
    )
    payload = F.to_json(F.struct(F.array(item).alias("jobs")))
    return category_feed_postings(landed(documents(spark, sf), payload, "doc_id"), blocked=BLOCKED).select(SHOWN)


# Entities as a page reader takes them: the semicolon may be missing.
_DECODED = "regexp_replace(regexp_replace({}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
# A heading with a bare ampersand makes the feed unreadable as XML; both its items are lost.
_READABLE = f"NOT contains(replace(replace({HEADING_SQL}, '&quot;', ''), '&amp;', ''), '&')"


@query(
    "rss_source",
    f"""WITH h AS (SELECT page_id, url, html, {_DECODED.format(HEADING_SQL)} AS heading FROM pages WHERE {_READABLE}),
             i AS (SELECT page_id * 1048576 AS pos, url, html, 'Acme ' || page_id || ': ' || heading AS raw FROM h
                   UNION ALL SELECT page_id * 1048576 + 1, url || '/2', '', heading FROM h),
             s AS (SELECT *, position(': ' IN raw) AS cut FROM i)
        SELECT {strip_sql("CASE WHEN cut > 0 THEN substr(raw, cut + 2) ELSE raw END")} AS title,
               {strip_sql("CASE WHEN cut > 0 THEN substr(raw, 1, cut - 1) ELSE '' END")} AS company, url,
               substr({tags_out_sql("html")}, 1, 1200) AS description, '' AS salary, '' AS posted, 30 AS batch_seq, pos
        FROM s WHERE CASE WHEN cut > 0 THEN substr(raw, cut + 2) ELSE raw END <> ''""",
)
def rss_source(spark, sf):
    def escaped(c: Column) -> Column:
        return F.replace(c, F.lit("&"), F.lit("&amp;"))

    number = F.col("page_id").cast("string")
    payload = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title><item><title>Acme '), number, F.lit(": "),
        heading(), F.lit("</title><link>"), escaped(F.col("url")), F.lit("</link><description><![CDATA["), "html",
        F.lit("]]></description></item><item><title>"), heading(), F.lit("</title><link>"), escaped(F.col("url")),
        F.lit("/2</link></item></channel></rss>"),
    )
    return rss_postings(landed(pages(spark, sf), payload, "page_id")).select(SHOWN)


@query(
    "paged_search_source",
    f"""SELECT o_clerk_title AS title, o_orderpriority AS company, 'https://jobs.example.org/' || o_orderkey AS url, o_orderstatus AS description,
               CASE WHEN o_custkey % 2 = 0 THEN '$' || {thousands_sql("o_totalprice")} || '–$' || {thousands_sql("o_totalprice + 1000")} || ' CAD/month'
                    ELSE '$' || {thousands_sql("o_totalprice")} || '+ USD' END AS salary,
               '' AS posted, 31 AS batch_seq, o_orderkey * 1048576 AS pos
        FROM (SELECT *, 'Order ' || o_custkey AS o_clerk_title FROM orders)""",
)
def paged_search_source(spark, sf):
    even = F.col("o_custkey") % 2 == 0
    none = F.lit(None).cast("string")
    item = F.struct(
        F.concat(F.lit(" Order "), F.col("o_custkey").cast("string")).alias("job_title"),
        F.col("o_orderpriority").alias("employer_name"), none.alias("job_apply_link"),
        F.concat(F.lit("https://jobs.example.org/"), F.col("o_orderkey").cast("string")).alias("job_url"),
        F.col("o_orderstatus").alias("job_description"), F.col("o_totalprice").alias("job_min_salary"),
        F.when(even, F.col("o_totalprice") + 1000).alias("job_max_salary"),
        F.when(even, F.lit("CAD")).alias("job_salary_currency"), F.when(even, F.lit("month")).alias("job_salary_period"),
        none.alias("job_posted_at_datetime_utc"),
    )
    payload = F.to_json(F.struct(F.array(item).alias("data")))
    rows = landed(table(spark, sf, "orders").withColumn("batch", F.lit(31)), payload, "o_orderkey")
    return paged_search_postings(rows, blocked=BLOCKED).select(SHOWN)


@query("rejected_payloads", "SELECT event_id FROM events WHERE value < 5")
def rejected_payloads_query(spark, sf):
    """Responses that cannot be read: cut-off JSON for some of the rows."""
    cut = F.when(F.col("value") < 5, F.lit('{"k": ')).otherwise(F.col("props"))
    rows = landed(table(spark, sf, "events").withColumn("batch", F.lit(1)), cut, "event_id")
    return rejected_payloads(rows).select(F.col("payload_seq").alias("event_id"))
