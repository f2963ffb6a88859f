"""W1-W6, A2, A3, J1, O1, O3, U1 as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_id
from ..functions.urls import netloc
from ..operators.dedup import first_batch_wins, first_row_per_key, first_row_per_url, shortest_per_key, strategy_fallback
from ..operators.joins import enrich
from ..operators.ranking import by_score, digest, first_per_group, lane_counts, top_per_lane, union_sources
from ..sources.mail import preceding_lines
from .base import FIRST_LINE_SQL, HEADING_SQL, content_id_sql, first_line, heading, netloc_sql, query, strip_sql, table

_BATCH = "CAST(substr(source, 4) AS INT)"


def batches(spark, sf):
    """Documents as arrivals: the source number is the batch, the document id the position."""
    return table(spark, sf, "documents").select(
        F.substring("source", 4, 9).cast("int").alias("batch_seq"), F.col("doc_id").alias("pos"), "text", "lang", "source"
    )


def scored_events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("pos"),
        F.col("user_id").cast("int").alias("batch_seq"),
        F.col("event_type").alias("category"),
        F.floor("value").cast("int").alias("score"),
    )


@query(
    "first_batch_by_key",
    f"""SELECT doc_id FROM (SELECT doc_id, rank() OVER (PARTITION BY md5(text) ORDER BY {_BATCH}) AS r FROM documents) WHERE r = 1""",
)
def first_batch_by_key(spark, sf):
    rows = batches(spark, sf).select(F.md5("text").alias("url"), "batch_seq", "pos")
    return first_batch_wins(rows).select(F.col("pos").alias("doc_id"))


@query(
    "first_row_per_id",
    f"""WITH d AS (SELECT doc_id, {_BATCH} AS b, {content_id_sql("text", "lang")} AS id FROM documents)
        SELECT id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b, doc_id) AS r FROM d) WHERE r = 1""",
)
def first_row_per_id(spark, sf):
    rows = batches(spark, sf).select(
        content_id("text", "lang").alias("id"), "batch_seq", "pos"
    )
    return first_row_per_key(rows, "id").select("id", F.col("pos").alias("doc_id"))


@query(
    "first_row_per_url",
    f"""WITH p AS (SELECT page_id, {netloc_sql("url")} AS url FROM pages)
        SELECT url, min(page_id) AS page_id FROM p WHERE url <> '' GROUP BY url""",
)
def first_row_per_url_query(spark, sf):
    rows = table(spark, sf, "pages").select(netloc("url").alias("url"), F.lit(0).alias("msg_seq"), F.col("page_id").alias("pos"))
    return first_row_per_url(rows).select("url", F.col("pos").alias("page_id"))


@query(
    "shortest_per_key",
    """SELECT lang, source, doc_id, n_chars, pos FROM (
         SELECT lang, source, doc_id, CAST(length(text) AS INT) AS n_chars, min(doc_id) OVER (PARTITION BY lang, source) AS pos,
                row_number() OVER (PARTITION BY lang, source ORDER BY length(text), doc_id) AS r FROM documents) WHERE r = 1""",
)
def shortest_per_key_query(spark, sf):
    rows = table(spark, sf, "documents").select(
        "lang", "source", "doc_id", F.length("text").alias("n_chars"), F.col("doc_id").alias("pos")
    )
    return shortest_per_key(rows, ["lang", "source"], length=F.col("n_chars"))


@query(
    "strategy_fallback",
    """WITH d AS (SELECT doc_id, md5(text) AS msg, CASE lang WHEN 'es' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS strategy FROM documents)
       SELECT doc_id, msg, strategy FROM (SELECT *, min(strategy) OVER (PARTITION BY msg) AS best FROM d) WHERE strategy = best""",
)
def strategy_fallback_query(spark, sf):
    strategy = F.when(F.col("lang") == "es", 1).when(F.col("lang") == "de", 2).otherwise(3)
    rows = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("msg"), strategy.alias("strategy"))
    return strategy_fallback(rows, "msg", spread_by=["doc_id"])


@query(
    "preceding_lines",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
             s AS (SELECT doc_id, pos, {strip_sql("line")} AS line FROM l)
        SELECT doc_id, CAST(pos AS BIGINT) AS pos, line,
               coalesce(lag(line, 1) OVER (PARTITION BY doc_id ORDER BY pos), '') AS title,
               coalesce(lag(line, 2) OVER (PARTITION BY doc_id ORDER BY pos), '') AS company FROM s""",
)
def preceding_lines_query(spark, sf):
    return preceding_lines(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "enrichment_left_join",
    """SELECT d.doc_id, coalesce('quality ' || l.quality || ' toxic ' || l.toxic, '') AS description
       FROM documents d LEFT JOIN labels l ON CASE WHEN d.lang <> 'es' THEN d.doc_id END = l.doc_id""",
)
def enrichment_left_join(spark, sf):
    """Rows of one language have no id to look up."""
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") != "es", F.col("doc_id")).alias("external_id"), F.lit("").alias("description")
    )
    details = table(spark, sf, "labels").select(
        F.col("doc_id").alias("external_id"),
        F.format_string("quality %d toxic %d", "quality", "toxic").alias("detail"),
    )
    return enrich(rows, details, spread_by=["doc_id"]).select("doc_id", "description")


@query(
    "source_union",
    f"""SELECT 'documents' AS source, {_BATCH} AS batch_seq, doc_id AS pos, {FIRST_LINE_SQL} AS title FROM documents
        UNION ALL SELECT 'pages', 35, page_id, {HEADING_SQL} FROM pages""",
)
def source_union(spark, sf):
    documents = batches(spark, sf).select(F.lit("documents").alias("source"), "batch_seq", "pos", first_line().alias("title"))
    pages = table(spark, sf, "pages").select(
        F.lit("pages").alias("source"), F.lit(35).alias("batch_seq"), F.col("page_id").alias("pos"), heading().alias("title")
    )
    return union_sources([documents, pages])


_EVENTS = "SELECT event_id, CAST(user_id AS INT) AS b, event_type AS category, CAST(floor(value) AS INT) AS score FROM events"


@query("lane_counts", "SELECT event_type AS category, count(*) AS rows FROM events GROUP BY event_type")
def lane_counts_query(spark, sf):
    return lane_counts(scored_events(spark, sf))


@query(
    "lane_top10",
    f"""SELECT category, rank, event_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, b, event_id) AS INT) AS rank
        FROM ({_EVENTS})) WHERE rank <= 10""",
)
def lane_top10(spark, sf):
    return top_per_lane(scored_events(spark, sf)).select("category", "rank", F.col("pos").alias("event_id"), "score")


@query("top_scores", f"SELECT event_id, score FROM ({_EVENTS}) ORDER BY score DESC, b, event_id")
def top_scores(spark, sf):
    """O1, the whole order."""
    return by_score(scored_events(spark, sf)).select(F.col("pos").alias("event_id"), "score")


@query(
    "query_slice",
    f"""SELECT category, event_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY b, event_id) AS r FROM ({_EVENTS})) WHERE r <= 50""",
)
def query_slice(spark, sf):
    return first_per_group(scored_events(spark, sf), "category", 50, ["batch_seq", "pos"]).select(
        "category", F.col("pos").alias("event_id")
    )


@query(
    "digest",
    f"""WITH e AS ({_EVENTS}), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, b, event_id) AS rank,
               count(*) OVER (PARTITION BY category) AS lane_rows FROM e WHERE category IN ('purchase', 'signup'))
        SELECT category, CAST(rank AS INT) AS rank, 'e' || event_id AS title, score,
               repeat('●', greatest(least(score, 5), 0)) || repeat('○', greatest(0, 5 - least(score, 5))) AS dots, lane_rows
        FROM k WHERE rank <= 10""",
)
def digest_query(spark, sf):
    rows = scored_events(spark, sf).select(
        "*",
        F.concat(F.lit("e"), F.col("pos").cast("string")).alias("title"),
        *[F.lit("").alias(c) for c in ("url", "company", "salary", "score_reason")],
    )
    return digest(rows, ["purchase", "signup"]).select("category", "rank", "title", "score", "dots", "lane_rows")
