"""O2, U2, A5, A6 and whole runs as queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.text import content_id, strip, strip_tags, truncate
from ..functions.urls import domain_ok, netloc
from ..operators.policy import Policy, Terms
from ..operators.predicates import has_required
from ..operators.ranking import bounded_store, digest, split_by_score, union_sources
from ..operators.report import admission_stats, run_metadata
from ..operators.scoring import apply_responses
from ..plans.daily import Settings, admitted_rows, judged_rows, pooled_rows, run_day
from ..session import new_folder, stage
from ..sinks import tables
from ..streaming.incremental import run_stream
from ..streaming.ledger import rocksdb_state
from ..streaming.top import land, landed_batches, landed_tops, top_stream
from .base import (
    FIRST_LINE_SQL,
    HEADING_SQL,
    contains_any_sql,
    content_id_sql,
    first_line,
    heading,
    netloc_sql,
    query,
    stamp_text,
    strip_sql,
    table,
    tags_out_sql,
)
from .filters import TERMS, clean_sql, restricted_sql, senior_sql, signal_sql, title_ok_sql

_HALF = "TIMESTAMP '2024-01-16'"


def _store_events(spark, sf):
    """Events as stored postings: the hour is the run, the user the batch."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("batch_seq"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("added"),
        F.floor("value").cast("int").alias("score"), F.col("ts"),
    )


@query(
    "bounded_store",
    "SELECT event_id FROM events WHERE value >= 3 ORDER BY date_trunc('hour', ts) DESC, user_id, event_id LIMIT 300",
)
def bounded_store_query(spark, sf):
    kept, _ = split_by_score(_store_events(spark, sf))
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    return bounded_store(kept.where(F.col("ts") >= half), kept.where(F.col("ts") < half)).select(F.col("pos").alias("event_id"))


@query(
    "run_metadata",
    f"""SELECT '2024-01-31 12:00:00.000000' AS updated, count(*) FILTER (WHERE ts >= {_HALF}) AS new_count,
               least(300, count(*)) AS total_count FROM events WHERE value >= 3""",
)
def run_metadata_query(spark, sf):
    kept, _ = split_by_score(_store_events(spark, sf))
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    new = kept.where(F.col("ts") >= half)
    store = bounded_store(new, kept.where(F.col("ts") < half))
    row = run_metadata(new, store, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"))
    return row.withColumn("updated", stamp_text("updated"))


@query(
    "admission_stats",
    f"""SELECT count(*) AS pooled, count(*) FILTER (WHERE ts >= {_HALF}) AS admitted,
               count(*) FILTER (WHERE ts >= {_HALF} AND value >= 3) AS kept, count(*) FILTER (WHERE ts >= {_HALF} AND value < 3) AS dropped FROM events""",
)
def admission_stats_query(spark, sf):
    rows = _store_events(spark, sf)
    return admission_stats(rows, rows.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")))


# --- the daily run ---------------------------------------------------------------------------------

RUN = dt.datetime(2024, 1, 25, 12)
KINDS = ["mail", "cards", "search_api", "array_feed", "category_feed"]
BLOCKED = ["a1.example", "cheap-pills.example.com", "spam-farm.example.org"]
SETTINGS = Settings(
    policies=[
        Policy("mail"),
        Policy("cards", need_clean=True),
        Policy("search_api", need_clean=True, need_signal=True),
        Policy("array_feed", need_clean=True),
        Policy("category_feed", need_clean=True, need_senior_title=True),
        Policy("rss", need_clean=True, need_senior_title=True),
    ],
    terms=TERMS,
)


def _posting_columns(title, company, url, description, source, batch, pos):
    return [
        title.alias("title"), company.alias("company"), url.alias("url"), description.alias("description"),
        F.lit("").alias("salary"), source.alias("source"), F.lit("").alias("posted"),
        batch.cast("int").alias("batch_seq"), pos.cast("long").alias("pos"),
    ]


def _document_rows(spark, sf):
    """Documents as postings of five feeds, by their source number."""
    number = F.substring("source", 4, 9).cast("int")
    url = F.concat(F.lit("https://www."), F.substring(F.md5("text"), 1, 3), F.lit(".example.com/j"))
    rows = table(spark, sf, "documents").select(
        *_posting_columns(strip(first_line()), F.col("source"), url, F.col("text"), F.col("source"), number, F.col("doc_id")),
        F.get(F.lit(KINDS), number % len(KINDS)).alias("kind"),
    )
    return rows.where(has_required("title", "url") & domain_ok("url", BLOCKED))


def _page_rows(spark, sf):
    url = F.concat(F.lit("https://"), netloc("url"), F.lit("/jobs"))
    rows = table(spark, sf, "pages").select(
        *_posting_columns(
            strip(heading()), netloc("url"), url, truncate(strip_tags("html"), 1200), F.lit("pages"), F.lit(24), F.col("page_id")
        ),
        F.lit("rss").alias("kind"),
    )
    return rows.where(has_required("title", "url") & domain_ok("url", BLOCKED))


def day_rows(spark, sf):
    return union_sources([_document_rows(spark, sf), _page_rows(spark, sf)])


def day_ledger(spark, sf):
    """Labelled documents were seen before: those of good quality recently, the others long ago."""
    seen = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    at = F.when(F.col("quality") == 1, F.lit("2024-01-10 12:00:00+00:00")).otherwise(F.lit("2024-01-04 12:00:00+00:00"))
    return seen.groupBy(content_id(strip(first_line()), "source").alias("id")).agg(F.max(at.cast("timestamp")).alias("first_seen"))


def day_responses(admitted):
    """Responses drawn from the id; some postings got none."""
    digit = F.conv(F.substring("id", 1, 1), 16, 10)
    lane = F.when(F.substring("id", 2, 1) < "8", F.lit("core")).when(F.substring("id", 2, 1) < "e", F.lit("adjacent")).otherwise(F.lit("other"))
    text = F.format_string('{"score": %s, "category": "%s", "reason": "by id"}', digit, lane)
    return admitted.where(F.substring("id", 3, 1) != "0").select("id", text.alias("text"))


def _kind_sql(n: str) -> str:
    return f"CASE {n} % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"


_NUMBER = "CAST(substr(source, 4) AS INT)"
_POOLED_SQL = f"""
    d AS (SELECT {strip_sql(FIRST_LINE_SQL)} AS title, source AS company, 'https://www.' || substr(md5(text), 1, 3) || '.example.com/j' AS url,
                 text AS description, {_NUMBER} AS batch_seq, doc_id AS pos, {_kind_sql(_NUMBER)} AS kind FROM documents
          UNION ALL
          SELECT {strip_sql(HEADING_SQL)}, {netloc_sql("url")}, 'https://' || {netloc_sql("url")} || '/jobs',
                 substr({tags_out_sql("html")}, 1, 1200), 24, page_id, 'rss' FROM pages),
    f AS (SELECT * FROM d WHERE title <> '' AND url <> '' AND NOT {contains_any_sql(netloc_sql("url"), BLOCKED)}
            AND {title_ok_sql("title")} AND NOT {restricted_sql("description")}
            AND (kind = 'mail' OR {clean_sql("title", "description")})
            AND (kind <> 'search_api' OR {signal_sql("title", "description")})
            AND (kind NOT IN ('category_feed', 'rss') OR {senior_sql("title")})),
    w AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY url ORDER BY batch_seq) AS rk FROM f) WHERE rk = 1)"""
_LEDGER_SQL = f"""
    l AS (SELECT {content_id_sql(strip_sql("split_part(d.text, chr(10), 1)"), "d.source")} AS id, max(quality) AS quality
          FROM labels JOIN documents d USING (doc_id) GROUP BY 1)"""
_SCORED_SQL = f"""
    i AS (SELECT *, {content_id_sql("title", "company")} AS id FROM w),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_seq, pos) AS rn FROM i)
          WHERE rn = 1 AND id NOT IN (SELECT id FROM l WHERE quality = 1)),
    s AS (SELECT *, CASE WHEN substr(id, 3, 1) = '0' THEN 3 ELSE CAST('0x' || substr(id, 1, 1) AS INT) END AS score,
                 CASE WHEN substr(id, 3, 1) = '0' THEN 'ADJACENT' WHEN substr(id, 2, 1) < '8' THEN 'CORE'
                      WHEN substr(id, 2, 1) < 'e' THEN 'ADJACENT' ELSE 'OTHER' END AS category FROM a)"""
DAY_SQL = f"WITH {_POOLED_SQL}, {_LEDGER_SQL}, {_SCORED_SQL}"


def _day_admitted(spark, sf):
    verdicts = stage(judged_rows(day_rows(spark, sf), SETTINGS))
    return stage(admitted_rows(verdicts, pooled_rows(verdicts), day_ledger(spark, sf), RUN, SETTINGS))


@query(
    "daily_run",
    f"""{DAY_SQL},
        k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, batch_seq, pos) AS rank,
                     count(*) OVER (PARTITION BY category) AS lane_rows FROM s WHERE score >= 3 AND category IN ('CORE', 'ADJACENT'))
        SELECT category, CAST(rank AS INT) AS rank, title, url, company, repeat('●', least(score, 5)) || repeat('○', 5 - least(score, 5)) AS dots,
               score, lane_rows FROM k WHERE rank <= 10""",
)
def daily_run(spark, sf):
    """The flagship: fetch, policy, url dedup, ids, ledger, responses, digest. Three tables are staged on
    the way: judged rows, admitted rows, scored rows."""
    admitted = _day_admitted(spark, sf)
    kept, _ = split_by_score(stage(apply_responses(admitted, day_responses(admitted))))
    return digest(kept).select("category", "rank", "title", "url", "company", "dots", "score", "lane_rows")


@query("admitted_rows", f"{DAY_SQL} SELECT id, title, company, url, batch_seq, pos, score, category FROM s")
def admitted_rows_query(spark, sf):
    """The scored rows of the day, before the threshold."""
    admitted = _day_admitted(spark, sf)
    scored = apply_responses(admitted, day_responses(admitted))
    return scored.select("id", "title", "company", "url", "batch_seq", "pos", "score", "category")


@query(
    "stored_runs",
    f"""WITH {_POOLED_SQL.replace("WHERE title <> ''", "WHERE kind <> 'rss' AND title <> ''")},
             i AS (SELECT *, {content_id_sql("title", "company")} AS id FROM w),
             a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_seq, pos) AS rn FROM i) WHERE rn = 1),
             s AS (SELECT *, CASE WHEN substr(id, 3, 1) = '0' THEN 3 ELSE CAST('0x' || substr(id, 1, 1) AS INT) END AS score FROM a),
             p AS ({{pages}})
        SELECT added, id, title, score FROM (
            SELECT '2024-01-25' AS added, id, title, score, batch_seq, pos FROM s WHERE score >= 3
            UNION ALL SELECT '2024-01-26', id, title, score, batch_seq, pos FROM p WHERE score >= 3)
        ORDER BY added DESC, batch_seq, pos LIMIT 300""".replace(
        "{pages}",
        f"""SELECT *, CASE WHEN substr(id, 3, 1) = '0' THEN 3 ELSE CAST('0x' || substr(id, 1, 1) AS INT) END AS score FROM (
              SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_seq, pos) AS rn FROM (
                SELECT *, {content_id_sql("title", "company")} AS id FROM (
                  SELECT *, rank() OVER (PARTITION BY url ORDER BY batch_seq) AS rk2 FROM f2) WHERE rk2 = 1))
            WHERE rn = 1 AND id NOT IN (SELECT id FROM a)""",
    ).replace(
        "w AS (SELECT * FROM (SELECT *, rank()",
        "f2 AS (SELECT * FROM d WHERE kind IN ('rss', 'mail') AND title <> '' AND url <> '' AND NOT "
        + contains_any_sql(netloc_sql("url"), BLOCKED)
        + f" AND {title_ok_sql('title')} AND NOT {restricted_sql('description')}"
        + f" AND (kind = 'mail' OR ({clean_sql('title', 'description')} AND {senior_sql('title')}))),\n    w AS (SELECT * FROM (SELECT *, rank()",
    ),
)
def stored_runs(spark, sf):
    """Two runs against tables, the second one meeting the ledger of the first; then the store.

    The second day brings the pages and, again, the mail of the first day."""
    root = new_folder(spark, "runs")
    days = [_document_rows(spark, sf), day_rows(spark, sf).where(F.col("kind").isin("mail", "rss"))]
    for day, rows in enumerate(days):
        run_day(spark, root, rows, RUN + dt.timedelta(days=day), responses=day_responses, settings=SETTINGS)
    store = tables.read_store(spark, root, RUN + dt.timedelta(days=1))
    return store.select(F.date_format("added", "yyyy-MM-dd").alias("added"), "id", "title", "score")


# --- the incremental run ---------------------------------------------------------------------------

_PLAIN = Settings(policies=[], terms=Terms(excluded_titles=[], restricting=[], opening=[]), lifetime_days=7, store_rows=300)
_ARRIVED_SQL = """
    e AS (SELECT event_id, 't' || user_id AS title, CAST(ts AS DATE) AS day, CAST(ts AS DATE) - DATE '2024-01-01' AS n,
                 'https://x.example/' || event_id AS url FROM events),
    f AS (SELECT *, CASE WHEN n // 10 < 3 THEN n // 10 ELSE 2 END AS batch FROM e),
    b AS (SELECT batch, max(day) AS run FROM f GROUP BY batch),
    g AS (SELECT f.*, run, row_number() OVER (PARTITION BY title, batch ORDER BY event_id) AS r FROM f JOIN b USING (batch)),
    h AS (SELECT title, batch, run, event_id, url FROM g WHERE r = 1)"""


def _incremental(spark, sf):
    """Three micro-batches of events as postings; the title names the user, so each user comes back."""
    out = new_folder(spark, "incremental")
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    number = F.least(F.floor(F.datediff("day", F.lit("2024-01-01").cast("date")) / 10), F.lit(2))
    rows = events.select(
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("title"), F.lit("").alias("company"),
        F.concat(F.lit("https://x.example/"), F.col("event_id").cast("string")).alias("url"),
        *[F.lit("").alias(c) for c in ("description", "salary")], F.lit("s").alias("source"), F.lit("").alias("posted"),
        F.lit(1).alias("batch_seq"), F.col("event_id").alias("pos"), F.lit("mail").alias("kind"),
        F.col("day").cast("timestamp").alias("landed_at"), number.alias("n"),
    )
    for batch in range(3):
        part = rows.where(F.col("n") == batch).drop("n")
        part.write.mode("append").parquet(f"{out}/landed")
        landed = spark.readStream.schema(part.schema).parquet(f"{out}/landed")
        run_stream(landed, f"{out}/tables", f"{out}/checkpoint", settings=_PLAIN).awaitTermination()
    return f"{out}/tables"


@query(
    "incremental_runs",
    f"""WITH RECURSIVE {_ARRIVED_SQL},
        a AS (SELECT title, batch, run, event_id FROM h WHERE batch = (SELECT min(batch) FROM h x WHERE x.title = h.title)
              UNION ALL
              SELECT h.title, h.batch, h.run, h.event_id FROM a JOIN h ON h.title = a.title AND h.batch > a.batch
                AND h.run - a.run >= 7 AND h.batch = (SELECT min(y.batch) FROM h y WHERE y.title = a.title AND y.batch > a.batch AND y.run - a.run >= 7))
        SELECT title, event_id, strftime(run, '%Y-%m-%d') AS added FROM a""",
)
def incremental_runs(spark, sf):
    """T2 as a stream of three micro-batches: what each run admitted, given a ledger lifetime of 7 days."""
    store = spark.read.parquet(f"{_incremental(spark, sf)}/admitted")
    return store.select("title", F.col("pos").alias("event_id"), F.date_format("added", "yyyy-MM-dd").alias("added"))


@query(
    "incremental_store",
    f"""WITH RECURSIVE {_ARRIVED_SQL},
        a AS (SELECT title, batch, run, event_id FROM h WHERE batch = (SELECT min(batch) FROM h x WHERE x.title = h.title)
              UNION ALL
              SELECT h.title, h.batch, h.run, h.event_id FROM a JOIN h ON h.title = a.title AND h.batch > a.batch
                AND h.run - a.run >= 7 AND h.batch = (SELECT min(y.batch) FROM h y WHERE y.title = a.title AND y.batch > a.batch AND y.run - a.run >= 7))
        SELECT title, event_id, strftime(run, '%Y-%m-%d') AS added FROM a ORDER BY run DESC, event_id LIMIT 300""",
)
def incremental_store(spark, sf):
    """T3 after the stream: the bounded store, which keeps 300 rows."""
    store = tables.read_store(spark, _incremental(spark, sf), dt.datetime(2100, 1, 1))
    return store.select("title", F.col("pos").alias("event_id"), F.date_format("added", "yyyy-MM-dd").alias("added"))


# --- running lists ---------------------------------------------------------------------------------

_SLICES = "least((CAST(ts AS DATE) - DATE '2024-01-01') // 10, 2)"


def _running(spark, rows, group, order, k):
    """The lists after each of three micro-batches, as ``batch``; ``rows`` have the number of theirs as ``n``."""
    out = new_folder(spark, "running")
    parts, schema = [], rows.drop("n").schema
    for n in range(3):
        rows.where(F.col("n") == n).drop("n").write.mode("append").parquet(f"{out}/landed")
        landed = spark.readStream.schema(schema).parquet(f"{out}/landed")
        with rocksdb_state(spark):
            land(top_stream(landed, group, order, k), f"{out}/lists", f"{out}/checkpoint").awaitTermination()
        last = landed_batches(spark, f"{out}/lists")
        parts.append(landed_tops(spark, f"{out}/lists", schema, upto=last).withColumn("batch", F.lit(n)))
    return union_sources(parts)


def _slice_number():
    days = F.datediff("day", F.lit("2024-01-01").cast("date")).cast("int")
    return F.least(F.floor(days / 10), F.lit(2)).cast("int")


@query(
    "running_lanes",
    f"""WITH e AS (SELECT event_id, CAST(user_id AS INT) AS b, event_type AS category, CAST(floor(value) AS INT) AS score, {_SLICES} AS n FROM events),
             s AS (SELECT CAST(unnest([0, 1, 2]) AS INT) AS batch),
             r AS (SELECT batch, category, event_id, score, CAST(row_number() OVER (PARTITION BY batch, category ORDER BY score DESC, b, event_id) AS INT) AS rank
                   FROM e JOIN s ON n <= batch)
        SELECT batch, category, rank, event_id, score FROM r WHERE rank <= 10""",
)
def running_lanes(spark, sf):
    """W5 as running state: the ten best of each lane after each of three micro-batches."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts")).select(
        F.col("event_id").alias("pos"), F.col("user_id").cast("int").alias("batch_seq"), F.col("event_type").alias("category"),
        F.floor("value").cast("int").alias("score"), _slice_number().alias("n"),
    )
    lists = _running(spark, events, "category", ["-score", "batch_seq", "pos"], 10)
    return lists.select("batch", "category", "rank", F.col("pos").alias("event_id"), "score")


@query(
    "running_store",
    f"""WITH e AS (SELECT event_id, user_id, date_trunc('hour', ts) AS added, {_SLICES} AS n FROM events WHERE floor(value) >= 3),
             s AS (SELECT CAST(unnest([0, 1, 2]) AS INT) AS batch),
             r AS (SELECT batch, event_id, CAST(row_number() OVER (PARTITION BY batch ORDER BY added DESC, user_id, event_id) AS INT) AS rank
                   FROM e JOIN s ON n <= batch)
        SELECT batch, rank, event_id FROM r WHERE rank <= 300""",
)
def running_store(spark, sf):
    """O2, U2, T3 as running state: the newest 300 kept rows after each of three micro-batches."""
    kept, _ = split_by_score(_store_events(spark, sf).withColumn("day", F.to_date("ts")))
    rows = kept.select("pos", "batch_seq", "added", _slice_number().alias("n"))
    lists = _running(spark, rows, None, ["-added", "batch_seq", "pos"], 300)
    return lists.select("batch", "rank", F.col("pos").alias("event_id"))
