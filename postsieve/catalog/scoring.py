"""P12-P14, P19, P20, S12, X1-X3 as queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from ..functions.responses import parsed_response
from ..operators.scoring import apply_responses, request_block, request_text, score_with
from ..shipping import ship_by_value
from ..plans.evaluate import answers, prompts
from ..session import new_folder
from ..streaming.answers import answered_stream
from ..streaming.ledger import rocksdb_state
from .base import FIRST_LINE_SQL, first_line, query, strip_sql, table

ship_by_value(__name__)

_K_SQL = r"CAST(regexp_extract(props, '(\d+)', 1) AS INT)"


def response(value: Column, k: Column, lane: Column, reason: Column) -> Column:
    """Response texts of all the kinds the coercion tells apart, by ranges of ``value``."""

    def answer(*parts) -> Column:
        return F.concat(F.lit("Answer:\n{"), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("}\n."))

    return (
        F.when(value < 2, F.lit("no object here"))
        .when(value < 4, answer('"score": "', k, '"'))
        .when(value < 6, answer('"score": "', k, '.5", "category": "CORE"'))
        .when(value < 8, answer('"score": null'))
        .when(value < 10, answer('"category": "', lane, '"'))
        .when(value < 12, answer('"score": true, "reason": 5'))
        .when(value < 14, answer('"score": ', k, '.9, "category": "x", "reason": 5'))
        .when(value < 16, answer('"score": ', k, ', "category": null'))
        .when(value < 18, answer('"score": ', k, ', "category": "'))
        .otherwise(answer('"score": ', k, ', "category": "', lane, '", "reason": "', reason, '"'))
    )


_OUTCOME_SQL = f"""
    CASE WHEN value < 2 THEN 3 WHEN value < 4 THEN {_K_SQL} WHEN value < 10 THEN 3 WHEN value < 12 THEN 1
         WHEN value < 14 THEN CASE WHEN {_K_SQL} >= 4 THEN 3 ELSE {_K_SQL} END WHEN value < 18 THEN 3 ELSE {_K_SQL} END AS score,
    CASE WHEN value < 8 THEN 'ADJACENT' WHEN value < 10 THEN upper(event_type) WHEN value < 12 THEN 'ADJACENT'
         WHEN value < 14 THEN CASE WHEN {_K_SQL} >= 4 THEN 'ADJACENT' ELSE 'X' END
         WHEN value < 18 THEN 'ADJACENT' ELSE upper(event_type) END AS category,
    CASE WHEN value < 2 THEN NULL WHEN value < 4 THEN '' WHEN value < 8 THEN NULL WHEN value < 10 THEN ''
         WHEN value < 14 THEN '5' WHEN value < 18 THEN NULL ELSE 'r' || user_id END AS score_reason,
    CASE WHEN value < 2 THEN 'fallback' WHEN value < 4 THEN 'claude' WHEN value < 8 THEN 'fallback' WHEN value < 12 THEN 'claude'
         WHEN value < 14 AND {_K_SQL} < 4 THEN 'claude' WHEN value < 18 THEN 'fallback' ELSE 'claude' END AS score_method"""


def _responses(spark, sf):
    number = F.regexp_extract("props", r"(\d+)", 1)
    reason = F.concat(F.lit("r"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").withColumn("text", response(F.col("value"), number, F.col("event_type"), reason))


@query("response_json_score", f"SELECT event_id, {_OUTCOME_SQL} FROM events")
def response_json_score(spark, sf):
    return _responses(spark, sf).select("event_id", parsed_response("text").alias("r")).select("event_id", "r.*")


@query(
    "scored_postings",
    f"""SELECT event_id AS id, {_OUTCOME_SQL} FROM events WHERE event_type <> 'error'
        UNION ALL SELECT event_id, 3, 'ADJACENT', NULL, 'fallback' FROM events WHERE event_type = 'error'""",
)
def scored_postings(spark, sf):
    """A join with the response table; one lane never got responses."""
    told = _responses(spark, sf).where("event_type <> 'error'").select(F.col("event_id").alias("id"), "text")
    return apply_responses(table(spark, sf, "events").select(F.col("event_id").alias("id")), told)


@query("scorer_fallback", "SELECT event_id AS id, 3 AS score, 'ADJACENT' AS category, 'fallback' AS score_method FROM events")
def scorer_fallback(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return apply_responses(rows, None).drop("score_reason")


def _strict_scorer(requests):
    """Answers by the title's length; raises on a batch with a title of more than 40 characters."""
    titles = requests.str.extract(r"Title: ([^\n]*)", expand=False)
    if (titles.str.len() > 40).any():
        raise ValueError("a title is too long")
    return titles.str.len().map(lambda n: f'{{"score": {n % 6}, "category": "CORE", "reason": "ok"}}')


@query(
    "scorer_function",
    f"""WITH t AS (SELECT doc_id AS id, length({FIRST_LINE_SQL}) AS n FROM documents)
        SELECT id, CASE WHEN n > 40 THEN 3 ELSE CAST(n % 6 AS INT) END AS score, CASE WHEN n > 40 THEN 'ADJACENT' ELSE 'CORE' END AS category,
               CASE WHEN n > 40 THEN 'fallback' ELSE 'claude' END AS score_method FROM t""",
)
def scorer_function(spark, sf):
    """A function of the caller that raises for some rows; only these get the fallback."""
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), first_line().alias("title"), F.col("source").alias("company"), F.lit("").alias("salary"),
        F.col("text").alias("description"),
    )
    return score_with(rows, _strict_scorer).select("id", "score", "category", "score_method")


_PATIENCE = 48


@query(
    "late_answers",
    f"""WITH a AS (SELECT event_id AS id, date_trunc('hour', ts) AS asked,
                     CASE WHEN event_type <> 'error' THEN date_trunc('hour', ts) + CAST(floor(value) AS INT) * INTERVAL 1 HOUR END AS told,
                     {_OUTCOME_SQL} FROM events),
             w AS (SELECT max(greatest(asked, told)) AS seen FROM a)
        SELECT id, CAST(strftime(asked, '%d') AS INT) AS day, score, category, score_reason, score_method FROM a
        WHERE told <= asked + INTERVAL {_PATIENCE} HOUR
        UNION ALL
        SELECT id, CAST(strftime(asked, '%d') AS INT), 3, 'ADJACENT', NULL, 'fallback' FROM a, w
        WHERE coalesce(told > asked + INTERVAL {_PATIENCE} HOUR, true) AND asked + INTERVAL {_PATIENCE} HOUR <= seen""",
)
def late_answers(spark, sf):
    """X1, X2 as a stream that is started after each ten days of requests and answers have landed. Answers land some hours
    or days after their requests, those of one lane never."""
    out = new_folder(spark, "late_answers")
    rows = _responses(spark, sf).select(
        F.col("event_id").alias("id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("asked"), "value", "event_type", "text"
    )
    asked = rows.select("id", F.col("asked").alias("at"))
    told = rows.where("event_type <> 'error'").select(
        "id", F.timestamp_add("HOUR", F.floor("value").cast("int"), "asked").alias("at"), "text"
    )
    first, last = asked.select("at").unionByName(told.select("at")).agg(F.min("at"), F.max("at")).first()
    for days in range(0, (last - first).days + 1, 10):
        landed = F.col("at").between(F.lit(first + dt.timedelta(days=days)), F.lit(first + dt.timedelta(days=days + 10, microseconds=-1)))
        asked.where(landed).write.mode("append").parquet(f"{out}/asked")
        told.where(landed).write.mode("append").parquet(f"{out}/told")
        requests = spark.readStream.schema(asked.schema).parquet(f"{out}/asked")
        answered = spark.readStream.schema(told.schema).parquet(f"{out}/told")
        with rocksdb_state(spark):
            stream = (
                answered_stream(requests, answered, dt.timedelta(hours=_PATIENCE))
                .writeStream.option("checkpointLocation", f"{out}/checkpoint")
                .trigger(availableNow=True)
                .format("parquet")
                .start(f"{out}/outcomes")
            )
            stream.awaitTermination()
    given = spark.read.parquet(f"{out}/outcomes")
    return given.join(asked, "id").select("id", F.dayofmonth("at").alias("day"), "score", "category", "score_reason", "score_method")


def _fields(spark, sf):
    """Documents with the url of the page of the same number as request fields."""
    urls = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return table(spark, sf, "documents").join(urls, "doc_id", "left").select(
        "doc_id",
        first_line().alias("title"),
        F.col("source").alias("company"),
        F.when(F.col("lang") == "de", F.concat(F.lit("$"), F.col("n_chars").cast("string"))).alias("salary"),
        F.col("url"),
        F.when(F.col("source") != "src2", F.col("text")).alias("description"),
    )


_FIELDS_SQL = f"""WITH f AS (SELECT d.doc_id, {FIRST_LINE_SQL} AS title, d.source AS company,
    CASE WHEN d.lang = 'de' THEN '$' || d.n_chars ELSE '' END AS salary, coalesce(p.url, '') AS url,
    CASE WHEN d.source <> 'src2' THEN d.text ELSE '' END AS description
    FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"""

_BLOCK_SQL = """concat_ws(chr(10), 'Title: ' || title, 'Company: ' || company,
    CASE WHEN salary <> '' THEN 'Salary: ' || salary END, CASE WHEN url <> '' THEN 'URL: ' || url END,
    CASE WHEN description <> '' THEN chr(10) || 'Description:' || chr(10) || substr(description, 1, 1200) END)"""


@query("request_block", f"{_FIELDS_SQL} SELECT doc_id, {_BLOCK_SQL} AS block FROM f")
def request_block_query(spark, sf):
    return _fields(spark, sf).select("doc_id", request_block().alias("block"))


@query(
    "scoring_request",
    f"""{_FIELDS_SQL} SELECT doc_id, CASE WHEN {strip_sql("description")} <> ''
        THEN 'Rate.' || chr(10) || chr(10) || 'JOB:' || chr(10) || 'Title: ' || title || chr(10) || 'Company: ' || company || chr(10)
             || 'Salary: ' || salary || chr(10) || 'Description: ' || substr(description, 1, 1500)
        ELSE 'Rate the title.' || chr(10) || chr(10) || 'JOB:' || chr(10) || 'Title: ' || title || chr(10) || 'Company: ' || company
             || chr(10) || chr(10) || 'JSON only.' END AS request FROM f""",
)
def scoring_request(spark, sf):
    return _fields(spark, sf).select("doc_id", request_text("Rate.", "Rate the title.", "JSON only.").alias("request"))


def _landed_requests(spark, sf):
    """Request bodies; those of one language are cut off and so no JSON, those of one source lack the company."""
    body = F.to_json(
        F.struct(
            first_line().alias("title"),
            F.when(F.col("source") != "src3", F.col("source")).alias("company"),
            F.col("text").alias("description"),
            F.lit("extra").alias("other"),
        )
    )
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.when(F.col("lang") == "es", F.substring(body, 1, 9)).otherwise(body).alias("payload"),
    )


_STATUS_SQL = f"""CASE WHEN lang = 'es' THEN 'Invalid JSON' WHEN source = 'src3' OR {FIRST_LINE_SQL} = '' THEN 'Missing title or company' END"""


@query(
    "evaluation_requests",
    f"""SELECT doc_id AS request_id, {_STATUS_SQL} AS status,
               CASE WHEN {_STATUS_SQL} IS NULL THEN 'Assess.' || chr(10) || chr(10) || 'JOB TO EVALUATE:' || chr(10) || 'Title: ' || {FIRST_LINE_SQL}
                    || chr(10) || 'Company: ' || source
                    || CASE WHEN text <> '' THEN chr(10) || chr(10) || 'Description:' || chr(10) || substr(text, 1, 1200) ELSE '' END END AS prompt
        FROM documents""",
)
def evaluation_requests_query(spark, sf):
    return prompts(_landed_requests(spark, sf), "Assess.").select("request_id", "status", "prompt")


@query(
    "evaluation",
    f"""WITH s AS (SELECT doc_id, n_chars, lang, coalesce({_STATUS_SQL},
                     CASE WHEN source = 'src4' THEN 'No response' WHEN source = 'src5' THEN 'No JSON in response'
                          WHEN source = 'src6' THEN 'Invalid JSON in response' END) AS error FROM documents)
        SELECT doc_id AS request_id, error, CASE WHEN error IS NULL THEN CAST(n_chars % 11 AS INT) END AS score,
               CASE WHEN error IS NULL THEN 'CORE' END AS category, CASE WHEN error IS NULL THEN lang END AS verdict,
               CASE WHEN error IS NULL THEN 'a,' || lang END AS points, CASE WHEN error IS NULL THEN 0 END AS flags FROM s""",
)
def evaluation(spark, sf):
    answer = F.format_string(
        'Here: {"score": %d, "category": "CORE", "verdict": "%s", "talking_points": ["a", "%s"], "red_flags": []} done',
        F.col("n_chars") % 11, "lang", "lang",
    )
    told = table(spark, sf, "documents").where("source <> 'src4'").select(
        F.col("doc_id").alias("request_id"),
        F.when(F.col("source") == "src5", F.lit("sorry")).when(F.col("source") == "src6", F.lit("{ not json }")).otherwise(answer).alias("text"),
    )
    return answers(_landed_requests(spark, sf), told).select(
        "request_id", "error", "score", "category", "verdict",
        F.when(F.col("talking_points").isNotNull(), F.array_join("talking_points", ",")).alias("points"),
        F.when(F.col("red_flags").isNotNull(), F.size("red_flags")).alias("flags"),
    )
