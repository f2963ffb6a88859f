"""Row shapes shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

POSTING_FIELDS = ["title", "company", "url", "description", "salary", "source", "posted"]
ORDER = ["batch_seq", "pos"]

# One landed response: which feed, which batch of the run, which response within the batch.
LANDED = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("batch_seq", T.IntegerType(), False),
        T.StructField("payload_seq", T.LongType(), False),
        T.StructField("payload", T.StringType(), True),
    ]
)

POSTING = T.StructType(
    [T.StructField(name, T.StringType(), False) for name in POSTING_FIELDS]
    + [T.StructField("batch_seq", T.IntegerType(), False), T.StructField("pos", T.LongType(), False)]
)

LEDGER = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("first_seen", T.TimestampType(), False),
        T.StructField("first_seen_date", T.DateType(), False),
    ]
)

SCORED = T.StructType(
    POSTING.fields
    + [
        T.StructField("id", T.StringType(), False),
        T.StructField("added", T.TimestampType(), False),
        T.StructField("score", T.IntegerType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("score_reason", T.StringType(), True),
        T.StructField("score_method", T.StringType(), False),
    ]
)

RUN_METADATA = T.StructType(
    [
        T.StructField("updated", T.TimestampType(), False),
        T.StructField("new_count", T.LongType(), False),
        T.StructField("total_count", T.LongType(), False),
    ]
)

SCORER_RESPONSE = "id STRING, text STRING"

EVALUATION = (
    "score INT, category STRING, verdict STRING, cover_letter_hook STRING, cv_angle STRING, "
    "talking_points ARRAY<STRING>, red_flags ARRAY<STRING>, salary_note STRING"
)

# Feed payloads.
SEARCH_API_PAYLOAD = (
    "results ARRAY<STRUCT<title STRING, company STRUCT<display_name STRING>, redirect_url STRING, "
    "adref STRING, description STRING, salary_min DOUBLE, salary_max DOUBLE, created STRING>>"
)
ARRAY_FEED_PAYLOAD = (
    "ARRAY<STRUCT<position STRING, company STRING, apply_url STRING, url STRING, tags ARRAY<STRING>, "
    "description STRING, salary_min DOUBLE, salary_max DOUBLE>>"
)
CATEGORY_FEED_PAYLOAD = (
    "jobs ARRAY<STRUCT<title STRING, company_name STRING, url STRING, description STRING, salary STRING, "
    "candidate_required_location STRING, publication_date STRING>>"
)
RSS_PAYLOAD = "channel STRUCT<item ARRAY<STRUCT<title STRING, link STRING, description STRING>>>"
PAGED_SEARCH_PAYLOAD = (
    "data ARRAY<STRUCT<job_title STRING, employer_name STRING, job_apply_link STRING, job_url STRING, "
    "job_description STRING, job_min_salary DOUBLE, job_max_salary DOUBLE, job_salary_currency STRING, "
    "job_salary_period STRING, job_posted_at_datetime_utc STRING>>"
)
