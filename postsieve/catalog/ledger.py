"""T1, J2, K2, A4, S11 as queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.stamps import stamp_like
from ..operators import ledger as ops
from ..session import new_folder
from ..sinks import tables
from ..sinks.ledger_table import read_entries, write_entries
from ..streaming.ledger import admitted_stream, rocksdb_state
from .base import query, stamp_sql, stamp_text, table

_RUN = dt.datetime(2024, 1, 25)
_LIFETIME = 21
_RUN_SQL = "TIMESTAMP '2024-01-25'"
_CUTOFF_SQL = f"{_RUN_SQL} - INTERVAL {_LIFETIME} DAY"


def _id(column="user_id"):
    return F.concat(F.lit("u"), F.col(column).cast("string"), F.lit("-"), F.col("event_type"))


_ID_SQL = "'u' || user_id || '-' || event_type"


def stored_ledger(spark, sf):
    """The first stamp of each user and event type, among events before the run."""
    rows = table(spark, sf, "events")
    before = rows.where(F.col("ts") < stamp_like(rows, "ts", _RUN))
    return before.groupBy(_id().alias("id")).agg(F.min("ts").alias("first_seen"))


_LEDGER_SQL = f"SELECT {_ID_SQL} AS id, min(ts) AS first_seen FROM events WHERE ts < {_RUN_SQL} GROUP BY 1"


@query(
    "ledger_anti_join",
    f"""WITH l AS ({_LEDGER_SQL})
        SELECT event_id FROM events e WHERE ts >= {_RUN_SQL}
          AND NOT EXISTS (SELECT 1 FROM l WHERE l.id = {_ID_SQL} AND l.first_seen > {_CUTOFF_SQL})""",
)
def ledger_anti_join(spark, sf):
    rows = table(spark, sf, "events")
    arrivals = rows.where(F.col("ts") >= stamp_like(rows, "ts", _RUN)).withColumn("id", _id())
    active = ops.active_ledger(stored_ledger(spark, sf), _RUN, _LIFETIME)
    return ops.not_in_ledger(arrivals, active, spread_by=["event_id"]).select("event_id")


@query(
    "ledger_admission",
    f"""WITH l AS ({_LEDGER_SQL}),
             a AS (SELECT event_id, {_ID_SQL} AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r
                   FROM events WHERE ts >= {_RUN_SQL})
        SELECT id, event_id FROM a WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM l WHERE l.id = a.id AND l.first_seen > {_CUTOFF_SQL})""",
)
def ledger_admission(spark, sf):
    rows = table(spark, sf, "events")
    arrivals = rows.where(F.col("ts") >= stamp_like(rows, "ts", _RUN)).withColumn("id", _id())
    return ops.admit(arrivals, stored_ledger(spark, sf), _RUN, _LIFETIME, order=["event_id"]).select("id", "event_id")


@query(
    "ledger_update",
    f"""WITH l AS ({_LEDGER_SQL})
        SELECT id, {stamp_sql("first_seen")} AS first_seen FROM l WHERE first_seen > {_CUTOFF_SQL}
        UNION ALL
        SELECT id, '2024-01-25 00:00:00.000000' FROM (SELECT DISTINCT {_ID_SQL} AS id FROM events WHERE ts >= {_RUN_SQL}) n
        WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = n.id AND l.first_seen > {_CUTOFF_SQL})""",
)
def ledger_update(spark, sf):
    """K2: active entries and those of the run."""
    rows = table(spark, sf, "events")
    arrivals = rows.where(F.col("ts") >= stamp_like(rows, "ts", _RUN)).withColumn("id", _id())
    stored = stored_ledger(spark, sf)
    entries = ops.ledger_entries(ops.admit(arrivals, stored, _RUN, _LIFETIME, order=["event_id"]), _RUN)
    active = ops.active_ledger(stored, _RUN, _LIFETIME)
    stamped = entries.select("id", F.lit(str(_RUN)).cast("timestamp_ntz").alias("first_seen"))
    return ops.ledger_after(active, stamped).select("id", stamp_text("first_seen").alias("first_seen"))


@query(
    "ledger_stats",
    f"""WITH l AS ({_LEDGER_SQL}) SELECT count(*) AS loaded, count(*) FILTER (WHERE first_seen <= {_CUTOFF_SQL}) AS expired,
               count(*) FILTER (WHERE first_seen > {_CUTOFF_SQL}) AS active FROM l""",
)
def ledger_stats(spark, sf):
    stored = stored_ledger(spark, sf)
    return ops.ledger_stats(stored, stamp_like(stored, "first_seen", _RUN - dt.timedelta(days=_LIFETIME)))


def _legacy_payloads(spark, sf):
    """One landed list of ids per conversation turn."""
    words = F.transform(F.split("text", " "), lambda w: F.substring(F.md5(w), 1, 12))
    return table(spark, sf, "conversations").select(F.to_json(words).alias("payload"))


@query(
    "legacy_ledger",
    """SELECT DISTINCT substr(md5(w), 1, 12) AS id, DATE '2024-01-25' AS first_seen_date
       FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations)""",
)
def legacy_ledger(spark, sf):
    return ops.legacy_ledger(_legacy_payloads(spark, sf), _RUN).select("id", F.lit(_RUN.date()).alias("first_seen_date"))


def _history_sql(days: int) -> str:
    return f"""WITH RECURSIVE a AS (
          SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
          UNION ALL
          SELECT a.user_id, min(e.ts) FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL {days} DAY GROUP BY a.user_id)
        SELECT user_id, {stamp_sql("ts")} AS ts FROM a"""


def _history(spark, sf, days):
    events = table(spark, sf, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    admitted = ops.admitted_over_history(
        events, "user_id", "ts", dt.timedelta(days=days), first, last + dt.timedelta(microseconds=1), ["event_id"]
    )
    return admitted.select("user_id", stamp_text("ts").alias("ts"))


@query("expiring_ledger", _history_sql(7))
def expiring_ledger(spark, sf):
    return _history(spark, sf, 7)


@query("expiring_ledger_21d", _history_sql(21))
def expiring_ledger_21d(spark, sf):
    return _history(spark, sf, 21)


@query(
    "streaming_ledger",
    """WITH RECURSIVE d AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2),
        a AS (SELECT user_id, min(day) AS day FROM d GROUP BY user_id
              UNION ALL
              SELECT a.user_id, min(d.day) FROM a JOIN d ON d.user_id = a.user_id AND d.day >= a.day + INTERVAL 7 DAY GROUP BY a.user_id)
       SELECT d.user_id, d.event_id, strftime(d.day, '%Y-%m-%d') AS day FROM a JOIN d USING (user_id, day)""",
)
def streaming_ledger(spark, sf):
    """T1 with one run per day, as a stream that is started after each ten days of events have landed, in as many files as
    the table has partitions. Its checkpoint carries the state over the micro-batches."""
    out = new_folder(spark, "streams")
    events = table(spark, sf, "events").select("user_id", "event_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("run"))
    first, last = events.agg(F.min("run"), F.max("run")).first()
    for days in range(0, (last - first).days + 1, 10):
        part = events.where((F.col("run") >= F.lit(first + dt.timedelta(days=days))) & (F.col("run") < F.lit(first + dt.timedelta(days=days + 10))))
        part.write.mode("append").parquet(f"{out}/events")
        arrivals = spark.readStream.schema(events.schema).parquet(f"{out}/events")
        with rocksdb_state(spark):
            stream = (
                admitted_stream(arrivals, "user_id", "run", ["event_id"], dt.timedelta(days=7))
                .writeStream.option("checkpointLocation", f"{out}/checkpoint")
                .trigger(availableNow=True)
                .outputMode("append")
                .format("parquet")
                .start(f"{out}/admitted")
            )
            stream.awaitTermination()
    written = spark.read.schema(events.schema).parquet(f"{out}/admitted")
    return written.select("user_id", "event_id", F.date_format("run", "yyyy-MM-dd").alias("day"))


@query(
    "bucketed_ledger",
    f"""WITH e AS (SELECT event_id, {_ID_SQL} AS id, least((CAST(ts AS DATE) - DATE '2024-01-01') // 10, 2) AS n FROM events),
             f AS (SELECT id, n, min(event_id) AS event_id FROM e GROUP BY id, n),
             r0 AS (SELECT * FROM f WHERE n = 0),
             r1 AS (SELECT * FROM f WHERE n = 1 AND id NOT IN (SELECT id FROM r0)),
             r2 AS (SELECT * FROM f WHERE n = 2 AND id NOT IN (SELECT id FROM r1)),
             a AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)
        SELECT id, event_id, strftime(DATE '2024-01-11' + CAST(n AS INT) * 10, '%Y-%m-%d') AS added FROM a""",
)
def bucketed_ledger(spark, sf):
    """J2, K2 with the ledger in buckets of its id: three runs, ten days apart, of which the third finds the entries of the first
    expired."""
    root, buckets = new_folder(spark, "ledgers"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = table(spark, sf, "events").withColumn("id", _id())
    number = F.least(F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 10), F.lit(2))
    for n in range(3):
        run = dt.datetime(2024, 1, 11) + dt.timedelta(days=10 * n)
        known = read_entries(spark, root, run, buckets)
        admitted = ops.admit(events.where(number == n), known, run, 15, order=["event_id"], buckets=buckets)
        admitted = tables.write_run(admitted.select("id", "event_id", "added"), root, "admitted", run)
        write_entries(ops.ledger_entries(admitted, run), root, run, buckets)
    stored = spark.read.schema("id string, event_id long, added timestamp").parquet(f"{root}/admitted")
    return stored.select("id", "event_id", F.date_format("added", "yyyy-MM-dd").alias("added"))
