"""The expiring first-seen ledger: T1, J2, K2 rows, A4, S11.

An id is active while its stamp is younger than the lifetime; a stamp exactly as old as the lifetime
is expired. A repeat while active does not refresh the stamp; after expiry the id is admitted again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions.stamps import instant, stamp_like, utc
from ..schemas import ORDER
from ..session import cut_lineage, stage
from .dedup import first_row_per_key
from .skew import HOT_ROWS, hot_keys, spread_join


def active_ledger(
    ledger: DataFrame, run_ts: dt.datetime, lifetime_days: int = fixed.LEDGER_DAYS
) -> DataFrame:
    """Entries that are active at the run. The date test prunes the partitions of a stored ledger."""
    cutoff = utc(run_ts) - dt.timedelta(days=lifetime_days)
    live = ledger.where(F.col("first_seen") > stamp_like(ledger, "first_seen", cutoff))
    if "first_seen_date" in ledger.columns:
        live = live.where(F.col("first_seen_date") >= F.lit(cutoff.date()))
    return live


def not_in_ledger(
    rows: DataFrame,
    active: DataFrame,
    key: str = "id",
    spread_by: Sequence[str] = tuple(ORDER),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """J2 on rows that may repeat their id any number of times."""
    hot = hot_keys(rows, [key], hot_rows)
    return spread_join(rows, active.select(key).distinct(), [key], "left_anti", spread_by, hot)


def admit(
    postings: DataFrame,
    ledger: DataFrame,
    run_ts: dt.datetime,
    lifetime_days: int = fixed.LEDGER_DAYS,
    key: str = "id",
    order: Sequence[str] = tuple(ORDER),
    buckets: int | None = None,
) -> DataFrame:
    """W2 then J2: the first row of each id that is not active, stamped with the run.

    The rows are unique by id before they meet the ledger, so the anti-join has no hot key and takes
    over the partitioning of the first step. ``buckets``: the ledger lies in so many buckets of its id. Where the first step
    left another number of partitions, the run's rows are dealt out once more, so that Spark does not shuffle the ledger to suit
    them.
    """
    fresh = first_row_per_key(postings, key, order)
    if buckets is not None and int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions")) != buckets:
        fresh = fresh.repartition(buckets, key)
    known = active_ledger(ledger, run_ts, lifetime_days).select(key)
    return fresh.join(known, key, "left_anti").withColumn("added", instant(run_ts))


def ledger_entries(admitted: DataFrame, run_ts: dt.datetime, key: str = "id") -> DataFrame:
    """K2. The entries a run adds: all newly met ids, also those a low score drops later."""
    return admitted.select(
        key, instant(run_ts).alias("first_seen"), F.lit(utc(run_ts).date()).alias("first_seen_date")
    )


def ledger_after(active: DataFrame, entries: DataFrame) -> DataFrame:
    """K2. The ledger as the next run finds it."""
    return active.unionByName(entries)


def ledger_stats(ledger: DataFrame, cutoff: Column, first_seen: str = "first_seen") -> DataFrame:
    """A4. Entries loaded, expired and active."""
    stale = F.col(first_seen) <= cutoff
    return ledger.agg(
        F.count("*").alias("loaded"), F.count_if(stale).alias("expired"), F.count_if(~stale).alias("active")
    )


def legacy_ledger(payloads: DataFrame, run_ts: dt.datetime, payload: str = "payload") -> DataFrame:
    """S11. A JSON list of ids, each stamped with the run; a JSON object of id and stamp as it is."""
    raw = F.trim(F.col(payload))
    ids = (
        payloads.where(raw.startswith("["))
        .select(F.explode(F.from_json(payload, "array<string>")).alias("id"))
        .distinct()
        .withColumn("first_seen", instant(run_ts))
    )
    stamped = payloads.where(raw.startswith("{")).select(
        F.explode(F.from_json(payload, "map<string,string>")).alias("id", "stamp")
    )
    dated = stamped.select("id", F.col("stamp").cast("timestamp").alias("first_seen"))
    return ids.unionByName(dated).withColumn("first_seen_date", F.to_date("first_seen"))


def admitted_over_history(
    arrivals: DataFrame,
    key: str,
    ts: str,
    lifetime: dt.timedelta,
    start: dt.datetime | None,
    end: dt.datetime | None,
    spread_by: Sequence[str],
    hot_rows: int = HOT_ROWS,
    checkpoint: bool = True,
) -> DataFrame:
    """T1 over a whole history: every (key, time) the rule admits, at the full resolution of ``ts``.

    Two admissions of a key lie at least one lifetime apart, so a slice of the history that is one
    lifetime long admits a key at most once: at its first arrival that is not younger than the key's
    admission in the slice before plus the lifetime. (Earlier admissions have expired when the slice
    begins.) Each slice is a filtered read, a join with the previous slice's admissions and a
    minimum; no list of arrivals is ever collected. The slim rows are written once, in a folder for each
    slice, of which a slice reads its own. The keys' admissions of a slice are checkpointed, so the plan
    stays flat however long the history is. ``end`` is exclusive; a history without bounds is empty.
    """
    if start is None or end is None:
        return arrivals.select(key, ts).limit(0)
    span = F.expr(f"INTERVAL '{lifetime // dt.timedelta(microseconds=1) / 1e6:.6f}' SECOND")
    slim = arrivals.select(key, ts, *[c for c in spread_by if c not in (key, ts)])
    begin, end = utc(start), utc(end)
    slim = slim.where((F.col(ts) >= stamp_like(slim, ts, begin)) & (F.col(ts) < stamp_like(slim, ts, end)))
    micros, first = F.unix_micros(F.col(ts).cast("timestamp")), F.unix_micros(instant(begin))
    number = F.floor((micros - first) / F.lit(lifetime // dt.timedelta(microseconds=1))).cast("int")
    if checkpoint:
        slim = stage(slim.withColumn("_slice", number), partition_by=["_slice"])
    else:
        slim = slim.withColumn("_slice", number)
    hot = hot_keys(slim, [key], hot_rows)
    if checkpoint:
        hot = cut_lineage(hot)
    slices: list[DataFrame] = []
    while begin < end:
        until = min(begin + lifetime, end)
        part = slim.where(F.col("_slice") == len(slices)).drop("_slice")
        if slices:
            before = slices[-1].select(key, F.col(ts).alias("_before"))
            part = spread_join(part, before, [key], "left", spread_by, hot).where(
                F.col("_before").isNull() | (F.col(ts) >= F.col("_before") + span)
            )
        first = part.groupBy(key).agg(F.min(ts).alias(ts))
        slices.append(cut_lineage(first) if checkpoint else first)
        begin = until
    if not slices:
        return arrivals.select(key, ts).limit(0)
    return reduce(DataFrame.unionByName, slices)
