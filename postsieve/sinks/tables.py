"""K1-K4: tables of a run.

Each run writes its own folder, ``<date column>=<date>/run_id=<stamp><label>``, and a replay overwrites that
folder alone, also when it has no rows. Runs with one stamp are told apart by their labels. Readers prune by date.

A run's tables become visible together. ``open_run`` puts down a mark before the first of them is written, and
``close_run`` takes it away after the last: readers leave out the runs that are marked, so a run that ends in
between is as if it had not been, until it is repeated. There are as many marks as runs that are
under way or have been broken off.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..functions.stamps import instant, run_id, utc
from ..schemas import LEDGER, RUN_METADATA, SCORED
from ..sources.state import read_or_empty

RUN_PARTITIONS = [T.StructField("run_date", T.DateType()), T.StructField("run_id", T.StringType())]


def run_folder(root: str, table: str, run_ts: dt.datetime, date_column: str = "run_date", label: str = "") -> str:
    return f"{root}/{table}/{date_column}={utc(run_ts).date()}/run_id={run_id(run_ts)}{label}"


def write_run(
    df: DataFrame, root: str, table: str, run_ts: dt.datetime, date_column: str = "run_date", label: str = ""
) -> DataFrame:
    """Writes the rows of one run and gives them back as read from storage: what follows starts from
    the written table and does not recompute it."""
    path = run_folder(root, table, run_ts, date_column, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_run(spark: SparkSession, root: str, run_ts: dt.datetime, label: str = "") -> None:
    """Hides the run from all readers, also what an earlier try of it has written."""
    name = run_id(run_ts) + label
    marks = spark.createDataFrame([(name,)], "run_id string").coalesce(1)
    marks.write.mode("overwrite").parquet(f"{root}/open_runs/mark={name}")


def close_run(spark: SparkSession, root: str, run_ts: dt.datetime, label: str = "") -> None:
    """Shows the tables of the run: one deletion."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/open_runs/mark={run_id(run_ts)}{label}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, True)


def finished(rows: DataFrame, root: str) -> DataFrame:
    """Rows (with ``run_id``) of runs that are not open."""
    marks = read_or_empty(rows.sparkSession, f"{root}/open_runs", T.StructType([T.StructField("run_id", T.StringType())]))
    return rows.join(marks.select("run_id"), "run_id", "left_anti")


def write_ledger(entries: DataFrame, root: str, run_ts: dt.datetime, label: str = "") -> DataFrame:
    """K2. Written last: a crash before it scores rows again rather than losing them."""
    return write_run(entries.drop("first_seen_date"), root, "ledger", run_ts, "first_seen_date", label)


def read_ledger(spark: SparkSession, root: str, before: dt.datetime, label: str = "") -> DataFrame:
    """Entries of earlier runs, also of those with the same stamp; a replayed run does not meet its own."""
    table = read_or_empty(
        spark, f"{root}/ledger", T.StructType([*LEDGER.fields, T.StructField("run_id", T.StringType())])
    )
    earlier = table.where(
        (F.col("first_seen") <= instant(before))
        & (F.col("first_seen_date") <= F.lit(utc(before).date()))
        & (F.col("run_id") != run_id(before) + label)
    )
    return finished(earlier, root).select(LEDGER.fieldNames())


def write_store(kept: DataFrame, root: str, run_ts: dt.datetime, label: str = "") -> DataFrame:
    """K1. The kept rows of a run."""
    return write_run(kept, root, "store", run_ts, label=label)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    table = read_or_empty(spark, f"{root}/runs", T.StructType([*RUN_METADATA.fields, *RUN_PARTITIONS]))
    return finished(table, root).select(table.columns)


def read_store(
    spark: SparkSession, root: str, upto: dt.datetime, rows: int = fixed.STORE_ROWS, without: str | None = None
) -> DataFrame:
    """The bounded store as it was after the run at ``upto``: newest runs first, at most ``rows`` rows.
    ``without``: the id of a run to leave out.

    The days' sums of the runs table (one row per run) tell how many days back the newest rows reach, so older
    partitions of the store are not read. Only as many days are looked at as the store has rows.
    """
    table = finished(read_or_empty(spark, f"{root}/store", T.StructType([*SCORED.fields, *RUN_PARTITIONS])), root)
    stored = table.where((F.col("added") <= instant(upto)) & (F.col("run_date") <= F.lit(utc(upto).date())))
    runs = read_runs(spark, root).where(F.col("updated") <= instant(upto))
    if without is not None:
        stored, runs = stored.where(F.col("run_id") != without), runs.where(F.col("run_id") != without)
    days = runs.groupBy("run_date").agg(F.sum("new_count").alias("n")).where("n > 0")
    total = 0
    for day in days.orderBy(F.desc("run_date")).limit(rows).collect():  # each day has a row at least
        total += day["n"]
        if total >= rows:
            stored = stored.where(F.col("run_date") >= F.lit(day["run_date"]))
            break
    stored = stored.orderBy(F.desc("added"), "batch_seq", "pos").limit(rows)
    return stored.select(SCORED.fieldNames())


def write_metadata(metadata: DataFrame, root: str, run_ts: dt.datetime, label: str = "") -> DataFrame:
    """K3. One row per run."""
    return write_run(metadata, root, "runs", run_ts, label=label)


def write_digest(digest: DataFrame, root: str, run_ts: dt.datetime, label: str = "") -> DataFrame:
    """K4. At most ten rows per lane, in the order they are shown."""
    return write_run(digest.orderBy("category", "rank"), root, "digest", run_ts, label=label)
