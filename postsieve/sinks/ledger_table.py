"""The ledger laid out for its join, as a bucketed table.

The entries lie in ``buckets`` buckets of their id, in partitions of first-seen date and run. The join with a run's rows reads
a bucket a task, so the ledger, which is many times as large as a run, is never shuffled; only the run's rows are, once and
unique by id. The date prunes what is older than the lifetime.

Data files and one small table, ``ledger_layout``, hold all there is: the table of the session's catalog is declared over
them anew in each session and finds the partitions in the folder. The number of buckets is fixed by the first run, for a
file tells its bucket by that number; a later wish for another one is an error. As a rule it is a multiple of the cluster's cores,
so that a bucket of active ids fits a task: a thousand million ids in 2,000 buckets are 500,000 ids a task.

Each run replaces its own partition, also by nothing. Runs that are open or broken off are left out, as by
``tables.read_ledger``.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.stamps import instant, run_id, utc
from ..schemas import LEDGER
from ..sources.state import read_or_empty
from .tables import finished

MOST_MARKS = 1_000  # so many open runs are left out by a filter on partitions, more of them by a join
_MARKS = T.StructType([T.StructField("run_id", T.StringType())])
_LAYOUT = T.StructType([T.StructField("buckets", T.IntegerType())])


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ledger_buckets(spark: SparkSession, root: str) -> int | None:
    """The number of buckets of the stored ledger, None before its first run."""
    layout = read_or_empty(spark, f"{root}/ledger_layout", _LAYOUT).first()
    return layout.buckets if layout else None


def open_ledger(spark: SparkSession, root: str, buckets: int) -> str:
    """Name of the ledger under ``root`` as a table of this session's catalog; its first call makes the ledger."""
    stored = ledger_buckets(spark, root)
    if stored is None:
        spark.createDataFrame([(buckets,)], _LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger_layout")
    elif stored != buckets:
        raise ValueError(f"the ledger under {root} has {stored} buckets, not {buckets}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/bucketed_ledger")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    name = "ledger_" + hashlib.md5(root.encode(), usedforsecurity=False).hexdigest()
    spark.sql(
        f"""CREATE TABLE IF NOT EXISTS {name} (id STRING, first_seen TIMESTAMP, first_seen_date DATE, run_id STRING)
            USING parquet PARTITIONED BY (first_seen_date, run_id) CLUSTERED BY (id) SORTED BY (id) INTO {int(buckets)} BUCKETS
            LOCATION {_quoted(f"{root}/bucketed_ledger")}"""
    )
    if stored is not None:
        spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    return name


def write_entries(entries: DataFrame, root: str, run_ts: dt.datetime, buckets: int, label: str = "") -> None:
    """K2. The entries of a run (``id``, ``first_seen``) into its own partition, one file per bucket. They come from a written
    table of the run: a plan that still reads the ledger cannot write to it."""
    spark = entries.sparkSession
    name = open_ledger(spark, root, buckets)
    spark.sql(
        f"""INSERT OVERWRITE TABLE {name} PARTITION (first_seen_date = DATE '{utc(run_ts).date()}', run_id = {_quoted(run_id(run_ts) + label)})
            SELECT id, first_seen FROM {{rows}}""",
        rows=entries.select("id", "first_seen").repartition(buckets, "id"),
    )


def read_entries(spark: SparkSession, root: str, before: dt.datetime, buckets: int, label: str = "") -> DataFrame:
    """Entries of earlier runs, in their buckets; a replayed run does not meet its own."""
    table = spark.table(open_ledger(spark, root, buckets))
    earlier = table.where(
        (F.col("first_seen") <= instant(before))
        & (F.col("first_seen_date") <= F.lit(utc(before).date()))
        & (F.col("run_id") != run_id(before) + label)
    )
    marks = read_or_empty(spark, f"{root}/open_runs", _MARKS).limit(MOST_MARKS + 1).collect()
    if len(marks) > MOST_MARKS:
        return finished(earlier, root).select(LEDGER.fieldNames())
    return earlier.where(~F.col("run_id").isin([mark.run_id for mark in marks])).select(LEDGER.fieldNames())
