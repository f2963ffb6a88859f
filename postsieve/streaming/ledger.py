"""T1 as a stateful stream: admissions of ids whose arrivals carry the stamp of their run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as fixed
from ..shipping import ship_by_value
from .buckets import BUCKETS, bucket_of, free_names, id_text, packed, unpacked

ship_by_value(__name__)

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ADMITTED = pa.schema([("id", pa.string()), ("at", pa.timestamp("us")), ("ends", pa.int64())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keyed state needs the RocksDB provider; the session gets its own setting back afterwards."""
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_PROVIDER)
        else:
            spark.conf.set(STATE_PROVIDER, before)


def first_per_stamp(rows: DataFrame, key: str, stamp: str, order: Sequence[str]) -> DataFrame:
    """Combine step before the stateful shuffle: of rows with one key and one run stamp only the first
    can be admitted, so each Arrow batch passes on one of them and a hot key shrinks on its way."""

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values([key, stamp, *order]).drop_duplicates([key, stamp])

    return rows.mapInPandas(firsts, rows.schema)


class FirstSeen(StatefulProcessor):
    """State per bucket of ids: of each id the stamp of its latest admission and, with ``kept``, when it may go. Memory
    per call: the ids of one bucket, and one row per id and run stamp.

    All arrivals of an id go to one task, thinned to one per stamp and Arrow batch before the shuffle.
    """

    def __init__(self, columns: Sequence[str], key: str, stamp: str, order: Sequence[str], lifetime: dt.timedelta, kept: dt.timedelta | None):
        self.columns, self.key, self.stamp, self.order = list(columns), key, stamp, list(order)
        self.lifetime, self.kept = lifetime, None if kept is None else kept // dt.timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getValueState("admitted", "held BINARY", ttlDurationMs=self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        firsts = None
        for batch in rows:
            pooled = batch if firsts is None else pd.concat([firsts, batch])
            firsts = pooled.sort_values([self.key, self.stamp, *self.order]).drop_duplicates([self.key, self.stamp])
        now = 0 if self.kept is None else timerValues.getCurrentProcessingTimeInMs()
        found = unpacked(self.admitted.get()[0]) if self.admitted.exists() else ()
        held = {name: (last, ends) for name, last, ends in found if ends is None or ends > now}
        ends = None if self.kept is None else now + self.kept
        keep = []
        for name, at in zip(firsts[self.key], firsts[self.stamp], strict=True):
            at = None if at is pd.NaT else at
            last = held[name][0] if name in held else None
            fresh = name not in held or at is not None and last is not None and at - last >= self.lifetime
            keep.append(fresh)
            if fresh:
                held[name] = (at, ends)
        if any(keep):
            self.admitted.update((packed(ADMITTED, ((name, *row) for name, row in held.items())),))
        yield firsts.loc[keep, self.columns]

    def close(self) -> None:
        pass


def admitted_stream(
    arrivals: DataFrame,
    key: str,
    stamp: str,
    order: Sequence[str],
    lifetime: dt.timedelta = dt.timedelta(days=fixed.LEDGER_DAYS),
    lateness: dt.timedelta | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """T1 on a stream. ``stamp`` (TIMESTAMP) is the run an arrival belongs to.

    Arrivals meet the rule in the order of their micro-batches and, inside one, of their stamps; there is no
    watermark, so neither late rows nor rows with the newest stamp so far are dropped. An arrival that is older
    than the id's latest admission finds the id active. The state is one stamp per id, in ``buckets`` buckets: a micro-batch
    reads and writes those it has rows for, and a task holds one, so some ten thousand ids of a bucket are well held. The number
    of buckets must stay the same for a checkpoint. For a query that never stops,
    ``lateness`` lets the state of an id go when it has not been admitted for the lifetime and so much more of
    processing time; a query that stops when it has caught up must not set it, since expiry keeps it running.

    Start the query inside ``rocksdb_state``.
    """
    name, bucket = free_names(arrivals, "id_text", "bucket")
    slim = first_per_stamp(arrivals.withColumn(name, id_text(key)), name, stamp, order)
    kept = None if lateness is None else lifetime + lateness
    return slim.withColumn(bucket, bucket_of(name, buckets)).groupBy(bucket).transformWithStateInPandas(
        statefulProcessor=FirstSeen(arrivals.columns, name, stamp, order, lifetime, kept),
        outputStructType=arrivals.schema,
        outputMode="Append",
        timeMode="None" if kept is None else "ProcessingTime",
    )
