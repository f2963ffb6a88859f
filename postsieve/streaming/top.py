"""W5, O2, T3 as running state: the best rows of each group so far, kept as bounded lists.

A micro-batch brings rows, the state holds the best ``k`` of each group, and the two together give the best ``k`` of
now: rows that were read before are never read again, and neither is the store. The digest's top ten is a group per
lane, the newest rows of the store are one group.

Order: columns of whole numbers, dates or timestamps, each rising or (``"-column"``) falling, nulls first where rising and
last where falling, as ``ORDER BY`` has them; a null counts as the smallest of all 64-bit numbers. Rows
that tie in all of them go by their JSON text, so the lists do not depend on the order of arrival. Repeated rows are rows
of their own. A null group is a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship_by_value
from ..sources.state import read_or_empty

ship_by_value(__name__)

HELD_ROWS = 100_000
_GROUP, _ROW, _RANK = "group_json", "row_json", "row_rank"  # state rows are named tuples: no name begins with _
# JSON text that gives back every microsecond.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def rising(rows: DataFrame, name: str) -> Column:
    """An order column as a number that is never null and rises in the order asked for."""
    falling, name = name.startswith("-"), name.removeprefix("-")
    kind, value = rows.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        value = value.cast("timestamp")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(value)
    elif isinstance(kind, T.DateType):
        value = F.unix_date(value).cast("long")
    elif isinstance(kind, T.IntegralType):
        value = value.cast("long")
    else:
        raise ValueError(f"order column {name} is neither a whole number nor a date nor a timestamp")
    value = F.coalesce(value, F.lit(-(2**63)))
    return F.bitwise_not(value) if falling else value


def best_of(rows: pd.DataFrame, order: list[str], k: int) -> pd.DataFrame:
    """The first ``k`` rows of each group."""
    return rows.sort_values(order, kind="stable").groupby(_GROUP, dropna=False, sort=False).head(k)


def thinned(rows: DataFrame, order: list[str], k: int, held_rows: int = HELD_ROWS) -> DataFrame:
    """Combine step before the stateful shuffle: a task passes on ``k`` rows of each group, so that a hot lane, or the one group
    of the store, shrinks on its way. A task that has more groups than it may hold passes on what it has and begins anew."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = best_of(batch if held is None else pd.concat([held, batch]), order, k)
            if len(held) >= held_rows:
                yield held
                held = None
        if held is not None:
            yield held

    return rows.mapInPandas(run, rows.schema)


class BestRows(StatefulProcessor):
    """State per group: its best ``k`` rows, in order. Memory per call: twice that and one Arrow batch."""

    def __init__(self, order: list[str], k: int):
        self.order, self.k = order, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getListState("best", ", ".join([*(f"{c} LONG" for c in self.order[:-1]), f"{_ROW} STRING"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(row) for row in self.best.get()] if self.best.exists() else []
        held = pd.DataFrame(before, columns=self.order).assign(**{_GROUP: 0}) if before else None
        for batch in rows:
            new = batch[self.order].assign(**{_GROUP: 0})
            held = best_of(new if held is None else pd.concat([held, new]), self.order, self.k)
        after = [(*map(int, row[:-1]), row[-1]) for row in held[self.order].itertuples(index=False, name=None)]
        if after == before:
            return
        self.best.put(after)
        yield pd.DataFrame(
            {_GROUP: pd.Series([key[0]] * len(after), dtype=object), _RANK: range(1, len(after) + 1), _ROW: [row[-1] for row in after]}
        )

    def close(self) -> None:
        pass


def top_stream(rows: DataFrame, group: str | None, order: Sequence[str], k: int) -> DataFrame:
    """The lists that a micro-batch has changed, whole: ``group_json``, ``row_rank`` and ``row_json``. ``group``
    is a column, or None for one group of all rows. ``land`` writes them down.

    State and output of a group are bounded by ``k`` rows. A group that no row of the micro-batch enters gives nothing.

    Start the query inside ``rocksdb_state``.
    """
    names = [f"o{i}" for i in range(len(order))]
    key = F.lit("{}") if group is None else F.to_json(F.struct(F.col(group)), _JSON)
    slim = rows.select(key.alias(_GROUP), *[rising(rows, c).alias(n) for n, c in zip(names, order, strict=True)], F.to_json(F.struct("*"), _JSON).alias(_ROW))
    by = [*names, _ROW]
    return thinned(slim, by, k).groupBy(_GROUP).transformWithStateInPandas(
        statefulProcessor=BestRows(by, k),
        outputStructType=f"{_GROUP} string, {_RANK} int, {_ROW} string",
        outputMode="Update",
        timeMode="None",
    )


def land(lists: DataFrame, folder: str, checkpoint: str):
    """Starts the stream of lists until it has caught up. Each micro-batch writes the lists it has changed to a folder of its own, and one that
    is repeated after a failure replaces it."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    stream = lists.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return stream.foreachBatch(write).start()


def landed_batches(spark: SparkSession, folder: str) -> int:
    """The number of the last micro-batch that has landed, -1 before the first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return -1
    names = [status.getPath().getName() for status in files.listStatus(root)]
    return max((int(name.removeprefix("batch=")) for name in names if name.startswith("batch=")), default=-1)


def landed_tops(spark: SparkSession, folder: str, schema: T.StructType, upto: int | None = None, rank: str = "rank") -> DataFrame:
    """The lists after the micro-batch ``upto`` (or the last one), a row with its ``rank`` in its group each: of every group the list
    that was written last. A column of the rows that is called ``rank`` is replaced. Empty where nothing has landed yet."""
    written = T.StructType.fromDDL(f"{_GROUP} string, {_RANK} int, {_ROW} string, batch int")
    lists = read_or_empty(spark, folder, written)
    if upto is not None:
        lists = lists.where(F.col("batch") <= upto)
    newest = Window.partitionBy(_GROUP).orderBy(F.desc("batch"))
    last = lists.withColumn("_nth", F.rank().over(newest)).where("_nth = 1")
    rows = last.select(F.from_json(_ROW, schema, _JSON).alias("_r"), F.col(_RANK).alias("_place"))
    return rows.select(*[F.col(f"_r.`{c}`") for c in schema.names if c != rank], F.col("_place").alias(rank))
