"""The incremental run as a stream of micro-batches over landed postings.

A micro-batch is a run: its rows meet the ledger table, are written with the new ledger entries to the
folder of its own stamp and batch number, and a replay of the batch writes the same folder again. The stamps of
runs never go back: a batch of old arrivals takes the stamp of the run before it, so it meets all entries so far.
The work is that of the batch operators, so hot ids are handled as there and the state is a table, pruned by date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.daily import Settings, run_day
from ..sinks.tables import read_runs


def batch_label(batch_id: int) -> str:
    return f"-{batch_id:012d}"


def run_stamp(batch: DataFrame, arrived: str, root: str, batch_id: int) -> dt.datetime | None:
    """The latest arrival of the batch, or the stamp of the runs before it if that is later: the same for every
    replay. Null for an empty batch."""
    earlier = read_runs(batch.sparkSession, root).where(F.substring("run_id", -13, 13) < batch_label(batch_id))
    latest = batch.agg(F.unix_micros(F.max(arrived)).alias("at")).first()["at"]
    before = earlier.agg(F.unix_micros(F.max("updated")).alias("at")).first()["at"]
    if latest is None:
        return None
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=max(latest, before or latest))


def run_stream(
    postings: DataFrame,
    root: str,
    checkpoint: str,
    arrived: str = "landed_at",
    responses: Callable[[DataFrame], DataFrame] | None = None,
    settings: Settings = Settings(),
) -> StreamingQuery:
    """Processes what has arrived since the last call and stops (``availableNow``).

    ``postings``: fetched rows with ``kind`` and an arrival TIMESTAMP.
    """

    def one_run(batch: DataFrame, number: int) -> None:
        stamp = run_stamp(batch, arrived, root, number)
        if stamp is not None:
            run_day(
                batch.sparkSession, root, batch.drop(arrived), stamp, responses=responses, settings=settings,
                label=batch_label(number),
            )

    return (
        postings.writeStream.foreachBatch(one_run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
