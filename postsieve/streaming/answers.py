"""X1, X2 on streams: answers that land later than their requests, twice, before them, or never."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as fixed
from ..functions.responses import parsed_response
from ..shipping import ship_by_value
from .buckets import BUCKETS, bucket_of, id_text, id_value, packed, unpacked

ship_by_value(__name__)

MILLI = dt.timedelta(milliseconds=1)
OPEN = pa.schema([("id", pa.string()), ("asked", pa.int64()), ("told", pa.int64()), ("text", pa.string())])


def first_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Combine step before the stateful shuffle: of the requests, and of the answers, of one id only the first counts,
    so each Arrow batch passes on one of each and a hot id shrinks on its way."""

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values([key, "asks", "ms", "text"]).drop_duplicates([key, "asks"])

    return rows.mapInPandas(firsts, rows.schema)


class OpenRequests(StatefulProcessor):
    """State per bucket of ids: of each open id when it was asked, and its first answer so far. A timer ends the wait
    that ends first. Memory per call: the open ids of one bucket."""

    def __init__(self, patience: dt.timedelta):
        self.patience = patience // MILLI

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "held BINARY, due LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, due = self.load()
        met = {}
        for batch in rows:
            for name, asks, at, said in zip(batch["id"], batch["asks"], batch["ms"], batch["text"], strict=True):
                asked, told, text = held.get(name, (None, None, None))
                if asks:
                    asked = int(at) if asked is None else min(asked, int(at))
                elif told is None or (int(at), said or "") < (told, text or ""):
                    told, text = int(at), said
                held[name] = met[name] = (asked, told, text)
        given = []
        for name, (asked, told, text) in met.items():
            if asked is not None and told is not None and told <= asked + self.patience:
                given.append((name, text))
                del held[name]
        self.save(held, due)
        yield self.outcomes(given)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, due = self.load()
        now = timerValues.getCurrentWatermarkInMs()
        over = [name for name, row in held.items() if self.until(row) <= now]
        given = [(name, None) for name in over if held[name][0] is not None]
        for name in over:
            del held[name]
        self.save(held, None if due == expiredTimerInfo.getExpiryTimeInMs() else due)
        yield self.outcomes(given)

    def until(self, row: tuple) -> int:
        asked, told, _ = row
        return (told if asked is None else asked) + self.patience

    def load(self) -> tuple[dict[str, tuple], int | None]:
        if not self.state.exists():
            return {}, None
        value, due = self.state.get()
        return {name: row for name, *row in unpacked(value)}, due

    def save(self, held: dict[str, tuple], timer: int | None) -> None:
        """``timer``: the one that is set."""
        due = min(map(self.until, held.values()), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if held:
            self.state.update((packed(OPEN, ((name, *row) for name, row in held.items())), due))
        else:
            self.state.clear()

    def outcomes(self, given: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(given, columns=["id", "text"], dtype=object)

    def close(self) -> None:
        pass


def answered_stream(
    requests: DataFrame,
    answers: DataFrame,
    patience: dt.timedelta,
    key: str = "id",
    at: str = "at",
    lateness: dt.timedelta = dt.timedelta(0),
    method: str = fixed.SCORED_METHOD,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per request (``key``, ``at``) one row: the outcome of its first answer (``key``, ``at``, ``text``) if that landed
    no later than ``patience`` after the request, the fallback once the watermark has passed that time.

    Which answer counts is told by the times of landing alone, not by the micro-batches they come in. An answer
    may be read before its request; it waits as long as a request does. Of answers that landed at the same time
    the smallest text counts; an answer without text, or that cannot be read, gives the fallback at once. Further
    answers to an ended request are forgotten after the same wait. An id that is asked again after its end is
    a new request. Rows with a null key are one request. Requests whose time is not over stay open and give no
    row yet.

    The watermark follows both inputs and stays ``lateness`` behind the latest row; a row that is older than the
    watermark is ignored by the stream, so ``lateness`` must cover how far inputs are out of order between
    micro-batches. The state is one row per open id, in ``buckets`` buckets, and no more than two rows per id and Arrow
    batch are shuffled. A task holds a bucket's open ids at once: some ten thousand are well held. The number of buckets
    must stay the same for a checkpoint.

    Start the query inside ``rocksdb_state``.
    """
    asks = requests.select(key, F.lit(True).alias("asks"), F.col(at).alias("at"), F.lit(None).cast("string").alias("text"))
    tells = answers.select(key, F.lit(False).alias("asks"), F.col(at).alias("at"), "text")
    rows = asks.unionByName(tells).select(
        id_text(key).alias("id"), "asks", "at", "text", F.unix_millis(F.col("at").cast("timestamp")).alias("ms")
    )
    rows = first_of_each(rows, "id").withWatermark("at", f"{lateness // MILLI} milliseconds")
    found = rows.withColumn("bucket", bucket_of("id", buckets)).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=OpenRequests(patience),
        outputStructType="id string, text string",
        outputMode="Append",
        timeMode="EventTime",
    )
    given = found.select(id_value("id", requests.schema[key].dataType).alias(key), parsed_response("text", method).alias("_r"))
    return given.select(key, "_r.*")
