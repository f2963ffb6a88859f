"""P18 and time literals. A run has one stamp, given as a datetime; without a zone it means UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def utc(at: dt.datetime) -> dt.datetime:
    return at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def instant(at: dt.datetime) -> Column:
    """TIMESTAMP literal, whatever the zone of the session or of the driver machine."""
    return F.lit(utc(at).isoformat() + "+00:00").cast("timestamp")


def stamp_like(df: DataFrame, column: str, at: dt.datetime) -> Column:
    """Literal of the type of ``column``, so that a comparison with it needs no cast and is pushed down."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.lit(utc(at).isoformat()).cast("timestamp_ntz")
    return instant(at)


def run_id(at: dt.datetime) -> str:
    return utc(at).strftime("%Y%m%dT%H%M%S%f")
