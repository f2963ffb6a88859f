"""Keyed state held by buckets of the key: one call of a processor serves all ids of a bucket.

A call costs its worker some milliseconds whatever it is given, so a state per id costs that much per id and micro-batch.
A bucket's ids are one value of state; a micro-batch reads and writes the buckets that it has rows for.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..shipping import ship_by_value

ship_by_value(__name__)

BUCKETS = 1024
# JSON text that gives back every microsecond.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def id_text(key: str) -> Column:
    """A key as text, by which processors tell ids apart whatever the type; null is an id."""
    return F.to_json(F.struct(F.col(key).alias("k")), _JSON)


def id_value(text: Column | str, kind: T.DataType) -> Column:
    return F.from_json(text, T.StructType([T.StructField("k", kind)]), _JSON)["k"]


def bucket_of(text: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int")


def free_names(rows: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``rows`` has."""
    taken = {c.lower() for c in rows.columns}
    while taken & set(names):
        names = tuple(f"{n}_" for n in names)
    return list(names)


def packed(schema: pa.Schema, rows: Iterable[tuple]) -> bytes:
    """Rows as one binary value."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> Iterable[tuple]:
    with pa.ipc.open_stream(value) as found:
        return zip(*(c.to_pylist() for c in found.read_all().columns), strict=True)
