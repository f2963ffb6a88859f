"""Landed payloads: one row per response, as files of a folder or as a table.

A row is ``source, batch_seq, payload_seq, payload``. ``payload_seq`` numbers the responses of a batch,
so the arrival position of a posting is data: response number and index within the response. At scale
the landed table is parquet; the folder of raw files is for collectors that write one file per response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.responses import strict_json
from ..schemas import LANDED


def read_landed_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files under ``source=<s>/batch_seq=<n>/payload_seq=<m>/``; the names become columns, so a
    filter on them prunes the listing."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("source").cast("string").alias("source"),
        F.col("batch_seq").cast("int").alias("batch_seq"),
        F.col("payload_seq").cast("long").alias("payload_seq"),
        F.col("value").alias("payload"),
    )


def read_landed_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED).parquet(path)


INDEX_BITS = 20


def position(index: Column, payload_seq: str = "payload_seq") -> Column:
    """Arrival position within the batch: the response's number, up to 2^43 (epoch milliseconds fit), before the
    index within the response, up to 2^20. Numbers that do not fit are an error, since positions that collide would
    multiply rows."""
    number, place = F.col(payload_seq).cast("long"), index.cast("long")
    fits = (number >= 0) & (number < 1 << 63 - INDEX_BITS) & (place >= 0) & (place < 1 << INDEX_BITS)
    packed = F.shiftleft(number, INDEX_BITS) + place
    wrong = F.raise_error(F.concat(F.lit("no position for response "), number.cast("string"), F.lit(", index "), place.cast("string")))
    return F.when(fits | number.isNull() | place.isNull(), packed).otherwise(wrong.cast("long")).alias("pos")


def json_payload(schema: str) -> Column:
    return F.from_json("payload", schema, {"mode": "PERMISSIVE"})


def rejected_payloads(landed: DataFrame) -> DataFrame:
    """JSON responses that cannot be read at all. They are set apart; no other row is lost with them."""
    return landed.where(strict_json("payload").isNull())


def posting(source: str, **fields: Column) -> list[Column]:
    """The seven text columns of a posting, in order; missing ones are empty."""
    values = {name: F.coalesce(c.cast(T.StringType()), F.lit("")) for name, c in fields.items()}
    names = ["title", "company", "url", "description", "salary"]
    columns = [values.get(n, F.lit("")).alias(n) for n in names]
    return [*columns, F.lit(source).alias("source"), values.get("posted", F.lit("")).alias("posted")]
