"""Evaluation requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.responses import strict_json

MISSING = "Missing title or company"
INVALID = "Invalid JSON"
FIELDS = ["title", "company", "description", "salary", "url"]


def evaluation_inputs(landed: DataFrame, key: str = "request_id", payload: str = "payload") -> DataFrame:
    """S12. The five fields and a status that is null for an accepted request.

    The body is parsed once and bound; other members are ignored.
    """
    body = landed.withColumn("_v", strict_json(payload))

    def member(name: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", "string").alias(name)

    fields = body.select(key, F.col("_v").isNotNull().alias("_read"), *[member(n) for n in FIELDS])
    given = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("company", F.lit("")) != "")
    status = F.when(~F.col("_read"), F.lit(INVALID)).when(~given, F.lit(MISSING))
    return fields.select(key, *[F.coalesce(n, F.lit("")).alias(n) for n in FIELDS], status.alias("status"))
