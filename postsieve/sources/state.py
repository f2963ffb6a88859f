"""Tables of earlier runs, empty where there was none."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S10. A missing table reads as an empty one. Anything else that goes wrong, a damaged file for
    one, is raised: a ledger that silently starts over would admit everything again."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
