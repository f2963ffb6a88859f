"""Counts taken in the pass that writes, against counts of the written table."""

from postsieve.operators.report import Counted, CountedFunnel, counted_scores, funnel
from postsieve.session import stage
from pyspark.sql import functions as F

ROWS = [("a", True, False, True), ("a", False, True, False), ("b", False, False, None), ("a", None, None, None), ("b", True, True, True)]
SCHEMA = "source string, kept boolean, restricted boolean, enriched boolean"


def jobs(spark, action):
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        out = action()
        return out, len(set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def both(spark, rows, sources):
    counted = CountedFunnel(spark.createDataFrame(rows, SCHEMA).repartition(3), sources)
    written = stage(counted.rows)
    told, read = jobs(spark, lambda: sorted(map(repr, counted.funnel(written).collect())))
    return told, sorted(map(repr, funnel(written).collect())), read


def test_funnel_without_a_read(spark):
    told, expected, _ = both(spark, ROWS, ["a", "b", "never", "a"])
    assert told == expected and len(told) == 2
    counted = CountedFunnel(spark.createDataFrame(ROWS, SCHEMA), ["a", "b"])
    written = stage(counted.rows)
    frame, ran = jobs(spark, lambda: counted.funnel(written))
    assert ran == 0 and "parquet" not in frame._jdf.queryExecution().executedPlan().toString().lower()


def test_unknown_and_null_sources_are_read(spark):
    told, expected, _ = both(spark, [*ROWS, ("other", True, True, True), (None, True, False, False)], ["a", "b"])
    assert told == expected and len(told) == 4


def test_no_rows_and_no_sources(spark):
    assert both(spark, [], ["a"])[0] == [] == both(spark, [], [])[0]
    told, expected, _ = both(spark, ROWS, [])
    assert told == expected


def test_plain_counts(spark):
    scored = counted_scores(spark.createDataFrame([(3,), (2,), (None,), (9,)], "score int"))
    counted = Counted(scored.rows.withColumn("n", F.lit(1)), rows=F.count("*"))
    assert stage(counted.rows).count() == 4
    assert scored.told()["admitted"] == counted.told()["rows"] == 4
    assert scored.told()["kept"] == 2
