import datetime as dt

from postsieve.streaming.answers import answered_stream
from postsieve.streaming.buckets import BUCKETS
from postsieve.streaming.ledger import rocksdb_state

START = dt.datetime(2026, 3, 10)
ASKED, TOLD = "id string, at timestamp", "id string, at timestamp, text string"


def hours(n):
    return START + dt.timedelta(hours=n)


def said(score):
    return f'{{"score": {score}, "category": "CORE", "reason": "r"}}'


def outcomes(spark, root, batches, patience=4):
    """Rows (id, score, method) given out after each micro-batch of (requests, answers)."""
    after = []
    for requests, answers in batches:
        spark.createDataFrame([(i, hours(h)) for i, h in requests], ASKED).write.mode("append").parquet(f"{root}/asked")
        spark.createDataFrame([(i, hours(h), t) for i, h, t in answers], TOLD).write.mode("append").parquet(f"{root}/told")
        asked = spark.readStream.schema(ASKED).parquet(f"{root}/asked")
        told = spark.readStream.schema(TOLD).parquet(f"{root}/told")
        with rocksdb_state(spark):
            stream = (
                answered_stream(asked, told, dt.timedelta(hours=patience))
                .writeStream.option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True)
                .format("parquet")
                .start(f"{root}/out")
            )
            stream.awaitTermination()
        rows = spark.read.parquet(f"{root}/out").collect()
        after.append(sorted((r.id, r.score, r.score_method) for r in rows))
    return after


def test_answers_in_later_batches_and_never(spark, tmp_path):
    batches = [
        ([("a", 0), ("b", 0), ("c", 1), ("d", 1)], [("a", 1, said(9)), ("early", 1, said(7))]),
        ([("early", 3)], [("b", 3, said(8)), ("b", 2, said(6)), ("a", 3, said(1))]),
        ([("open", 10)], [("c", 9, said(5)), ("d", 9, None)]),
    ]
    first, second, third = outcomes(spark, str(tmp_path), batches)
    assert first == [("a", 9, "claude")]
    assert second == [("a", 9, "claude"), ("b", 6, "claude"), ("early", 7, "claude")]
    # c was told too late, d without a text and too late; "open" still waits.
    assert third == [("a", 9, "claude"), ("b", 6, "claude"), ("c", 3, "fallback"), ("d", 3, "fallback"), ("early", 7, "claude")]


def test_ties_repeats_and_unreadable_answers(spark, tmp_path):
    batches = [
        ([("tie", 0), ("tie", 0), ("tie", 2), ("bad", 0), ("none", 0)], [("tie", 1, said(8)), ("tie", 1, said(2)), ("bad", 1, "no object"), ("none", 1, None)]),
        ([("again", 3), ("last", 30)], [("again", 3, said(4))]),
    ]
    assert outcomes(spark, str(tmp_path), batches)[-1] == [
        ("again", 4, "claude"), ("bad", 3, "fallback"), ("none", 3, "fallback"), ("tie", 2, "claude"),
    ]


def test_a_wait_that_ends_with_the_watermark(spark, tmp_path):
    batches = [([("x", 0), ("y", 1)], []), ([("z", 4)], []), ([("w", 5)], [])]
    first, second, third = outcomes(spark, str(tmp_path), batches)
    x, y = ("x", 3, "fallback"), ("y", 3, "fallback")
    assert (first, second, third) == ([], [x], [x, y])


def test_empty_inputs(spark, tmp_path):
    assert outcomes(spark, str(tmp_path), [([], []), ([("x", 0)], [])])[-1] == []


def test_state_is_one_value_per_bucket(spark, tmp_path):
    """Ids that are whole numbers beyond those of doubles, with a null: each is a request, and few state rows hold them."""
    root, ids = str(tmp_path), [None, *range(2**60, 2**60 + 4000)]
    spark.createDataFrame([(i, START) for i in ids], "id long, at timestamp").write.parquet(f"{root}/asked")
    spark.createDataFrame([(i, START, said(9)) for i in ids[:3]], "id long, at timestamp, text string").write.parquet(f"{root}/told")
    asked = spark.readStream.schema("id long, at timestamp").parquet(f"{root}/asked")
    told = spark.readStream.schema("id long, at timestamp, text string").parquet(f"{root}/told")
    with rocksdb_state(spark):
        stream = (
            answered_stream(asked, told, dt.timedelta(hours=4))
            .writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
            .format("parquet").start(f"{root}/out")
        )
        stream.awaitTermination()
    assert {(r.id, r.score) for r in spark.read.parquet(f"{root}/out").collect()} == {(i, 9) for i in ids[:3]}
    assert stream.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * BUCKETS  # a value and its timer
