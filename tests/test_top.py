"""Running lists against a sort of all rows so far."""

import datetime as dt
import random

import pytest
from helpers import values
from postsieve.streaming.ledger import rocksdb_state
from postsieve.streaming.top import land, landed_batches, landed_tops, rising, thinned, top_stream
from pyspark.sql import functions as F

SCHEMA = "lane string, score int, at timestamp, seen timestamp_ntz, pos long, rank string"
START = dt.datetime(2026, 3, 1)


def lists(spark, root, batches, group="lane", order=("-score", "pos"), k=3):
    """The lists after each micro-batch, as {group: rows in order}."""
    after = []
    for rows in batches:
        part = values(spark, SCHEMA, rows)
        part.repartition(3).write.mode("append").parquet(f"{root}/landed")
        landed = spark.readStream.schema(part.schema).parquet(f"{root}/landed")
        with rocksdb_state(spark):
            land(top_stream(landed, group, order, k), f"{root}/lists", f"{root}/checkpoint").awaitTermination()
        found = landed_tops(spark, f"{root}/lists", part.schema, landed_batches(spark, f"{root}/lists"))
        by = {}
        for row in sorted(found.collect(), key=lambda r: r["rank"]):
            by.setdefault(row.lane if group else None, []).append((row.score, row.at, row.seen, row.pos))
        after.append(by)
    return after


def row(lane, score, pos):
    micros = dt.timedelta(days=pos or 0, microseconds=7)
    return (lane, score, START + micros, START - micros, pos, "mine")


def best(rows, group, k):
    by = {}
    for lane, score, at, seen, pos, _ in rows:
        by.setdefault(lane if group else None, []).append((score, at, seen, pos))
    low = -(2**63)

    def key(r):
        return (-(low if r[0] is None else r[0]), low if r[3] is None else r[3])

    return {lane: sorted(found, key=key)[:k] for lane, found in by.items()}


@pytest.mark.parametrize("group", ["lane", None])
def test_lists_are_those_of_all_rows_so_far(spark, tmp_path, group):
    r = random.Random(5)
    batches = [[row(r.choice(["a", "b", None, ""]), r.choice([None, 1, 2, 3, -4]), pos) for pos in range(40 * n, 40 * n + 40)] for n in range(3)]
    batches[1] = [b for b in batches[1] if b[0] != "a"]  # a lane that a micro-batch does not meet keeps its list
    found = lists(spark, str(tmp_path), batches, group)
    for n in range(3):
        assert found[n] == best([b for part in batches[: n + 1] for b in part], group, 3)


def test_repeated_rows_and_nulls(spark, tmp_path):
    twice = [row("a", 5, 1), row("a", 5, 1), row("a", None, None), row("a", 4, None)]
    found = lists(spark, str(tmp_path), [twice, [], [row("a", 5, 1)]])
    assert [score for score, *_ in found[0]["a"]] == [5, 5, 4]
    assert found[1] == found[0]
    assert [score for score, *_ in found[2]["a"]] == [5, 5, 5]


def test_nothing_landed(spark, tmp_path):
    assert landed_batches(spark, f"{tmp_path}/none") == -1
    assert landed_tops(spark, f"{tmp_path}/none", values(spark, SCHEMA, []).schema).collect() == []


def test_a_repeated_micro_batch_replaces_its_lists(spark, tmp_path):
    """The stream broke off before the end of its second micro-batch was noted, and runs it again."""
    root = str(tmp_path)
    rows = [row("a", n % 7, n) for n in range(20)]
    expected = lists(spark, root, [rows[:10], rows[10:]])[-1]
    before = {file.name for file in (tmp_path / "lists" / "batch=1").glob("part-*")}
    for note in (tmp_path / "checkpoint" / "commits").glob("*1*"):
        note.unlink()
    assert lists(spark, root, [[]])[-1] == expected
    assert before.isdisjoint(file.name for file in (tmp_path / "lists" / "batch=1").glob("part-*"))
    assert landed_batches(spark, f"{root}/lists") == 2  # the last part has files without rows


def test_tasks_pass_on_few_rows_of_a_hot_group(spark):
    rows = spark.range(50_000, numPartitions=2).select(F.lit("g").alias("group_json"), F.hash("id").cast("long").alias("o0"), F.col("id").cast("string").alias("row_json"))
    assert thinned(rows, ["o0", "row_json"], 300).count() == 600
    many = rows.withColumn("group_json", F.col("row_json"))
    assert thinned(many, ["o0", "row_json"], 300, held_rows=1000).count() == 50_000


def test_only_columns_with_an_exact_order(spark):
    rows = spark.createDataFrame([(1.5, dt.date(1969, 12, 31))], "x double, d date")
    with pytest.raises(ValueError, match="order column x"):
        rising(rows, "x")
    assert rows.select(rising(rows, "-d")).first()[0] == 0
