import random

import pytest
from pyspark.sql import functions as F

from helpers import posting_rows, values
from postsieve.operators.dedup import first_batch_wins, first_row_per_key, first_row_per_url, shortest_per_key, strategy_fallback
from postsieve.operators.joins import enrich
from postsieve.operators.ledger import not_in_ledger
from postsieve.operators.ranking import bounded_store, digest, top_per_lane
from postsieve.plans.daily import judged_rows, pooled_rows

SCHEMA = "url string, batch_seq int, pos long"


def brute_first_batch(rows):
    first = {}
    for url, batch, _ in rows:
        first[url] = min(first.get(url, batch), batch)
    return sorted(r for r in rows if r[1] == first[r[0]])


def skewed(n=600, seed=1):
    """A third of the rows share one url."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.4 else f"u{rng.randrange(150)}", rng.randrange(8), i) for i in range(n)]


def test_repeats_inside_the_first_batch_stay(spark):
    rows = [("a", 1, 0), ("a", 1, 1), ("a", 2, 0), ("b", 2, 1), ("b", 3, 0)]
    got = sorted(tuple(r) for r in first_batch_wins(values(spark, SCHEMA, rows)).collect())
    assert got == [("a", 1, 0), ("a", 1, 1), ("b", 2, 1)]


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
@pytest.mark.parametrize("partitions", [1, 7])
def test_first_batch_equals_brute_force_under_skew(spark, hot_rows, partitions):
    rows = skewed()
    df = values(spark, SCHEMA, rows).repartition(partitions)
    got = sorted(tuple(r) for r in first_batch_wins(df, hot_rows=hot_rows).collect())
    assert got == brute_first_batch(rows)


def test_hot_rows_are_dealt_to_many_tasks(spark):
    from postsieve.operators.skew import hot_keys, spread_join

    left = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("pos"))
    right = values(spark, "k string, v int", [("hot", 1), ("cold", 2)])
    joined = spread_join(left, right.hint("merge"), ["k"], "left", ["pos"], hot_keys(left, ["k"], 100))
    sizes = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 4000 and joined.where("v <> 1").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = joined.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 1


def test_row_that_fails_its_filter_does_not_register_its_url(spark):
    rows = posting_rows(
        spark,
        [
            ("Junior Lead", "", "u", "", "mail", 1, 0), ("Lead", "", "u", "", "cards", 2, 0), ("Lead", "", "u", "", "cards", 3, 0),
        ],
    )
    assert [(r.batch_seq, r.url) for r in pooled_rows(judged_rows(rows)).collect()] == [(2, "u")]


def test_first_row_per_key_has_a_group_limit_before_its_shuffle(spark):
    df = values(spark, "id string, batch_seq int, pos long", [("x", 2, 0), ("x", 1, 5), ("x", 1, 3), ("y", 9, 9)])
    out = first_row_per_key(df, "id")
    assert sorted((r.id, r.batch_seq, r.pos) for r in out.collect()) == [("x", 1, 3), ("y", 9, 9)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_first_row_per_url_drops_empty(spark):
    df = values(spark, "url string, msg_seq long, pos long", [("", 1, 0), (None, 1, 1), ("a", 2, 0), ("a", 1, 7)])
    assert [(r.url, r.msg_seq) for r in first_row_per_url(df).collect()] == [("a", 1)]


def test_shortest_title_keeps_first_position(spark):
    df = values(
        spark, "msg string, url string, title string, pos long",
        [("m", "u", "long title", 0), ("m", "u", "bb", 1), ("m", "u", "aa", 2), ("m", "v", "x", 3)],
    )
    got = sorted(tuple(r) for r in shortest_per_key(df, ["msg", "url"]).collect())
    assert got == [("m", "u", "bb", 0), ("m", "v", "x", 3)]


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_strategy_fallback(spark, hot_rows):
    df = values(spark, "msg string, strategy int, pos long", [("a", 2, 0), ("a", 3, 1), ("a", 2, 2), ("b", 3, 0)])
    got = sorted(tuple(r) for r in strategy_fallback(df, "msg", hot_rows=hot_rows).collect())
    assert got == [("a", 2, 0), ("a", 2, 2), ("b", 3, 0)]


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_enrichment_keeps_every_row(spark, hot_rows):
    rows = [(k, 1, i) for i, k in enumerate(["h"] * 200 + ["c", "miss"] + [None] * 30)]
    df = values(spark, "external_id string, batch_seq int, pos long", rows).withColumn("description", F.lit(""))
    details = values(spark, "external_id string, detail string", [("h", "hot text"), ("c", "cold text")])
    got = {r.pos: r.description for r in enrich(df, details, hot_rows=hot_rows).collect()}
    want = {"h": "hot text", "c": "cold text"}
    assert got == {i: want.get(k, "") for i, (k, _, _) in enumerate(rows)}


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_anti_join_with_hot_ids(spark, hot_rows):
    rows = values(spark, "id string, batch_seq int, pos long", [("h", 1, i) for i in range(100)] + [("n", 1, 100)] * 1)
    active = values(spark, "id string", [("h",), ("h",)])
    assert [r.id for r in not_in_ledger(rows, active, hot_rows=hot_rows).collect()] == ["n"]


def test_top_ten_by_arrival_and_full_lane_count(spark):
    rows = [("CORE", 5, 1, i) for i in range(12)] + [("OTHER", 9, 1, 99), ("ADJACENT", 3, 2, 0)]
    df = values(spark, "category string, score int, batch_seq int, pos long", rows).select(
        "*", *[F.lit("").alias(c) for c in ("title", "url", "company", "salary", "score_reason")]
    )
    assert sorted(r.pos for r in top_per_lane(df).where("category = 'CORE'").collect()) == list(range(10))
    shown = digest(df).collect()
    assert {r.category for r in shown} == {"CORE", "ADJACENT"}
    assert {r.lane_rows for r in shown if r.category == "CORE"} == {12} and len(shown) == 11


def test_store_is_bounded_newest_run_first(spark):
    schema = "id string, added timestamp, batch_seq int, pos long"
    make = lambda day, n: values(spark, f"id string, day string, batch_seq int, pos long", [(f"{day}-{i}", day, 1, i) for i in range(n)]).withColumn("added", F.to_timestamp("day")).drop("day")
    store = bounded_store(make("2026-01-02", 3), make("2026-01-01", 5), rows=4)
    assert {r.id for r in store.collect()} == {"2026-01-02-0", "2026-01-02-1", "2026-01-02-2", "2026-01-01-0"}
