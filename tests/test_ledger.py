import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import values
from postsieve.functions.stamps import instant
from postsieve.operators import ledger as ops
from postsieve.operators.predicates import gate_column
from postsieve.sinks import tables
from postsieve.streaming.buckets import BUCKETS
from postsieve.streaming.ledger import FirstSeen, admitted_stream, rocksdb_state

RUN = dt.datetime(2026, 3, 22, 12)
DAY = dt.timedelta(days=1)
DAYS = [0, 10, 21, 22, 30, 42, 43, 44, 64, 65, 90]
ADMITTED = [0, 21, 42, 64, 90]


def fold(times, lifetime):
    """The rule, one arrival after the other."""
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= lifetime:
            out.append(t)
    return out


def ledger(spark, ages):
    rows = [(k, (RUN - age).isoformat() + "+00:00") for k, age in ages.items()]
    return values(spark, "id string, at string", rows).select("id", F.col("at").cast("timestamp").alias("first_seen"))


def arrivals(spark, ids):
    return values(spark, "id string, batch_seq int, pos long", [(i, 1, n) for n, i in enumerate(ids)])


def test_lifetime_boundary(spark):
    table = ledger(spark, {"young": 21 * DAY - dt.timedelta(seconds=1), "exact": 21 * DAY, "old": 30 * DAY})
    got = {r.id for r in ops.admit(arrivals(spark, ["young", "exact", "old", "new"]), table, RUN).collect()}
    assert got == {"exact", "old", "new"}
    stats = ops.ledger_stats(table, instant(RUN - 21 * DAY)).collect()[0]
    assert (stats.loaded, stats.expired, stats.active) == (3, 2, 1)


def test_first_of_an_id_is_admitted_once_and_stamped(spark):
    got = ops.admit(arrivals(spark, ["x", "x", "y"]), ledger(spark, {"z": DAY}), RUN)
    rows = got.select("id", "pos", F.unix_seconds("added").alias("at")).collect()
    want = int(RUN.replace(tzinfo=dt.timezone.utc).timestamp())
    assert {(r.id, r.pos, r["at"]) for r in rows} == {("x", 0, want), ("y", 2, want)}


def test_admission_uses_one_shuffle_per_side(spark):
    plan = ops.admit(arrivals(spark, ["x"]), ledger(spark, {"z": DAY}).hint("merge"), RUN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 2


def test_same_run_twice_admits_the_same(spark, tmp_path):
    root = str(tmp_path)
    ids = ["a", "b", "c"]
    for _ in range(2):
        known = tables.read_ledger(spark, root, RUN)
        admitted = ops.admit(arrivals(spark, ids), known, RUN)
        assert {r.id for r in admitted.collect()} == set(ids)
        tables.write_ledger(ops.ledger_entries(admitted, RUN), root, RUN)
    later = RUN + DAY
    assert tables.read_ledger(spark, root, later).count() == 3
    assert ops.admit(arrivals(spark, ids), tables.read_ledger(spark, root, later), later).count() == 0


def test_stored_ledger_is_pruned_by_date(spark, tmp_path):
    for n in range(3):
        run = RUN + n * 30 * DAY
        tables.write_ledger(ops.ledger_entries(arrivals(spark, [f"i{n}"]), run), str(tmp_path), run)
    last = RUN + 61 * DAY
    active = ops.active_ledger(tables.read_ledger(spark, str(tmp_path), last), last)
    assert [r.id for r in active.collect()] == ["i2"]
    scan = active._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(first_seen_date" in scan


def test_missing_ledger_is_empty_but_a_damaged_one_raises(spark, tmp_path):
    assert tables.read_ledger(spark, str(tmp_path / "none"), RUN).count() == 0
    bad = tmp_path / "bad" / "ledger" / "first_seen_date=2026-03-01" / "run_id=x"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        tables.read_ledger(spark, str(tmp_path / "bad"), RUN).collect()


def test_legacy_forms(spark):
    df = values(spark, "payload string", [('["a", "b", "a"]',), ('{"c": "2026-03-01T10:00:00.5+00:00"}',)])
    got = {r.id: r["at"] for r in ops.legacy_ledger(df, RUN).select("id", F.unix_seconds("first_seen").alias("at")).collect()}
    stamp = int(RUN.replace(tzinfo=dt.timezone.utc).timestamp())
    assert got == {"a": stamp, "b": stamp, "c": 1772359200}


def history(spark, rows):
    base = dt.datetime(2026, 1, 1)
    df = values(spark, "id string, secs long, pos long", rows)
    at = (F.lit(base.isoformat()).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("secs"))).alias("ts")
    return df.select("id", at, "pos", "secs"), base


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_history_follows_the_rule(spark, hot_rows):
    rows = [("k", d * 86400, n) for n, d in enumerate(DAYS)]
    df, base = history(spark, rows)
    got = ops.admitted_over_history(df, "id", "ts", 21 * DAY, base, base + 91 * DAY, ["pos"], hot_rows)
    assert sorted((r.ts - base).days for r in got.collect()) == ADMITTED


@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_fold_under_skew(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", rng.randrange(60 * 86400), i) for i in range(800)]
    df, base = history(spark, rows)
    got = ops.admitted_over_history(df, "id", "ts", 7 * DAY, base, base + 60 * DAY, ["pos"], hot_rows=100)
    want = {(k, t) for k in {r[0] for r in rows} for t in fold([r[1] for r in rows if r[0] == k], 7 * 86400)}
    assert {(r.id, int((r.ts - base).total_seconds())) for r in got.collect()} == want


def test_gate_column(spark):
    df = values(spark, "d string", [("2026-03-09",), ("2026-03-10",)])
    assert [r[0] for r in df.select(gate_column(F.to_timestamp("d"))).collect()] == [True, False]


def test_stream_equals_fold_over_several_batches(spark, tmp_path):
    rng = random.Random(3)
    days = {"k": DAYS, **{f"k{i}": [rng.randrange(95) for _ in range(12)] for i in range(5)}}
    rows = [(k, (dt.datetime(2026, 1, 1) + d * DAY).isoformat() + "+00:00", d) for k, ds in days.items() for d in ds for _ in range(3)]
    source = tmp_path / "in"
    for low, high in ((0, 30), (30, 31), (31, 200)):
        part = [(k, at, i) for i, (k, at, d) in enumerate(rows) if low <= d < high]
        values(spark, "id string, at string, pos long", part).select("id", F.col("at").cast("timestamp").alias("run"), "pos").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id string, run timestamp, pos long").parquet(str(source))
        with rocksdb_state(spark):
            query = (
                admitted_stream(stream, "id", "run", ["pos"])
                .writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
                .format("parquet").start(str(tmp_path / "out"))
            )
            query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("id", F.datediff("run", F.lit("2026-01-01")).alias("d")).collect()
    want = sorted((k, d) for k, ds in days.items() for d in fold(set(ds), 21))
    assert sorted((r.id, r.d) for r in got) == want


def test_stream_drops_neither_late_nor_equal_stamps(spark, tmp_path):
    """Micro-batches with an id of an earlier stamp, a new id of the newest stamp, and a stamp that goes back."""
    source, got = tmp_path / "in", []
    for part in ([("a", 10)], [("late", 3)], [("b", 10)], [("same", 10), ("a", 5)], [("c", 40), ("a", 31)]):
        rows = [(k, (dt.datetime(2026, 1, 1) + d * DAY).isoformat() + "+00:00", d) for k, d in part]
        values(spark, "id string, at string, pos long", rows).select("id", F.col("at").cast("timestamp").alias("run"), "pos").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id string, run timestamp, pos long").parquet(str(source))
        with rocksdb_state(spark):
            (
                admitted_stream(stream, "id", "run", ["pos"])
                .writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
                .format("parquet").start(str(tmp_path / "out")).awaitTermination()
            )
    got = sorted((r.id, r.pos) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 10), ("a", 31), ("b", 10), ("c", 40), ("late", 3), ("same", 10)]


def test_stream_state_is_one_value_per_bucket(spark, tmp_path):
    source, got = tmp_path / "in", []
    for day, n in ((1, 3000), (5, 3010)):
        rows = spark.range(n).selectExpr("id", f"timestamp'2026-01-0{day} 00:00:00' AS run", "id AS pos")
        rows.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long, run timestamp, pos long").parquet(str(source))
        with rocksdb_state(spark):
            query = (
                admitted_stream(stream, "id", "run", ["pos"])
                .writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
                .format("parquet").start(str(tmp_path / "out"))
            )
            query.awaitTermination()
        got.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert got == [3000, 3010]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= BUCKETS


def test_stream_with_a_null_id_loses_no_other(spark, tmp_path):
    rows = [(None if k % 7 == 3 else k % 40, 1 + k % 3, k) for k in range(600)]
    source = spark.createDataFrame(rows, "id long, day int, pos long").selectExpr("id", "cast(make_date(2026, 1, day) AS timestamp) AS run", "pos")
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    with rocksdb_state(spark):
        (
            admitted_stream(stream, "id", "run", ["pos"])
            .writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
            .format("parquet").start(str(tmp_path / "out")).awaitTermination()
        )
    got = sorted(((r.id is None, r.id or 0, r.run.day) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted({(k is None, k or 0, min(d for i, d, _ in rows if i == k)) for k, _, _ in rows})


def test_state_of_an_id_goes_when_its_time_is_over():
    class State:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Now:
        def __init__(self, days):
            self.days = days

        def getCurrentProcessingTimeInMs(self):
            return self.days * 86_400_000

    class Handle:
        def getValueState(self, name, schema, ttlDurationMs=None):
            assert ttlDurationMs == 10 * 86_400_000
            return State()

    def run(days, *rows):
        frame = pd.DataFrame([(name, name, pd.Timestamp(2026, 1, 1) + d * DAY) for name, d in rows], columns=["id", "text", "run"])
        return [r.id for part in seen.handleInputRows((0,), iter([frame]), Now(days)) for r in part.itertuples()]

    seen = FirstSeen(["id", "run"], "text", "run", [], 7 * DAY, 10 * DAY)
    seen.init(Handle())
    assert run(0, ("a", 5), ("b", 5)) == ["a", "b"]
    assert run(4, ("a", 12), ("b", 6)) == ["a"]
    # b's time is over, so an older row is admitted; a was admitted again since.
    assert run(11, ("a", 6), ("b", 6)) == ["b"]


def test_empty_history_gives_no_rows(spark):
    df, base = history(spark, [])
    assert ops.admitted_over_history(df, "id", "ts", 7 * DAY, base, base, ["pos"]).count() == 0
    assert ops.admitted_over_history(df, "id", "ts", 7 * DAY, None, None, ["pos"]).count() == 0
