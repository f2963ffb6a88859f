"""The ledger in buckets: same rows as the plain ledger, and no shuffle on its side."""

import datetime as dt
from dataclasses import replace

import pytest
from helpers import posting_rows
from postsieve.operators import ledger as ops
from postsieve.plans.daily import Settings, run_day
from postsieve.session import stage
from postsieve.sinks import tables
from postsieve.sinks.ledger_table import ledger_buckets, open_ledger, read_entries, write_entries
from pyspark.sql import functions as F

RUN = dt.datetime(2026, 3, 10, 12)
DAY = dt.timedelta(days=1)


def arrivals(spark, ids):
    return spark.createDataFrame([(i, 1, n) for n, i in enumerate(ids)], "id string, batch_seq int, pos long")


def store(spark, root, ids, run=RUN, buckets=4, label=""):
    admitted = stage(ops.admit(arrivals(spark, ids), read_entries(spark, root, run, buckets, label), run, buckets=buckets))
    rows = sorted(r.id or "" for r in admitted.collect())
    write_entries(ops.ledger_entries(admitted, run), root, run, buckets, label)
    return rows


@pytest.mark.parametrize("partitions", [8, 5])
def test_no_exchange_on_the_side_of_the_ledger(spark, tmp_path, partitions):
    """Whether or not the session's partitions are as many as the buckets."""
    root = str(tmp_path)
    for n in range(3):
        store(spark, root, [f"{n}-{i}" for i in range(50)], RUN + n * DAY, buckets=8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        known = read_entries(spark, root, RUN + 5 * DAY, 8)
        admitted = ops.admit(arrivals(spark, ["1-7", "new", "new", None]), known, RUN + 5 * DAY, buckets=8)
        plan = admitted._jdf.queryExecution().executedPlan().toString()
        assert sorted(str(r.id) for r in admitted.collect()) == ["None", "new"]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    ledger_side = plan[plan.index("SortMergeJoin") :].split("FileScan parquet")[1]
    assert "Bucketed: true" in ledger_side and "first_seen_date" in ledger_side.split("PartitionFilters: ")[1]
    # One exchange by id for the first row of each id, another one where its partitions are not the buckets; both on the run's side.
    assert plan.count("Exchange") == (1 if partitions == 8 else 2)
    assert plan.rindex("Exchange") < plan.index("FileScan parquet")


def test_rows_of_the_plain_ledger(spark, tmp_path):
    """Three days by both layouts, with a lifetime that ends between them and one day that is repeated."""
    def day(titles):
        return posting_rows(spark, [(t, "Acme", f"https://a.org/{t}", "", "mail", 1, i) for i, t in enumerate(titles)])

    found = []
    for buckets in (None, 4):
        root, settings = f"{tmp_path}/{buckets}", replace(Settings(lifetime_days=2), ledger_buckets=buckets)
        out = []
        for n, titles in enumerate([["One", "Two"], ["Two", "Three"], ["Two", "Three"], ["One", "Four"]]):
            run = RUN + [0, 1, 1, 2][n] * DAY
            out.append(sorted(r.title for r in run_day(spark, root, day(titles), run, settings=settings)["admitted"].collect()))
        found.append(out)
    assert found[0] == found[1] == [["One", "Two"], ["Three"], ["Three"], ["Four", "One"]]


def test_a_repeated_run_replaces_its_entries_also_by_nothing(spark, tmp_path):
    root, later = str(tmp_path), RUN + DAY
    assert store(spark, root, ["a", "b"]) == ["a", "b"]
    assert store(spark, root, ["a"]) == ["a"]
    assert [r.id for r in read_entries(spark, root, later, 4).collect()] == ["a"]
    assert store(spark, root, ["other"], label="-x") == ["other"]
    assert store(spark, root, []) == []
    assert [r.id for r in read_entries(spark, root, later, 4).collect()] == ["other"]


def test_open_runs_are_left_out(spark, tmp_path):
    root = str(tmp_path)
    tables.open_run(spark, root, RUN)
    store(spark, root, ["a"])
    assert read_entries(spark, root, RUN + DAY, 4).count() == 0
    tables.close_run(spark, root, RUN)
    assert read_entries(spark, root, RUN + DAY, 4).count() == 1


def test_a_new_session_finds_the_ledger(spark, tmp_path):
    """Another catalog knows nothing of the table: it is declared over the folder again."""
    root = str(tmp_path)
    store(spark, root, ["a", "it's"])
    spark.sql(f"DROP TABLE {open_ledger(spark, root, 4)}")
    assert sorted(r.id for r in read_entries(spark, root, RUN + DAY, 4).collect()) == ["a", "it's"]


def test_number_of_buckets_is_kept(spark, tmp_path):
    root = str(tmp_path)
    assert ledger_buckets(spark, root) is None
    assert read_entries(spark, root, RUN, 4).count() == 0
    assert ledger_buckets(spark, root) == 4
    with pytest.raises(ValueError, match="has 4 buckets, not 6"):
        read_entries(spark, root, RUN, 6)
    store(spark, root, [f"{i}" for i in range(100)])
    files = read_entries(spark, root, RUN + DAY, 4).select(F.input_file_name().alias("f")).distinct().count()
    assert files == 4
