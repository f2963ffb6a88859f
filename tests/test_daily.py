import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import posting_rows, values
from postsieve.operators.scoring import apply_responses, request_block, request_text, score_with
from postsieve.plans.daily import Settings, admitted_rows, fetched_rows, judged_rows, pooled_rows, run_day
from postsieve.plans.evaluate import answers
from postsieve.session import stage
from postsieve.sinks import tables
from postsieve.streaming.incremental import run_stream

RUN = dt.datetime(2026, 3, 10, 12)
DAY = dt.timedelta(days=1)


def day(spark, titles, kind="mail", batch=1):
    return posting_rows(spark, [(t, "Acme", f"https://a.org/{t}", "", kind, batch, i) for i, t in enumerate(titles)])


def scores(by_title):
    """Responses by title, out of the request text."""

    def responses(requests):
        title = F.regexp_extract("request", r"Title: (.*)", 1)
        options = F.create_map(*[F.lit(x) for pair in by_title.items() for x in pair])
        return requests.select("id", options[title].alias("text")).where("text IS NOT NULL")

    return responses


def answer(score, lane="CORE"):
    return f'ok {{"score": {score}, "category": "{lane}", "reason": "r"}}'


def test_two_days(spark, tmp_path):
    root = str(tmp_path)
    told = scores({"One": answer(9), "Two": answer(1), "Three": answer(5, "else"), "Five": answer(2)})
    first = run_day(spark, root, day(spark, ["One", "Two", "Three", "Four"]), RUN, responses=told)
    assert {(r.title, r.score, r.category, r.score_method) for r in first["kept"].collect()} == {
        ("One", 9, "CORE", "claude"), ("Three", 5, "ELSE", "claude"), ("Four", 3, "ADJACENT", "fallback"),
    }
    assert {r.title for r in first["dropped"].collect()} == {"Two"}
    meta = first["metadata"].collect()[0]
    assert (meta.new_count, meta.total_count) == (3, 3)
    assert {(r.category, r.title, r.dots) for r in first["digest"].collect()} == {
        ("CORE", "One", "●●●●●"), ("ADJACENT", "Four", "●●●○○"),
    }
    # The dropped row is in the ledger too; a new row is admitted.
    second = run_day(spark, root, day(spark, ["Two", "One", "Five", "Six"]), RUN + DAY, responses=told)
    assert {r.title for r in second["admitted"].collect()} == {"Five", "Six"}
    meta = second["metadata"].collect()[0]
    assert (meta.new_count, meta.total_count) == (1, 4)
    assert [r.title for r in second["store"].collect()] == ["Six", "One", "Three", "Four"]
    stats = second["admission"].collect()[0]
    assert (stats.pooled, stats.admitted, stats.kept, stats.dropped) == (4, 2, 1, 1)
    # After 21 days an id is admitted and stored again.
    third = run_day(spark, root, day(spark, ["One"]), RUN + 21 * DAY, responses=told)
    assert [r.title for r in third["store"].collect()].count("One") == 2


def test_replay_replaces_its_own_run(spark, tmp_path):
    root = str(tmp_path)
    run_day(spark, root, day(spark, ["A", "B"]), RUN)
    run_day(spark, root, day(spark, ["A", "C"]), RUN + DAY)
    before = [r.title for r in tables.read_store(spark, root, RUN + DAY).collect()]
    for titles, stamp in ((["A", "B"], RUN), (["A", "C"], RUN + DAY)):
        run_day(spark, root, day(spark, titles), stamp)
    assert [r.title for r in tables.read_store(spark, root, RUN + DAY).collect()] == before == ["C", "A", "B"]
    assert tables.read_ledger(spark, root, RUN + 2 * DAY).count() == 3
    assert tables.read_runs(spark, root).count() == 2
    empty = run_day(spark, root, day(spark, ["A"]), RUN + DAY)
    assert empty["admitted"].count() == 0 and [r.title for r in empty["store"].collect()] == ["A", "B"]


def test_store_keeps_the_newest_rows(spark, tmp_path):
    root, settings = str(tmp_path), Settings(store_rows=3)
    for n in range(3):
        out = run_day(spark, root, day(spark, [f"{n}a", f"{n}b"]), RUN + n * DAY, settings=settings)
    assert [r.title for r in out["store"].collect()] == ["2a", "2b", "1a"]
    assert out["metadata"].collect()[0].total_count == 3


def test_result_does_not_depend_on_partitioning(spark, tmp_path):
    rows = day(spark, [f"t{i % 7} {i % 5}" for i in range(60)])
    seen = set()
    for n in (1, 5):
        out = run_day(spark, str(tmp_path / str(n)), rows.repartition(n), RUN)
        seen.add(tuple((r.title, r.pos) for r in out["store"].collect()))
    assert len(seen) == 1


def test_gated_feed_is_not_planned(spark):
    def never():
        raise AssertionError("scanned")

    feeds = {"mail": lambda: day(spark, ["A"]).drop("kind"), "paged_search": never}
    assert fetched_rows(feeds, RUN).count() == 1


def test_scorer_function(spark):
    rows = values(spark, "id string, title string, company string, salary string, description string", [("1", "Good", "C", "", "d"), ("2", "Odd", "C", "", "")])

    def scorer(requests: pd.Series) -> pd.Series:
        return requests.map(lambda r: '{"score": 8}' if "Title: Good" in r else None)

    got = {r.id: (r.score, r.score_method) for r in score_with(rows, scorer).collect()}
    assert got == {"1": (8, "claude"), "2": (3, "fallback")}

    def broken(requests):
        raise ValueError("down")

    assert {r.score_method for r in score_with(rows, broken).collect()} == {"fallback"}


def test_request_texts(spark):
    rows = values(spark, "title string, company string, salary string, description string", [("T", "C", "$1", "x" * 1600), ("T", None, "$1", "  ")])
    full, short = [r[0] for r in rows.select(request_text("I", "J", "K")).collect()]
    assert full == "I\n\nJOB:\nTitle: T\nCompany: C\nSalary: $1\nDescription: " + "x" * 1500
    assert short == "J\n\nJOB:\nTitle: T\nCompany: \n\nK"


def test_request_block(spark):
    rows = values(spark, "title string, company string, salary string, url string, description string", [("T", "C", "", "https://a.org", "d"), ("T", "C", "$1", "", "")])
    got = [r[0] for r in rows.select(request_block()).collect()]
    assert got == ["Title: T\nCompany: C\nURL: https://a.org\n\nDescription:\nd", "Title: T\nCompany: C\nSalary: $1"]


def test_no_responses_at_all(spark):
    got = apply_responses(values(spark, "id string", [("a",)]), None).collect()[0]
    assert (got.score, got.category, got.score_reason, got.score_method) == (3, "ADJACENT", None, "fallback")


def test_two_responses_for_one_posting_do_not_double_it(spark):
    told = values(spark, "id string, text string", [("a", '{"score": 5}'), ("a", '{"score": 4}')])
    assert [r.score for r in apply_responses(values(spark, "id string", [("a",)]), told).collect()] == [4]


def test_evaluations(spark):
    body = '{"title": "T", "company": "C"}'
    landed = values(spark, "request_id int, payload string", [(i, body) for i in range(4)] + [(4, "{")])
    full = (
        'x {"score": 7, "category": "CORE", "verdict": "v", "cover_letter_hook": "h", "cv_angle": "c", '
        '"talking_points": ["a", "b"], "red_flags": [], "salary_note": "s"} y'
    )
    told = values(spark, "request_id int, text string", [(0, full), (1, "none"), (2, "{bad}")])
    got = {r.request_id: r for r in answers(landed, told).collect()}
    assert (got[0].score, got[0].talking_points, got[0].red_flags, got[0].error) == (7, ["a", "b"], [], None)
    assert [got[i].error for i in range(1, 5)] == ["No JSON in response", "Invalid JSON in response", "No response", "Invalid JSON"]


def test_incremental_stream_equals_daily_runs(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    days = [["A", "B"], ["B", "C"], ["A", "D"]]
    stream_root = str(tmp_path / "stream")
    for n, titles in enumerate(days):
        stamp = RUN + n * DAY
        rows = day(spark, titles)
        run_day(spark, root, rows, stamp)
        landed = rows.withColumn("landed_at", F.lit(stamp.isoformat() + "+00:00").cast("timestamp"))
        landed.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(landed.schema).parquet(source)
        run_stream(stream, stream_root, str(tmp_path / "cp")).awaitTermination()
    last = RUN + 2 * DAY
    titles = [[r.title for r in tables.read_store(spark, r, last).collect()] for r in (root, stream_root)]
    assert titles[0] == titles[1] == ["D", "C", "A", "B"]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_reads_no_descriptions(spark):
    staged = stage(judged_rows(day(spark, ["A", "B"])))
    scans = [line for line in executed(pooled_rows(staged)).splitlines() if "ReadSchema" in line]
    assert scans and not any("description" in line for line in scans)
    assert all("EqualTo(kept,true)" in line for line in scans)


def test_whole_rows_are_joined_once_and_never_sorted_in_a_window(spark):
    staged = stage(judged_rows(day(spark, ["A", "B"])))
    ledger = values(spark, "id string, at string", []).select("id", F.col("at").cast("timestamp").alias("first_seen"))
    out = admitted_rows(staged, pooled_rows(staged), ledger, RUN)
    assert {r.title for r in out.collect()} == {"A", "B"}
    windows = [line for line in executed(out).splitlines() if "Window" in line]
    assert windows and not any("description" in line for line in windows)
    assert executed(out).count("description") and sum("description" in line for line in executed(out).splitlines() if "FileScan" in line) <= 2


def visible(spark, root, upto):
    store = sorted((r.title, r.added) for r in tables.read_store(spark, root, upto).collect())
    ledger = sorted((r.id, r.first_seen) for r in tables.read_ledger(spark, root, upto + DAY).collect())
    return store, ledger, sorted((r.run_id, r.new_count) for r in tables.read_runs(spark, root).collect())


def test_a_broken_run_is_not_seen(spark, tmp_path, monkeypatch):
    root, told = str(tmp_path), scores({t: answer(9) for t in ("One", "Two", "Three")})
    run_day(spark, root, day(spark, ["One"]), RUN, responses=told)
    before = visible(spark, root, RUN + DAY)

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    for broken in ("write_store", "write_digest", "write_ledger", "write_metadata"):
        with monkeypatch.context() as patch:
            patch.setattr(tables, broken, fail)
            with pytest.raises(RuntimeError, match="lost"):
                run_day(spark, root, day(spark, ["Two", "Three"]), RUN + DAY, responses=told)
        assert visible(spark, root, RUN + DAY) == before, broken
    whole = run_day(spark, root, day(spark, ["Two", "Three"]), RUN + DAY, responses=told)
    assert sorted(r.title for r in whole["store"].collect()) == ["One", "Three", "Two"]
    after = visible(spark, root, RUN + DAY)
    assert [n for _, n in after[2]] == [1, 2] and len(after[1]) == 3
    # A later try of a finished run hides it until it has ended, and then replaces it.
    with monkeypatch.context() as patch:
        patch.setattr(tables, "write_ledger", fail)
        with pytest.raises(RuntimeError, match="lost"):
            run_day(spark, root, day(spark, ["Two"]), RUN + DAY, responses=told)
    assert visible(spark, root, RUN + DAY) == before
    run_day(spark, root, day(spark, ["Two", "Three"]), RUN + DAY, responses=told)
    assert visible(spark, root, RUN + DAY) == after
