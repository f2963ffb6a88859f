"""The daily run: fetched rows to store, ledger, metadata, digest and reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fixed
from ..functions.stamps import instant, run_id
from ..functions.text import content_id
from ..operators import ledger as ledgers
from ..operators.dedup import first_batch_wins
from ..operators.policy import DEFAULT_TERMS, POLICIES, Policy, Terms, judged
from ..operators.predicates import gate_open, recent
from ..operators.ranking import bounded_store, digest, split_by_score, union_sources
from ..operators.report import Counted, CountedFunnel, counted_scores, funnel
from ..operators.scoring import apply_responses, score_requests, score_with
from ..schemas import ORDER, POSTING_FIELDS, SCORED
from ..sinks import ledger_table, tables

_ADMISSION = ["pooled", "admitted", "kept", "dropped"]


@dataclass(frozen=True)
class Settings:
    """What a run can be told; the defaults are the fixed values."""

    policies: Sequence[Policy] = tuple(POLICIES)
    terms: Terms = DEFAULT_TERMS
    lanes: Sequence[str] = tuple(fixed.LANES)
    lifetime_days: int = fixed.LEDGER_DAYS
    threshold: int = fixed.KEEP_SCORE
    store_rows: int = fixed.STORE_ROWS
    digest_rows: int = fixed.DIGEST_ROWS
    gate_days: int = fixed.GATE_DAYS
    sources: Sequence[str] = tuple(fixed.SOURCES)  # counted while the judged rows are written; others cost a read
    ledger_buckets: int | None = None  # a ledger in so many buckets; None: as plain folders of the runs
    gated_kinds: Sequence[str] = ("paged_search",)
    request: Mapping[str, str] = field(default_factory=dict)
    recency_days: Mapping[str, int] = field(default_factory=lambda: dict(fixed.RECENCY_DAYS))


def fetched_rows(
    feeds: Mapping[str, Callable[[], DataFrame]], run_ts: dt.datetime, settings: Settings = Settings()
) -> DataFrame:
    """U1 with F16. Postings of all feeds with the kind of their feed; a gated feed whose day it is not
    is not even planned."""
    open_feeds = {
        kind: make
        for kind, make in feeds.items()
        if kind not in settings.gated_kinds or gate_open(run_ts, settings.gate_days)
    }
    rows = union_sources([make().withColumn("kind", F.lit(kind)) for kind, make in open_feeds.items()])
    return posted_lately(rows, run_ts, settings.recency_days)


def posted_lately(
    postings: DataFrame, run_ts, days: Mapping[str, int] = fixed.RECENCY_DAYS, kind: str = "kind"
) -> DataFrame:
    """F14 on fetched rows, for feeds that were not asked for recent postings only. A posting without a
    readable date stays."""
    keep = F.lit(True)
    for name, n in days.items():
        keep = keep & ((F.col(kind) != name) | recent(F.try_to_timestamp("posted"), run_ts, n))
    return postings.where(keep)


def judged_rows(fetched: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """F19 with its verdicts. Costly to make and read several times: to be staged."""
    return judged(fetched, settings.policies, settings.terms)


def pooled_rows(verdicts: DataFrame) -> DataFrame:
    """W1 over the rows that passed: what the run has before the ledger, as ``id, url, batch_seq, pos``.

    Only the texts the id is made of are read; the descriptions stay where they are.
    """
    slim = verdicts.where("kept").select(content_id("title", "company").alias("id"), "url", *ORDER)
    return first_batch_wins(slim)


def admitted_rows(
    verdicts: DataFrame, pooled: DataFrame, ledger: DataFrame, run_ts: dt.datetime, settings: Settings = Settings()
) -> DataFrame:
    """Rows new to the ledger, stamped.

    First row per id and ledger are settled on slim rows. The whole rows are fetched last, by
    ``(batch_seq, pos)``, which identifies a row of a run: the wide table is shuffled at most once and
    never sorted, and only for rows that a filter on the admitted keys lets through.
    """
    admitted = ledgers.admit(pooled.drop("url"), ledger, run_ts, settings.lifetime_days, buckets=settings.ledger_buckets)
    whole = verdicts.where("kept").select(*POSTING_FIELDS, *ORDER)
    return whole.join(admitted.select("id", "added", *ORDER), ORDER).select(*POSTING_FIELDS, *ORDER, "id", "added")


def run_day(
    spark: SparkSession,
    root: str,
    fetched: DataFrame,
    run_ts: dt.datetime,
    responses: Callable[[DataFrame], DataFrame] | None = None,
    scorer: Callable[[pd.Series], pd.Series] | None = None,
    settings: Settings = Settings(),
    label: str = "",
    legacy: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One run against the tables under ``root``; the same stamp and label again replace their own output. Store,
    ledger, runs and digest show the run once all of them are written, or not at all.
    ``legacy``: payloads of a ledger in its old form (S11), which count beside the stored ledger.

    Scoring comes from ``responses``, a function from the requests table to a table of response
    texts, or from ``scorer``, a function run on the executors; with neither all rows get the
    fallback. Each costly step is written before the next one reads it: the judged rows, because the
    url dedup and the final fetch read them, and the scored rows, because the scorer must
    not be asked twice. The counts of the reports are taken while these tables are written.
    """
    def written(rows: DataFrame, table: str) -> DataFrame:
        return tables.write_run(rows, root, table, run_ts, label=label)

    tables.open_run(spark, root, run_ts, label)
    judged_now = CountedFunnel(judged_rows(fetched, settings), settings.sources)
    verdicts = written(judged_now.rows, "judged")
    pooled_now = Counted(pooled_rows(verdicts), pooled=F.count("*"))
    pooled = written(pooled_now.rows, "pooled")
    buckets = settings.ledger_buckets
    if buckets is None:
        ledger = tables.read_ledger(spark, root, run_ts, label)
    else:
        ledger = ledger_table.read_entries(spark, root, run_ts, buckets, label)
    if legacy is not None:
        ledger = ledger.unionByName(ledgers.legacy_ledger(legacy, run_ts))
    admitted = written(admitted_rows(verdicts, pooled, ledger, run_ts, settings), "admitted")
    if scorer is not None:
        scored = score_with(admitted, scorer, **settings.request)
    else:
        told = responses(score_requests(admitted, **settings.request)) if responses else None
        scored = apply_responses(admitted, told)
    scored_now = counted_scores(scored, settings.threshold)
    scored = written(scored_now.rows, "scored")
    counts = pooled_now.told() | scored_now.told()
    kept, dropped = split_by_score(scored, settings.threshold)
    tables.write_store(kept.select(SCORED.fieldNames()), root, run_ts, label)
    shown = tables.write_digest(digest(kept, settings.lanes, settings.digest_rows), root, run_ts, label)
    earlier = tables.read_store(spark, root, run_ts, settings.store_rows, without=run_id(run_ts) + label)
    store = bounded_store(kept.select(earlier.columns), earlier, settings.store_rows)
    entries = ledgers.ledger_entries(admitted, run_ts)
    if buckets is None:
        tables.write_ledger(entries, root, run_ts, label)
    else:
        ledger_table.write_entries(entries, root, run_ts, buckets, label)
    metadata = store.agg(F.count("*").alias("total_count")).select(
        instant(run_ts).alias("updated"), F.lit(counts["kept"]).cast("long").alias("new_count"), "total_count"
    )
    metadata = tables.write_metadata(metadata, root, run_ts, label)
    tables.close_run(spark, root, run_ts, label)
    return {
        "judged": verdicts,
        "pooled": pooled,
        "admitted": admitted,
        "kept": kept,
        "dropped": dropped,
        "digest": shown,
        "metadata": metadata,
        "store": tables.read_store(spark, root, run_ts, settings.store_rows),
        "funnel": judged_now.funnel(verdicts),
        "query_funnel": funnel(verdicts, "kind", "batch_seq"),
        "admission": spark.createDataFrame(
            [tuple(counts[c] for c in _ADMISSION)], ", ".join(f"{c} long" for c in _ADMISSION)
        ),
    }
