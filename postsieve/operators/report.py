"""Reports of a run: A1, A5, A6.

Counts can also be taken while a table is written, by ``Counted``, so that they cost no read of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .predicates import score_kept


def funnel(judged: DataFrame, *by: str) -> DataFrame:
    """A1. Rows fetched, kept, dropped by residency (of all fetched rows) and enriched, per source or by other
    columns: ``kind`` and ``batch_seq`` tell the queries of a run apart.

    ``judged`` carries the verdicts of the policy; only those columns are read.
    """
    return judged.groupBy(*(by or ("source",))).agg(
        F.count("*").alias("fetched"),
        F.count_if("kept").alias("kept"),
        F.count_if("restricted").alias("residency_dropped"),
        F.count_if("enriched").alias("enriched"),
    )


def run_metadata(kept: DataFrame, store: DataFrame, updated: Column) -> DataFrame:
    """A5, K3. One row: when, how many new, how many stored."""
    new = kept.agg(F.count("*").alias("new_count"))
    return new.select(
        updated.alias("updated"), "new_count", store.agg(F.count("*").alias("total_count")).scalar().alias("total_count")
    )


def admission_stats(pooled: DataFrame, scored: DataFrame, threshold: int = 3) -> DataFrame:
    """A6. Rows before dedup, admitted, kept and dropped; each input is read once."""
    kept = score_kept("score", threshold)
    return scored.agg(
        F.count("*").alias("admitted"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped")
    ).select(pooled.agg(F.count("*").alias("pooled")).scalar().alias("pooled"), "admitted", "kept", "dropped")


_FUNNEL = ("fetched", "kept", "residency_dropped", "enriched")


class Counted:
    """Rows whose counts are taken in the pass that writes them: ``rows`` are to be written once, then ``told`` has
    the counts.

    They are told by the tasks of the writing stage, each once, also if a task is repeated. Whoever repartitions or
    sorts ``rows`` before writing them puts a shuffle above the counts, whose stage may run again and count again.
    """

    def __init__(self, rows: DataFrame, /, **counts: Column):
        self._observation = Observation()
        self.rows = rows.observe(self._observation, *[count.alias(name) for name, count in counts.items()])

    def told(self) -> dict[str, int]:
        """Blocks until the rows have been written."""
        return self._observation.get


class CountedFunnel(Counted):
    """A1 in the pass that writes the judged rows. Counts are kept for the sources named (each adds four numbers to what a task
    tells) and for all rows; rows of other sources are seen by their number, and then the written table is read after all."""

    def __init__(self, judged: DataFrame, sources: Sequence[str], by: str = "source"):
        self.sources, self.by, self.names = list(dict.fromkeys(sources)), by, judged.columns
        counts = {"all": F.count("*")}
        for i, source in enumerate(self.sources):
            mine = F.col(by) == F.lit(source)
            tests = (mine, mine & F.col("kept"), mine & F.col("restricted"), mine & F.col("enriched"))
            counts |= {f"{name}_{i}": F.count_if(test) for name, test in zip(_FUNNEL, tests, strict=True)}
        super().__init__(judged, **counts)

    def funnel(self, written: DataFrame) -> DataFrame:
        """``funnel(written)``, where ``written`` is the table that ``rows`` were written to."""
        told = self.told()
        if sum(told[f"fetched_{i}"] for i in range(len(self.sources))) != told["all"]:
            return funnel(written, self.by)
        rows = [(s, *(told[f"{name}_{i}"] for name in _FUNNEL)) for i, s in enumerate(self.sources) if told[f"fetched_{i}"]]
        return written.sparkSession.createDataFrame(rows, f"{self.by} string, " + ", ".join(f"{name} long" for name in _FUNNEL))


def counted_scores(scored: DataFrame, threshold: int = 3) -> Counted:
    """A5, A6 in the pass that writes the scored rows: ``admitted``, ``kept``, ``dropped``."""
    kept = score_kept("score", threshold)
    return Counted(scored, admitted=F.count("*"), kept=F.count_if(kept), dropped=F.count_if(~kept))
