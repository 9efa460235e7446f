"""Totals, per-group rollups and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, state: str = "state", workers: str = "employees", day: str = "notice_date",
            approx: bool = False) -> DataFrame:
    """Row count, worker sum, distinct states, first and last date."""
    distinct = F.approx_count_distinct(state) if approx else F.count_distinct(state)
    return df.agg(
        F.count("*").alias("notices"),
        F.coalesce(F.sum(workers), F.lit(0)).cast("bigint").alias("workers_affected"),
        distinct.alias("states"),
        F.min(day).alias("earliest_notice"),
        F.max(day).alias("latest_notice"),
    )


def per_group(df: DataFrame, by: str = "state", workers: str = "employees") -> DataFrame:
    """Count and worker sum per group, largest group first."""
    return (
        df.groupBy(by)
        .agg(F.count("*").alias("n"), F.coalesce(F.sum(workers), F.lit(0)).cast("bigint").alias("workers"))
        .orderBy(F.desc("n"), by)
    )


def share_of_max(rollup: DataFrame, count: str = "n", out: str = "share") -> DataFrame:
    """Count as a percentage of the largest count, one decimal.

    The maximum is a scalar subquery, not a one-task window.  It takes whole rollup
    rows, so both uses share one aggregate and the input is read once.
    """
    row = F.struct(count, *[c for c in rollup.columns if c != count])
    top = rollup.agg(F.coalesce(F.max(row)[count], F.lit(1))).scalar()
    return rollup.withColumn(out, F.round(F.col(count) * 100.0 / top, 1))


def source_status(sources: DataFrame, counts: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Outcome per source: ok with at least one usable row; a declared gap is not a failure.

    ``counts``: ``state, rows_parsed, workers``; ``errors``: ``state, error``.
    """
    joined = sources.join(counts, "state", "left")
    joined = joined.join(errors, "state", "left") if errors is not None else joined.withColumn(
        "error", F.lit(None).cast("string")
    )
    rows = F.coalesce(F.col("rows_parsed"), F.lit(0))
    declared = F.coalesce(F.col("unavailable"), F.lit("")) != ""
    ok = ~declared & (rows > 0)
    status = F.when(declared, "unavailable").when(ok, "ok").otherwise("failed")
    return joined.withColumns({
        "rows_parsed": F.when(declared, F.lit(0)).otherwise(rows),
        "workers": F.when(declared, F.lit(0)).otherwise(F.coalesce("workers", F.lit(0))),
        "ok": ok,
        "status": status,
        "error": F.when(declared, F.col("unavailable")).when(
            ~ok, F.coalesce("error", F.lit("parsed 0 usable rows"))
        ),
    })


def run_rollup(results: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Attempted / ok / failed sources and row counts per run."""
    declared = F.coalesce(F.col("unavailable"), F.lit("")) != ""
    return results.groupBy(*by).agg(
        F.count("*").alias("states_attempted"),
        F.count_if("ok").alias("states_ok"),
        F.count_if(~F.col("ok") & ~declared).alias("states_failed"),
        F.sum("rows_parsed").alias("rows_parsed"),
        F.sum("rows_new").alias("rows_new"),
        F.sum("rows_updated").alias("rows_updated"),
    )


def health_totals(status: DataFrame) -> DataFrame:
    """Per status: sources, rows and workers."""
    return status.groupBy("status").agg(
        F.count("*").alias("n_sources"),
        F.sum("rows_parsed").alias("rows_parsed"),
        F.sum("workers").alias("workers"),
    )


def health_lists(status: DataFrame) -> DataFrame:
    """The healthy, broken and no-data lists: one row per source, sorted."""
    return status.select("status", "state", "error").orderBy("status", "state")


def counts_by_source(records: DataFrame, by: str = "state") -> DataFrame:
    """Usable rows and workers per source, unknown headcounts as 0."""
    return records.groupBy(by).agg(
        F.count("*").alias("rows_parsed"),
        F.coalesce(F.sum("employees"), F.lit(0)).cast("bigint").alias("workers"),
    )


def health_report(results: DataFrame) -> DataFrame:
    """Report rows, one per source, ready for ``write.json``."""
    return results.select(
        "state", F.col("source_name").alias("source"), "url", "ok",
        F.col("rows_parsed").alias("rows"), "workers", "duration_s", "error",
    ).orderBy("state")


def run_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with their per-source results (1:n)."""
    return runs.join(results, "run_id")


