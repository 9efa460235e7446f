"""Log of runs: one row per run, one per source within a run, appended and replayable."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.sources.tables import read_appended

RESULT_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("rows_parsed", T.LongType()),
    T.StructField("rows_new", T.LongType()),
    T.StructField("rows_updated", T.LongType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("checked_at", T.TimestampType()),
])
RUN_SCHEMA = T.StructType([
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("states_attempted", T.LongType()),
    T.StructField("states_ok", T.LongType()),
    T.StructField("states_failed", T.LongType()),
    T.StructField("rows_parsed", T.LongType()),
    T.StructField("rows_new", T.LongType()),
    T.StructField("rows_updated", T.LongType()),
    T.StructField("notes", T.StringType()),
])


def source_results(report: DataFrame) -> DataFrame:
    """Result per ``state`` and ``url`` of a landing's report: ``ok``, ``rows_parsed`` and the reasons as ``error``.

    A linked file that was not followed is no failure.
    """
    reason = F.when(F.col("reason") != "not followed", F.col("reason"))
    return report.groupBy("state", "url").agg(
        F.sum("n_records").alias("rows_parsed"), F.array_join(F.sort_array(F.collect_set(reason)), ", ").alias("error")
    ).withColumns({"ok": F.col("error") == "", "error": F.nullif(F.col("error"), F.lit(""))})


def logged_run(spark: SparkSession, path: str, run_id: str, work: Callable[[], tuple[DataFrame, DataFrame]]) -> None:
    """Do a run's work and log it with the times it really took.

    ``work`` returns the results per source (columns of ``RESULT_SCHEMA``; missing ones are NULL) and the counts
    of ``upsert_stats``, grouped by ``state`` and, if they have them, ``source_name`` and ``url``.  The work is evaluated by
    writing the results.  A run whose work fails is logged without results, with the error in ``notes``, and the error
    is raised again.  A replay (same ``run_id``) replaces what the log holds of that run; other runs stay untouched.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run_id):
        raise ValueError(f"a run id is made of letters, digits, '_' and '-': {run_id!r}")
    started = dt.datetime.now(dt.UTC)
    nothing = spark.createDataFrame([], RESULT_SCHEMA)
    try:
        results, stats = work()
        by = [c for c in ("state", "source_name", "url") if c in stats.columns]
        given = results.drop("rows_new", "rows_updated").join(stats.select(*by, "rows_new", "rows_updated"), by, "left") \
            .fillna(0, ["rows_new", "rows_updated"])
        columns = {f.name: F.col(f.name) if f.name in given.columns else F.lit(None) for f in RESULT_SCHEMA.fields}
        columns["checked_at"] = F.coalesce(columns["checked_at"], F.lit(started))
        _write(given.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields]), f"{path}/results", run_id)
        sums = stats.agg(F.sum("rows_new").alias("rows_new"), F.sum("rows_updated").alias("rows_updated"))
        _run_row(spark, path, run_id, started, sums, None)
    except Exception as failure:
        _write(nothing, f"{path}/results", run_id)
        _run_row(spark, path, run_id, started, nothing.agg(F.sum("rows_new").alias("rows_new"), F.sum("rows_updated").alias("rows_updated")),
                 f"{type(failure).__name__}: {failure}")
        raise


def _write(df: DataFrame, path: str, run_id: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def _run_row(spark: SparkSession, path: str, run_id: str, started: dt.datetime, sums: DataFrame, notes: str | None) -> None:
    done = spark.read.schema(RESULT_SCHEMA).parquet(f"{path}/results/run_id={run_id}")
    counted = done.agg(F.count("*").alias("states_attempted"), F.count_if("ok").alias("states_ok"), F.sum("rows_parsed").alias("rows_parsed")).first()
    changed = sums.first()
    row = (started, dt.datetime.now(dt.UTC), counted.states_attempted, counted.states_ok, counted.states_attempted - counted.states_ok,
           int(counted.rows_parsed or 0), int(changed.rows_new or 0), int(changed.rows_updated or 0), notes)
    _write(spark.createDataFrame([row], RUN_SCHEMA), f"{path}/runs", run_id)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """All logged runs with ``run_id``; a run is listed once its row is written, after its results."""
    return read_appended(spark, f"{path}/runs", RUN_SCHEMA, numbered=True, number=T.StructField("run_id", T.StringType()))


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """Results per source of all listed runs, with ``run_id``."""
    found = read_appended(spark, f"{path}/results", RESULT_SCHEMA, numbered=True, number=T.StructField("run_id", T.StringType()))
    return found.join(runs(spark, path).select("run_id"), "run_id", "left_semi")
