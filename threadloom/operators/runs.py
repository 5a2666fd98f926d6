"""Run history of the jobs: durations, latest runs, expected-task grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.moments import duration_seconds, format_duration


def clean_runs(runs: DataFrame, as_of=None) -> DataFrame:
    """Start falls back to the logical date, and the duration counts from there;
    an open run counts up to ``as_of``."""
    started = runs.withColumn("start_date", F.coalesce("start_date", "logical_date"))
    timed = started.withColumn(
        "duration_seconds", duration_seconds(F.col("start_date"), F.col("end_date"), as_of)
    )
    return timed.withColumn("duration_label", format_duration(F.col("duration_seconds")))


def last_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` latest runs per job, newest first; ties by run id. Spark cuts each
    job to ``n`` rows before the shuffle, so a long history does not pile up."""
    order = Window.partitionBy("job").orderBy(F.col("start_date").desc(), F.col("run_id").desc())
    return runs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def task_grid(expected: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every expected (run_id, task_id) with its instance, or with state "none"."""
    grid = expected.join(tasks, ["run_id", "task_id"], "left")
    return grid.withColumns({
        "state": F.coalesce("state", F.lit("none")), "try_number": F.coalesce("try_number", F.lit(0)),
    })
