"""One row per key, decided by value and combined map-side, so that a key with
very many copies never meets in one task as raw rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], best) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*[F.col(c) for c in [*order, *rest]])
    return df.groupBy(*keys).agg(best(row).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` values per key. Remaining ties are
    decided by the other columns, so the result does not depend on row order."""
    return _pick(df, list(keys), list(order), F.max)


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, list(keys), list(order), F.min)


def first_seen(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key in ``order`` (file, position); rows without a key are all kept.

    Keyless rows get their position as a stand-in key, so they neither merge
    nor gather in one group."""
    solo = F.when(F.col(key).isNull(), F.concat_ws("#", *[F.col(c).cast("string") for c in order]))
    return earliest_by(df.withColumn("_solo", solo), [key, "_solo"], list(order)).drop("_solo")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows. Reads the key column only."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def duplicate_summary(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, surplus rows and the number of repeated keys."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("unique"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
    )
