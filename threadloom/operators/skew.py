"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from threadloom.sources.staging import stage

HOT_ROWS = 1_000_000
# A hot key has at least this share of all rows, so there are at most 1 / HOT_SHARE of them whatever the input.
HOT_SHARE = 1e-5


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """Every key with at least ``min_rows`` rows and ``HOT_SHARE`` of all rows, with ``_salts``: how
    many times ``min_rows`` it has. The share bounds the list, so it can be broadcast at any input size."""
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("_rows"))
    return hottest(counts, keys, "_rows", min_rows)


def hottest(counts: DataFrame, keys: Sequence[str], rows: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """``hot_keys`` for callers that already have rows per key.

    The counting runs once, here: keys of at least ``min_rows`` rows are written to the shared folder while the sum of all rows is
    observed, and plans that use the list read that small table."""
    n, total = F.col(rows), Observation()
    seen = counts.observe(total, F.sum(rows).alias("rows"))
    large = stage(counts.sparkSession, seen.dropna(subset=list(keys)).where(n >= min_rows).select(*keys, n.alias("_rows")))
    least = (total.get["rows"] or 0) * HOT_SHARE
    return large.where(F.col("_rows") >= least).select(*keys, F.ceil(F.col("_rows") / min_rows).cast("int").alias("_salts"))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    hot: DataFrame | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join whose left side may be dominated by a few keys.

    Rows of a hot key are spread over its ``_salts`` by a hash of ``spread``
    (stable under task retries); the matching right rows are repeated per
    salt. Rows with a NULL key match nothing and are spread as well.
    ``how``: inner, left, left_semi or left_anti."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    on = list(on)
    hot = hot_keys(left, on, min_rows) if hot is None else hot
    flags = F.broadcast(hot.select(*on, "_salts"))
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    spot = F.xxhash64(*spread)
    salt = F.when(no_key, spot).when(F.col("_salts") > 1, F.pmod(spot, F.col("_salts"))).otherwise(F.lit(0))
    salted_left = left.join(flags, on, "left").withColumn("_salt", salt).drop("_salts")
    salted_right = right.join(flags, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)).cast("bigint") - 1))
    ).drop("_salts")
    return salted_left.join(salted_right, on + ["_salt"], how).drop("_salt")
