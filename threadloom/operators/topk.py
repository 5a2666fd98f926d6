"""Top-k per group with a stated tie rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_per_group(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values per group with ``n`` and ``rank``; ties by value.

    Rows are counted map-side first; the window then ranks distinct values and
    Spark cuts each group to ``k`` rows before its shuffle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col(value).asc())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_values(pairs: Column, k: int) -> Column:
    """First ``k`` values of an array of ``struct(n, value)`` in struct order; NULL if empty."""
    best = F.slice(F.transform(F.array_sort(pairs), lambda p: p["value"]), 1, k)
    return F.when(F.size(best) > 0, best)


def collect_ranked(ranked: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Values of ``topk_per_group`` as one array per group, in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("n"), F.col(value).alias("value"))))
    return ranked.groupBy(*keys).agg(F.transform(pairs, lambda p: p["value"]).alias(name))
