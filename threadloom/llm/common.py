"""Helpers shared by the operators: column choice, staged tables, per-worker state."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import fresh_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash with them."""
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows of one id apart by their texts; in the order of ids, null ids last. Rows that are equal in both have one key."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    # Null in no case, but nullable by type, as rows that come back from Python are.
    some = F.octet_length(F.coalesce(text, F.lit(""))) >= 0
    return F.when(some, F.struct(F.when(some, id_.isNull()).alias("nameless"), id_.alias("id"), F.when(some, F.xxhash64(text)).alias("text")))


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Texts without other letters take the short way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost
    executors, and both sides of a later join are plain exchanges that skew handling can split.
    Once it is written, the shuffle files it came from are of no use any more and go."""
    spark = df.sparkSession
    path = fresh_dir(spark, f"llm-{label}")
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    staged(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: dict[str, list[str]] = {}


def staged(spark: SparkSession) -> list[str]:
    """Paths staged so far in this application and not yet removed."""
    return _STAGED.setdefault(spark.sparkContext.applicationId, [])


def remove_staged(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables once nothing reads them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        if path in staged(spark):
            staged(spark).remove(path)


def once_per_worker(key: str, make: Callable[[], Any], alone: bool = False) -> Any:
    """A value kept for the life of a Python worker; ``alone``: in place of what earlier stages have kept.
    Functions arrive by value with their own globals for each task, so the value hangs on a module
    that every task shares."""
    if key not in sys.__dict__.get("_threadloom_kept", {}):
        if alone:
            forget_kept()
        value = make()
        sys.__dict__.setdefault("_threadloom_kept", {})[key] = value
    return sys.__dict__["_threadloom_kept"][key]


def forget_kept() -> None:
    """Frees what earlier stages have kept in this worker."""
    sys.__dict__.pop("_threadloom_kept", None)
    return_memory()


def return_memory() -> None:
    """Gives freed memory back to the system: Arrow's pool and, where the C library can, its heap.
    A worker otherwise keeps the most it ever used, beside the other workers of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
