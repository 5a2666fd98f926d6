"""Derived state that is kept per partition of a table and rebuilt only where the partition changed.

Each partition's rows of the state carry the fingerprint of the files they were derived from, and a version of the code and
parameters. Rows whose fingerprint or version is not the present one are derived anew, from just their partitions, so replaced,
moved and removed rows of the table need no retraction: the partitions that had them and that have them now are both new. It does not matter
which job wrote the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.sources.key_index import fingerprints
from threadloom.sources.tables import in_partitions, partition_text, read_if_present


def current_state(
    spark: SparkSession, table: DataFrame, path: str, state_path: str, columns: Sequence[str], version: str,
    derive: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """State rows of all partitions of the table at ``path``, after those that are out of date have been derived anew.

    ``derive`` gets rows of some partitions and returns state rows with the partition columns. Rows of partitions that are gone
    stay in the state's folder but are not returned."""
    columns = list(columns)
    partitions = T.StructType([table.schema[c] for c in columns])
    there = fingerprints(spark, path, partitions).select(
        *columns, partition_text(columns).alias("_part"), F.col("fingerprint").alias("_fingerprint"))
    empty = derive(table.limit(0))
    kinds = {f.name: f for f in empty.schema.fields}
    schema = T.StructType([f for f in empty.schema.fields if f.name not in columns] + [
        T.StructField("_fingerprint", T.LongType()), T.StructField("_version", T.StringType())] + [kinds[c] for c in columns])

    def fresh() -> DataFrame:
        held = read_if_present(spark, state_path, schema)
        held = spark.createDataFrame([], schema) if held is None else held
        held = held.where(F.col("_version") == version).withColumn("_part", partition_text(columns))
        return held.join(there.select("_part", "_fingerprint"), ["_part", "_fingerprint"], "left_semi")

    stale = there.join(fresh().select("_part").distinct(), "_part", "left_anti")
    if not stale.isEmpty():
        rows = derive(in_partitions(table, stale.select(*columns))).withColumn("_part", partition_text(columns))
        rows = rows.join(stale.select("_part", "_fingerprint"), "_part").drop("_part").withColumn("_version", F.lit(version))
        writer = rows.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*columns).parquet(state_path)
    return fresh().drop("_part", "_fingerprint", "_version")
