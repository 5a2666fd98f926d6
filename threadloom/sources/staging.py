"""Tables of a job's own in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.session import fresh_dir


def stage(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes rows to the shared folder and reads them back: computed once, safe
    from lost executors, and independent of tables that are about to be replaced. It is
    written and read a few times at most, so it is packed more tightly than published tables."""
    path = fresh_dir(spark, "staged")
    df.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    rows.staged_path = path  # for whoever deletes it once nothing reads it any more
    return rows
