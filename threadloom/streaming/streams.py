"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.contracts import RAW, struct_of
from threadloom.operators.posts import silver_posts
from threadloom.plans.short_posts import SILVER_DAYS, SILVER_ORDER, merge_silver
from threadloom.sources.writers import merge_partitions


def stream_bronze(spark: SparkSession, path: str, dataset: str, max_files: int = 1000) -> DataFrame:
    """Raw records of files as they land."""
    return spark.readStream.schema(struct_of(RAW[dataset])).option("maxFilesPerTrigger", max_files).json(path)


def silver_from_stream(
    spark: SparkSession, bronze: str, silver: str, checkpoint: str, max_files: int = 1000,
    transform: Callable[[DataFrame], DataFrame] = silver_posts, keys: Sequence[str] = ("id",),
    order: Sequence[str] = SILVER_ORDER, partition_cols: Sequence[str] = SILVER_DAYS, dataset: str = "posts",
    verify: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """New bronze files into silver, in two steps. Records are taken in by small batches, of ``max_files`` files, whose
    cost does not depend on the table; then all that the run has taken in is one batch of a second stream, which is merged by key.
    So partitions are rewritten once a run, not once for each few files, and copies of an id that land
    together are told apart together, as in the batch job. Both streams keep their place below ``checkpoint``, where the records
    taken in stay as well. A batch that is repeated after a failure changes nothing: the effect is exactly once. Short posts
    go through the checks and the contract of the batch job, and a batch that fails them stops the stream before anything is
    replaced; for other data pass ``transform`` with ``verify``. Returns the second stream once the first has ended."""
    def merge(batch: DataFrame, _: int) -> None:
        if transform is silver_posts:
            merge_silver(batch.sparkSession, batch, silver)
            return
        merge_partitions(batch.sparkSession, transform(batch), silver, list(keys), list(order), list(partition_cols), verify)

    records, place = stream_bronze(spark, bronze, dataset, max_files), checkpoint.rstrip("/")
    to_table(records, f"{place}/records", f"{place}/taken").awaitTermination()
    return (
        spark.readStream.schema(records.schema).parquet(f"{place}/records").writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{place}/merged").trigger(availableNow=True).start()
    )


def unique_by_id(stream: DataFrame, key: str, time_col: str, within: str) -> DataFrame:
    """First record per key; keys are remembered for ``within`` of event time."""
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark([key])


def daily_brand_counts(stream: DataFrame, time_col: str, late: str, brand_col: str = "brand_name",
                       lang_col: str = "lang", label_col: str = "sentiment_label") -> DataFrame:
    """Mentions and labels per day, brand and language. In append mode a day is emitted once, when the
    watermark has passed it; ``to_daily_table`` has open days too. Later records of a passed day are dropped. Share of
    voice needs a day's full total and stays with the batch aggregate."""
    day = F.window(time_col, "1 day")
    label = F.lower(F.col(label_col))
    counts = stream.withWatermark(time_col, late).groupBy(day, brand_col, lang_col).agg(
        F.count("*").alias("total_mentions"),
        *[F.count_if(label == v).alias(f"{v}_count") for v in ("positive", "neutral", "negative")],
    )
    return counts.select(F.col("window.start").cast("date").alias("date"), brand_col, lang_col,
                         "total_mentions", "positive_count", "neutral_count", "negative_count")


def to_daily_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of the daily counts up to date, days that are still open included. Each batch brings
    the running totals of the days it changed, which only grow, so merging them by key can be repeated."""
    keys = [c for c in counts.columns if not c.endswith(("_mentions", "_count"))]

    def merge(batch: DataFrame, _: int) -> None:
        merge_partitions(batch.sparkSession, batch, path, keys, ["total_mentions"], ["date"])

    return (
        counts.writeStream.foreachBatch(merge).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to a Parquet table, all available input at once."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
