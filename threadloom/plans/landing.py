"""Landed API pages to raw (bronze) records, and their upkeep. Fetching the pages is the caller's business."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import contracts
from threadloom.operators import raw_pages
from threadloom.operators.dedup import first_seen
from threadloom.sources import tables, writers


def land_search_posts(pages: DataFrame, bronze: str, at, limit: int | None = None) -> None:
    """The distinct posts of search pages (page_no, raw), or the first ``limit``, stamped and landed."""
    posts = raw_pages.normalize_search_pages(pages, contracts.RAW_POST, limit).drop("page_no")
    writers.land_bronze(raw_pages.stamp_ingestion(posts, at), bronze, at)


def land_video_comments(pages: DataFrame, reply_pages: DataFrame, bronze: str) -> None:
    """Comment threads (video_id, raw) and reply pages (parent_id, raw), one folder per video."""
    writers.land_video(raw_pages.flatten_comment_threads(pages, reply_pages), bronze)


def land_group_posts(
    blocks: DataFrame, comment_pages: DataFrame, reply_pages: DataFrame, bronze: str, at,
    limit: int | None = None, min_comments: int = 0,
) -> None:
    """Feed blocks, comment pages and reply pages as nested group posts, stamped and landed."""
    feed = raw_pages.extract_group_feed(blocks, limit, min_comments)
    nested = raw_pages.nest_post_comments(
        feed, raw_pages.comment_rows(comment_pages), raw_pages.reply_rows(reply_pages)
    )
    writers.land_bronze(raw_pages.stamp_ingestion(nested.drop("part"), at), bronze, at)


def without_repeats(raw: DataFrame) -> DataFrame:
    """Raw records without repeated ids: the first in file order stays, records without id all stay.
    Expects ``source_file`` and ``source_pos`` from ``read_raw_with_origin``."""
    return first_seen(raw, "id", ["source_file", "source_pos"])


def deduplicate_newest(spark: SparkSession, bronze: str) -> None:
    """Rewrites the newest landing of posts without repeated ids. Records are kept as the text they
    are, one a line, whatever fields they have; lines without an id, broken ones too, all stay."""
    newest = tables.latest_partition(spark, bronze)
    lines = tables.only_partition(spark.read.text(bronze), newest).withColumns({
        "id": F.get_json_object("value", "$.id"), "source_file": F.col("_metadata.file_path"),
        "source_pos": F.monotonically_increasing_id(),
    })
    kept = writers.stage(spark, without_repeats(lines).select("value", *tables.DAY_LEVELS, "source_file", "source_pos"))
    padded = kept.withColumns({c: F.format_string("%04d" if c == "year" else "%02d", c) for c in tables.DAY_LEVELS})
    (
        padded.sortWithinPartitions("source_file", "source_pos").drop("source_file", "source_pos")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip")
        .option("maxRecordsPerFile", writers.FILE_RECORDS).partitionBy(*tables.DAY_LEVELS).text(bronze)
    )
    writers.remove_staged(spark, kept)
