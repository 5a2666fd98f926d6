"""Short posts from landed files to published tables.

Every step reads tables and writes tables. What is expensive (scoring) is
written once and read back; nothing is cached and nothing passes the driver
except check reports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from threadloom import contracts
from threadloom.catalogue import BRANDS, SENTIMENT_LEXICON, Brand, Lexicon
from threadloom.functions.measures import VIRAL_THRESHOLD
from threadloom.operators import posts, quality
from threadloom.operators.scoring import score_text
from threadloom.sources import part_state, tables, writers

SILVER_DAYS = ("year", "month", "day")
SILVER_ORDER = ("ingestion_date", "likeCount", "retweetCount", "url")


def build_silver(spark: SparkSession, bronze: str, silver: str, incremental: bool = False) -> None:
    """Bronze to silver: everything anew, or the newest landing merged into its days."""
    raw = tables.read_latest_bronze(spark, bronze, "posts") if incremental else tables.read_bronze(spark, bronze, "posts")
    merge_silver(spark, raw, silver, replace=not incremental)


def merge_silver(spark: SparkSession, raw: DataFrame, silver: str, replace: bool = False) -> None:
    clean = contracts.conform(posts.silver_posts(raw), contracts.SILVER_POST)
    verify = quality.enforcing(quality.post_checks())
    if replace:
        writers.publish(spark, clean, silver, SILVER_DAYS, verify)
    else:
        writers.merge_partitions(spark, clean, silver, ["id"], SILVER_ORDER, SILVER_DAYS, verify)


def score_posts(
    silver: DataFrame, brands: Sequence[Brand] = BRANDS, as_of=None, load: Callable | None = None,
    lexicon: Lexicon = SENTIMENT_LEXICON, viral_threshold: float = VIRAL_THRESHOLD,
) -> DataFrame:
    """Fact rows of silver posts."""
    return fact_rows(posts.add_analytics(silver, brands, as_of, viral_threshold), load, lexicon)


def fact_rows(enriched: DataFrame, load: Callable | None = None, lexicon: Lexicon = SENTIMENT_LEXICON) -> DataFrame:
    """Fact rows of posts with their analytics columns."""
    return contracts.conform(posts.fact_posts(score_text(enriched, load=load, lexicon=lexicon)), contracts.FACT_POSTS)


def author_state(
    spark: SparkSession, posts_table: DataFrame, silver: str, path: str, brands: Sequence[Brand] = BRANDS
) -> DataFrame:
    """Per silver day and author what the author dimension needs. Only days whose files changed since the last run are read and tagged."""
    version = hashlib.sha256(repr([(b.name, b.keywords) for b in brands]).encode()).hexdigest()
    return part_state.current_state(
        spark, posts_table, silver, path, SILVER_DAYS, version,
        lambda rows: posts.author_parts(posts.add_author_columns(rows, brands), SILVER_DAYS, brands))


def build_gold(
    spark: SparkSession, silver: str, gold: str, as_of=None, brands: Sequence[Brand] = BRANDS,
    load: Callable | None = None, lexicon: Lexicon = SENTIMENT_LEXICON, window_days: int = 30,
    latest_only: bool = True, viral_threshold: float = VIRAL_THRESHOLD,
) -> None:
    """Star schema: facts of the newest silver day (or of all), the daily brand
    aggregate of the days this touches, author and brand dimensions, and author
    performance over the last ``window_days``. The author dimension is merged from a state per silver day, of
    which only changed days are derived anew."""
    gold = gold.rstrip("/")
    everything = tables.read_table(spark, silver, contracts.SILVER_POST)
    new = tables.read_latest(spark, silver, schema=contracts.SILVER_POST) if latest_only else everything
    enriched = posts.add_analytics(new, brands, as_of, viral_threshold)
    # Analytics columns are checked while the facts are staged, so that texts are read and tagged once.
    watched, judge = quality.enforcing(quality.analytics_checks()).observed(enriched)

    facts = writers.merge_partitions(
        spark, fact_rows(watched, load, lexicon), f"{gold}/fact_posts",
        ["tweet_id"], ["created_at_ts"], ["date", "primary_brand"],
        quality.enforcing(quality.fact_post_checks(), unique="tweet_id", earlier=lambda: judge(enriched)),
    )

    all_facts = tables.read_table(spark, f"{gold}/fact_posts", contracts.FACT_POSTS)
    touched = tables.in_partitions(all_facts, facts.select("date").distinct())
    daily = contracts.conform(posts.agg_brand_daily(touched), contracts.AGG_BRAND_DAILY)
    verify = quality.enforcing(quality.brand_daily_checks())
    writers.publish(spark, daily, f"{gold}/agg_brand_daily", ["date"], verify, replace=False)

    authors = contracts.conform(
        posts.merge_author_parts(author_state(spark, everything, silver, f"{gold}/author_state", brands), brands), contracts.DIM_AUTHORS)
    writers.publish(spark, authors, f"{gold}/dim_authors", verify=quality.enforcing(quality.dim_author_checks()))
    writers.write_small_table(posts.dim_brands(spark, brands), f"{gold}/dim_brands")

    recent = tables.read_window(all_facts, "date", window_days, as_of)
    performance = contracts.conform(posts.agg_author_perf(recent, brands), contracts.AGG_AUTHOR_PERF)
    verify = quality.enforcing(quality.author_perf_checks())
    writers.publish(spark, performance, f"{gold}/agg_author_perf", verify=verify)

