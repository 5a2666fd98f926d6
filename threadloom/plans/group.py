"""Group posts: silver, gold, post insights with the weekly trend, and stance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import contracts
from threadloom.catalogue import GROUP_VOCABULARY, SENTIMENT_LEXICON, STANCE_LEXICON, Lexicon, Vocabulary
from threadloom.functions.measures import BURST_COMMENTS
from threadloom.operators import comments, insights, quality, threads
from threadloom.operators.scoring import score_present_text, score_text
from threadloom.sources import tables, writers

PROMPT = """Extract the opinions about the cars discussed in this group thread.
Return only a JSON array of items with model_entity, aspect, sentiment (positive, negative, neutral
or mixed), intensity (strong, moderate or mild), mention_count and evidence (one quote).

Thread ({n} comments):
{conversation_text}

JSON array:"""


def build_silver(spark: SparkSession, bronze: str, silver: str, incremental: bool = False) -> None:
    """Posts and comments tables, anew or with the newest landing merged in."""
    silver = silver.rstrip("/")
    raw = tables.read_latest_bronze(spark, bronze, "group") if incremental else tables.read_bronze(spark, bronze, "group")
    posts, rows = comments.flatten_group_posts(raw), comments.flatten_comment_tree(raw)
    day = ["ingestion_date"]
    if incremental:
        writers.merge_partitions(spark, posts, f"{silver}/posts", ["post_id"], ["comment_count"], day)
        writers.merge_partitions(
            spark, rows, f"{silver}/comments", ["comment_id"], ["reaction_count", "author_name"], day
        )
    else:
        writers.replace_table(posts.hint("rebalance", *day), f"{silver}/posts", day)
        writers.replace_table(rows.hint("rebalance", *day), f"{silver}/comments", day)


def read_posts(spark: SparkSession, silver: str, day: str | None = None) -> DataFrame:
    rows = tables.read_table(spark, f"{silver}/posts", contracts.SILVER_GROUP_POST)
    return rows if day is None else rows.where(F.col("ingestion_date") == F.lit(day).cast("date"))


def read_comments(spark: SparkSession, silver: str, day: str | None = None) -> DataFrame:
    rows = tables.read_table(spark, f"{silver}/comments", contracts.SILVER_GROUP_COMMENT)
    return rows if day is None else rows.where(F.col("ingestion_date") == F.lit(day).cast("date"))


def label_posts(posts: DataFrame, load: Callable | None = None, lexicon: Lexicon = SENTIMENT_LEXICON) -> DataFrame:
    """Posts with a label; posts without text stay, unlabelled."""
    return score_present_text(posts, load=load, lexicon=lexicon)


def build_gold(
    spark: SparkSession, silver: str, gold: str, day: str | None = None, load: Callable | None = None,
    lexicon: Lexicon = SENTIMENT_LEXICON, burst: int = BURST_COMMENTS,
) -> None:
    """Comment facts, the daily page aggregate and the post dimension; for one
    ``day`` only its facts and aggregate rows are replaced, the dimension is rebuilt."""
    silver, gold = silver.rstrip("/"), gold.rstrip("/")
    rows = read_comments(spark, silver, day)
    quality.enforce(rows, quality.silver_group_comment_checks())
    scored = writers.stage(
        spark, score_text(comments.enrich_group_comments(rows, limit=burst), load=load, lexicon=lexicon)
    )
    facts = comments.fact_comments(scored)
    quality.enforce(facts, quality.fact_comment_checks(), unique="comment_id")
    verify = quality.enforcing(quality.page_daily_checks())
    writers.publish(spark, comments.agg_page_daily(scored), f"{gold}/agg_page_daily", ["date"], verify, replace=False)
    writers.write_table(facts, f"{gold}/fact_comments", ["date", "page_name"])
    dimension = comments.dim_group_posts(label_posts(read_posts(spark, silver), load, lexicon))
    writers.replace_table(dimension, f"{gold}/dim_posts")


def ask_posts(contexts: DataFrame, answer: Callable[[str], str], max_chars: int | None = None) -> DataFrame:
    """The answer to each part of each post's context. Every prompt states the comments of the whole post."""
    conversation = threads.format_post(F.col("comments"), max_chars)
    prompts = threads.with_prompt(contexts, PROMPT, conversation, total=F.col("comments_at_hand")).select(
        "post_id", "page_name", "ingestion_date", "part", "parts", "prompt"
    )
    return insights.ask(prompts, answer)


def post_insights(
    contexts: DataFrame, answer: Callable[[str], str], at, vocab: Vocabulary = GROUP_VOCABULARY,
    max_chars: int | None = None,
) -> DataFrame:
    """Validated insight rows of post contexts."""
    return insight_rows(ask_posts(contexts, answer, max_chars), at, vocab)


def insight_rows(answers: DataFrame, at, vocab: Vocabulary = GROUP_VOCABULARY) -> DataFrame:
    """Validated insight rows of answers; those of a post in several parts are merged over its parts."""
    keys = ["post_id", "page_name", "ingestion_date"]
    items = insights.parse_answers(answers, vocab, keep=[*keys, "part", "parts"])
    merged = insights.merge_parts(insights.validate_post_insights(items, vocab), keys, vocab)
    return contracts.conform(merged.withColumn("analyzed_at", F.lit(at).cast("timestamp")), contracts.GROUP_INSIGHT)


def build_insights(
    spark: SparkSession, silver: str, gold: str, day: str | None, answer: Callable[[str], str], at,
    vocab: Vocabulary = GROUP_VOCABULARY, min_comments: int = threads.MIN_COMMENTS, force: bool = False,
    part_size: int = threads.PART_SIZE,
) -> None:
    """Insights of the posts (of one day, or all) that have none yet, then the weekly trend over all history.

    With ``force`` posts that have some are asked about again, and the new answer takes the place of all their earlier rows, on whatever day
    and page those are. A post with a part whose call failed keeps what it has and is asked about again next time."""
    silver, gold = silver.rstrip("/"), gold.rstrip("/")
    target = f"{gold}/post_insights"
    done = None if force else tables.read_or_empty(spark, target, contracts.GROUP_INSIGHT).select("post_id")
    contexts = threads.build_post_contexts(
        read_posts(spark, silver, day), read_comments(spark, silver, day), min_comments, done, part_size
    )
    answers = writers.stage(spark, ask_posts(contexts, answer))
    whole = insights.answered(answers, ["post_id"])
    rows = insight_rows(answers.join(whole, "post_id", "left_semi"), at, vocab)
    partition = ["ingestion_date", "page_name"]
    if force:
        writers.replace_groups(spark, rows, whole, target, ["post_id"], partition)
    else:
        writers.write_table(writers.stage(spark, rows), target, partition, mode="append")
    weekly = comments.agg_issue_weekly(tables.read_table(spark, target, contracts.GROUP_INSIGHT))
    writers.replace_table(weekly, f"{gold}/agg_issue_weekly", ["week_start", "model_entity"])


def build_stance(
    spark: SparkSession, silver: str, gold: str, day: str | None = None, load: Callable | None = None,
    lexicon: Lexicon = STANCE_LEXICON,
) -> None:
    """Stance of the comments of one day, or of all; (day, page) partitions already present are skipped."""
    silver, gold = silver.rstrip("/"), gold.rstrip("/")
    target = f"{gold}/comment_stance"
    rows = comments.group_stance(
        read_comments(spark, silver, day), tables.read_table(spark, f"{gold}/dim_posts", contracts.DIM_GROUP_POSTS),
        tables.read_or_empty(spark, target, contracts.GROUP_STANCE), load, lexicon,
    )
    fresh = writers.stage(spark, contracts.conform(rows, contracts.GROUP_STANCE))
    writers.write_table(fresh, target, ["ingestion_date", "page_name"], mode="append")
