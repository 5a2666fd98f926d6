"""Video comments: silver, sentiment, stance, threads and thread insights.

All tables are partitioned by video first, so that one video's run never
replaces another's rows. Every job takes one video, or all of them in one go
(``video_id=None``); all keys include the video."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import contracts
from threadloom.catalogue import SENTIMENT_LEXICON, STANCE_LEXICON, VIDEO_BRANDS, VIDEO_VOCABULARY, Lexicon
from threadloom.operators import comments, insights, quality, threads
from threadloom.sources import tables, writers

PROMPT = """Extract opinions about iPhone (iOS) and Android from this comment thread.
Return only a JSON array of items with entity ("iphone" or "android"), aspect, sentiment
(positive, negative, neutral or mixed), intensity (strong, moderate or mild), mention_count and
evidence (a short quote).

Thread ({n} comments):
{conversation_text}

JSON array:"""


def build_silver(spark: SparkSession, bronze: str, silver: str, video_id: str | None = None) -> None:
    raw = tables.read_videos(spark, bronze, video_id)
    clean = contracts.conform(comments.silver_video_comments(raw), contracts.SILVER_VIDEO_COMMENT)
    writers.publish(
        spark, clean, silver, ["video_id", "year", "month"],
        quality.enforcing(quality.video_comment_checks()), replace=False,
    )


def read_silver(spark: SparkSession, silver: str, video_id: str | None = None) -> DataFrame:
    return tables.read_entity(spark, silver, video_id, schema=contracts.SILVER_VIDEO_COMMENT)


def build_sentiment(
    spark: SparkSession, silver: str, target: str, video_id: str | None = None, load: Callable | None = None,
    lexicon: Lexicon = SENTIMENT_LEXICON, brands=VIDEO_BRANDS,
) -> None:
    rows = comments.video_sentiment(read_silver(spark, silver, video_id), brands, load, lexicon)
    writers.write_table(contracts.conform(rows, contracts.COMMENT_SENTIMENT), target, ["video_id", "year", "month"])


def build_stance(
    spark: SparkSession, silver: str, target: str, video_id: str | None = None, load: Callable | None = None,
    lexicon: Lexicon = STANCE_LEXICON,
) -> None:
    rows = comments.video_stance(read_silver(spark, silver, video_id), load, lexicon)
    writers.write_table(contracts.conform(rows, contracts.COMMENT_STANCE), target, ["video_id"])


def build_threads(
    spark: SparkSession, sentiment: str, stance: str, insight_table: str, target: str, video_id: str | None = None,
    min_replies: int = threads.MIN_REPLIES, force: bool = False,
) -> None:
    done = None
    if not force:
        done = tables.read_or_empty(spark, insight_table, contracts.THREAD_INSIGHT).select("video_id", "thread_id")
        done = done if video_id is None else done.where(F.col("video_id") == video_id)
    documents = threads.build_threads(
        tables.read_entity(spark, sentiment, video_id, schema=contracts.COMMENT_SENTIMENT),
        tables.read_entity(spark, stance, video_id, schema=contracts.COMMENT_STANCE), min_replies, done,
    )
    writers.write_threads(documents, target)


def ask_threads(documents: DataFrame, answer: Callable[[str], str], max_chars: int | None = None) -> DataFrame:
    """The answer to each part of each thread."""
    conversation = threads.format_thread(F.col("comments"), max_chars, F.col("root"))
    prompts = threads.with_prompt(documents, PROMPT, conversation, total=F.col("brand_comment_count")).select(
        "video_id", "thread_id", "part", "brand_comment_count", "prompt"
    )
    return insights.ask(prompts, answer)


def thread_insights(documents: DataFrame, answer: Callable[[str], str], at, max_chars: int | None = None) -> DataFrame:
    """Insight rows of thread documents: prompt, answer, items, merge over all parts of a thread."""
    return insight_rows(ask_threads(documents, answer, max_chars), at)


def insight_rows(answers: DataFrame, at) -> DataFrame:
    """Insight rows of the answers to all parts of threads."""
    keys = ["video_id", "thread_id", "brand_comment_count"]
    items = insights.parse_answers(answers, VIDEO_VOCABULARY, keep=[*keys, "part"])
    merged = insights.merge_thread_insights(items.withColumn("pos", F.struct("part", "pos")), keys)
    return contracts.conform(insights.stamp_analysis(merged, at), contracts.THREAD_INSIGHT)


def build_insights(
    spark: SparkSession, documents: str, target: str, answer: Callable[[str], str], at, max_chars: int | None = None
) -> None:
    """Insights of thread documents, in the place of all earlier ones of the same threads: what a new answer does not
    name any more goes. Threads with a part whose call failed keep what they have."""
    keys = ["video_id", "thread_id"]
    answers = writers.stage(spark, ask_threads(tables.read_threads(spark, documents), answer, max_chars))
    whole = insights.answered(answers, keys)
    rows = insight_rows(answers.join(whole, keys, "left_semi"), at)
    writers.replace_groups(spark, rows, whole, target, keys, ["video_id", "year", "month"])
