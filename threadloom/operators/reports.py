"""Read-side reports over the published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.catalogue import SENTIMENTS
from threadloom.functions import measures
from threadloom.functions.moments import to_iso

# Columns of the thread insight report.
INSIGHT_COLUMNS = (
    "thread_id", "video_id", "entity", "aspect", "sentiment", "intensity", "mention_count", "evidence",
    "brand_comment_count", "analyzed_at",
)
ALL_VIDEOS = "__all__"


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = (T.FloatType, T.DoubleType)
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
        for f in df.schema.fields
    ])


def thread_insight_rows(insights: DataFrame) -> DataFrame:
    """The report columns that the table has; timestamps as ISO text."""
    fields = {f.name: f.dataType for f in insights.schema.fields}
    return insights.select(*[
        to_iso(F.col(c)).alias(c) if isinstance(fields[c], T.TimestampType) else F.col(c)
        for c in INSIGHT_COLUMNS if c in fields
    ])


def for_video(insights: DataFrame, video_id: str = ALL_VIDEOS) -> DataFrame:
    return insights if video_id == ALL_VIDEOS else insights.where(F.col("video_id") == video_id)


def controversial_posts(stance: DataFrame, posts: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` posts with most stance comments, with agreement counts; ties by post id."""
    counts = stance.groupBy("post_id").agg(
        F.count_if(F.col("stance") == "agree").alias("agree_count"),
        F.count_if(F.col("stance") == "disagree").alias("disagree_count"),
        F.count("comment_id").alias("total_comments"),
    )
    wanted = ["post_id", "text_preview", "sentiment_label", "page_name"]
    wanted += [c for c in ("permalink",) if c in posts.columns]
    top = counts.join(posts.select(*wanted), "post_id").orderBy(F.col("total_comments").desc(), "post_id").limit(k)
    total = F.col("total_comments")
    return nan_to_null(top.drop("post_id")).withColumns({
        "agree_pct": measures.percent(F.col("agree_count"), total),
        "disagree_pct": measures.percent(F.col("disagree_count"), total),
    })


def _mentions(sentiment: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("sentiment") == sentiment, F.col("mention_count"))), F.lit(0))


def entity_scorecard(insights: DataFrame) -> DataFrame:
    """Per entity: mentions in all and by sentiment, percentages, top aspect; ordered by mentions.

    Mentions are summed per (entity, aspect) first, which also yields the arg-max."""
    per_aspect = insights.groupBy("entity", "aspect").agg(
        F.sum("mention_count").alias("mentions"), *[_mentions(s).alias(s) for s in SENTIMENTS]
    )
    cards = per_aspect.groupBy("entity").agg(
        F.sum("mentions").alias("total_mentions"), *[F.sum(s).alias(s) for s in SENTIMENTS],
        F.min(F.struct((-F.col("mentions")).alias("n"), "aspect"))["aspect"].alias("top_aspect"),
    )
    total = F.col("total_mentions")
    return cards.withColumns({
        **{f"{s}_pct": measures.percent(F.col(s), total) for s in SENTIMENTS},
        "top_aspect": F.replace(F.col("top_aspect"), F.lit("_"), F.lit(" ")),
    }).orderBy(total.desc(), "entity")


def aspect_breakdown(insights: DataFrame, entity: str, k: int = 10) -> DataFrame:
    """The ``k`` most mentioned aspects of one entity, by sentiment."""
    rows = insights.where(F.col("entity") == entity)
    return (
        rows.groupBy("aspect")
        .agg(*[_mentions(s).alias(s) for s in SENTIMENTS], F.sum("mention_count").alias("total"))
        .orderBy(F.col("total").desc(), "aspect").limit(k)
        .withColumn("aspect", F.replace(F.col("aspect"), F.lit("_"), F.lit(" ")))
    )


def top_threads(insights: DataFrame, k: int = 6, shown: int = 4) -> DataFrame:
    """The ``k`` largest threads, each with its headline insight and the next ones.

    Threads are chosen from one small row each; of the chosen threads only the
    ``shown`` best rows are ever gathered."""
    keys = ["video_id", "thread_id"]
    largest = (
        insights.groupBy(*keys).agg(F.max("brand_comment_count").alias("size"), F.count("*").alias("insights"))
        .orderBy(F.col("size").desc(), *keys).limit(k)
    )
    order = Window.partitionBy(*keys).orderBy(F.col("mention_count").desc(), "entity", "aspect")
    rows = insights.join(F.broadcast(largest), keys).withColumn("rank", F.row_number().over(order))
    best = rows.where(F.col("rank") <= shown).groupBy(*keys, "size", "insights").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "entity", "aspect", "sentiment", "intensity", "mention_count", "evidence"
        ))).alias("rows")
    )
    return best.select(
        *keys, F.col("size").alias("brand_comment_count"), "insights",
        F.get("rows", F.lit(0)).dropFields("rank").alias("headline"),
        F.transform(F.slice("rows", 2, shown - 1), lambda r: r.dropFields("rank")).alias("others"),
    )


def insight_totals(insights: DataFrame) -> DataFrame:
    return insights.agg(
        F.coalesce(F.sum("mention_count"), F.lit(0)).alias("total_mentions"),
        F.count_distinct("thread_id").alias("threads"), F.count_distinct("video_id").alias("videos"),
    )


BRAND_SENTIMENT_SQL = """
SELECT primary_brand, total_mentions, positive_count, neutral_count, negative_count,
  round(positive_count * 100.0D / nullif(labelled, 0), 2) AS positive_pct,
  round(neutral_count * 100.0D / nullif(labelled, 0), 2) AS neutral_pct,
  round(negative_count * 100.0D / nullif(labelled, 0), 2) AS negative_pct,
  bot_count, round(bot_count * 100.0D / nullif(total_mentions, 0), 2) AS bot_pct
FROM (
  SELECT primary_brand, count(*) AS total_mentions,
    count_if(sentiment_label = 'positive') AS positive_count,
    count_if(sentiment_label = 'neutral') AS neutral_count,
    count_if(sentiment_label = 'negative') AS negative_count,
    count_if(sentiment_label IN ('positive', 'neutral', 'negative')) AS labelled,
    count_if(is_bot) AS bot_count
  FROM {fact_posts}
  WHERE date >= date_sub(to_date(:as_of), 30) AND primary_brand IS NOT NULL
  GROUP BY primary_brand
)
ORDER BY total_mentions DESC, primary_brand
"""

# One pass over the facts: a post contributes its score with its first brand (or
# with none), and a mention with each brand. The windows see one row per author,
# name and brand, already partitioned by author.
AUTHOR_INFLUENCE_SQL = """
WITH parts AS (
  SELECT author_id, author_username, brand, count(brand) AS mentions,
    count(CASE WHEN coalesce(place, 0) = 0 THEN engagement_score END) AS posts,
    sum(CASE WHEN coalesce(place, 0) = 0 THEN engagement_score END) AS score
  FROM {fact_posts} LATERAL VIEW OUTER posexplode(all_brands) b AS place, brand
  GROUP BY author_id, author_username, brand
), counted AS (
  SELECT *, sum(nullif(mentions, 0)) OVER (PARTITION BY author_id, brand) AS brand_mentions FROM parts
), named AS (
  SELECT *, first_value(brand) OVER (
    PARTITION BY author_id ORDER BY brand_mentions DESC NULLS LAST, brand NULLS LAST) AS favourite
  FROM counted
), leaders AS (
  SELECT author_id, author_username, favourite, sum(posts) AS posts, round(sum(score) / sum(posts), 4) AS engagement
  FROM named WHERE favourite IS NOT NULL
  GROUP BY author_id, author_username, favourite HAVING sum(posts) > 0
  ORDER BY engagement DESC, author_id LIMIT 10
)
SELECT favourite AS top_brand, author_username, log10(sum(engagement) + 1) AS log_engagement,
  sum(posts) AS total_tweets
FROM leaders GROUP BY 1, 2
"""

VIDEO_SENTIMENT_SQL = """
SELECT brand_mentioned, sentiment, count(*) AS total_comments FROM {comment_sentiment}
GROUP BY brand_mentioned, sentiment ORDER BY brand_mentioned, total_comments DESC, sentiment
"""


def brand_sentiment_overview(spark: SparkSession, fact_posts: DataFrame, as_of: str) -> DataFrame:
    return spark.sql(BRAND_SENTIMENT_SQL, args={"as_of": as_of}, fact_posts=fact_posts)


def author_influence(spark: SparkSession, fact_posts: DataFrame) -> DataFrame:
    return spark.sql(AUTHOR_INFLUENCE_SQL, fact_posts=fact_posts)


def video_sentiment_counts(spark: SparkSession, comment_sentiment: DataFrame) -> DataFrame:
    return spark.sql(VIDEO_SENTIMENT_SQL, comment_sentiment=comment_sentiment)
