"""Group posts with nested comments, and video comments: flatten, enrich, score, aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.catalogue import STANCE_LEXICON, SENTIMENT_LEXICON, VIDEO_BRANDS, Lexicon
from threadloom.functions import measures, moments, text
from threadloom.operators.dedup import latest_by
from threadloom.operators.scoring import score_stance, score_text
from threadloom.operators.skew import HOT_ROWS, hot_keys, hottest, skew_join

BURST_KEYS = ["author_id", "ingestion_date"]
# Model label -> stored stance.
STANCE_NAMES = {"agreement": "agree", "disagreement": "disagree", "neutral": "neutral"}


def flatten_group_posts(raw: DataFrame, order: Sequence[str] = ("ingestion_date", "comment_count")) -> DataFrame:
    """Posts without their comments; resale posts are dropped, posts without text stay."""
    flat = raw.select(
        "post_id", "source_type", "page_name", "text", "comment_count", "permalink",
        F.col("ingestion_date").try_cast("date").alias("ingestion_date"),
    )
    return latest_by(flat.where(~text.is_sale(F.col("text"))), ["post_id"], order)


def _node(c: Column, post_id: Column, parent: Column, is_reply: bool) -> Column:
    def filled(name: str) -> Column:
        return F.coalesce(c[name], F.lit(""))

    return F.struct(
        text.surrogate_key(post_id, filled("author_id"), filled("text")).alias("comment_id"),
        filled("author_id").alias("author_id"),
        filled("author_name").alias("author_name"),
        filled("author_url").alias("author_url"),
        filled("text").alias("text"),
        F.coalesce(c["reaction_count"].try_cast("int"), F.lit(0)).alias("reaction_count"),
        parent.cast("string").alias("parent_comment_id"),
        F.lit(is_reply).alias("is_reply"),
    )


def flatten_comment_tree(
    raw: DataFrame, keep_empty: bool = True,
    order: Sequence[str] = ("ingestion_date", "reaction_count", "author_name"),
) -> DataFrame:
    """One row per comment and reply, linked by surrogate ids.

    Each root expands to itself and its replies, so the raw files are read
    once. A post without comments yields one blank comment, as downstream
    counts expect, unless ``keep_empty`` is off."""
    explode = F.explode_outer if keep_empty else F.explode
    roots = raw.select(
        "post_id", "page_name", F.col("ingestion_date").try_cast("date").alias("ingestion_date"),
        explode("comments").alias("c"),
    ).withColumn("root", _node(F.col("c"), F.col("post_id"), F.lit(None), False))
    replies = F.transform(
        F.coalesce(F.col("c.replies"), F.array()),
        lambda r: _node(r, F.col("post_id"), F.col("root.comment_id"), True),
    )
    nodes = roots.select(
        "post_id", "page_name", "ingestion_date", F.explode_outer(F.concat(F.array("root"), replies)).alias("n")
    )
    flat = nodes.select(
        "n.comment_id", "post_id", "page_name", "n.author_id", "n.author_name", "n.author_url", "n.text",
        "n.reaction_count", "n.parent_comment_id", "n.is_reply", "ingestion_date",
    )
    return latest_by(flat, ["comment_id"], order)


def flag_bursts(
    df: DataFrame, limit: int = measures.BURST_COMMENTS, ignore_blank_author: bool = False,
    id_col: str = "comment_id", min_hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``is_bot``: the author wrote more than ``limit`` comments on that day.

    Authors are counted with map-side combine and only the few (author, day)
    pairs above the limit are joined back, salted where one pair is very large
    (comments without author id share one)."""
    keyed = df.withColumn("_who", F.struct(*BURST_KEYS))  # a struct also matches on NULL parts
    counts = keyed.groupBy("_who").agg(F.count(id_col).alias("_n"))
    if ignore_blank_author:
        counts = counts.where(F.col("_who.author_id") != "")
    bursts = counts.where(F.col("_n") > limit)
    flagged = skew_join(
        keyed, bursts.select("_who", F.lit(True).alias("_burst")), ["_who"], "left",
        spread=[id_col], hot=hottest(bursts, ["_who"], "_n", min_hot_rows),
    )
    return flagged.withColumn("is_bot", F.coalesce("_burst", F.lit(False))).select(*df.columns, "is_bot")


def enrich_group_comments(df: DataFrame, **burst) -> DataFrame:
    return flag_bursts(df.withColumn("engagement_score", measures.comment_engagement()), **burst)


def fact_comments(df: DataFrame) -> DataFrame:
    return df.select(
        "comment_id", "post_id", "author_id", "text", "reaction_count", "is_reply", "parent_comment_id",
        "engagement_score", "is_bot", "sentiment_label", "sentiment_score",
        F.col("ingestion_date").alias("date"), "page_name",
    )


def agg_page_daily(df: DataFrame) -> DataFrame:
    """Posts, comments, replies, labels and reactions per day and page.

    Rows are combined per post first: the exact number of posts is then a plain
    count, and a page with most of the comments arrives pre-aggregated."""
    labels = ("positive", "negative", "neutral")
    per_post = df.groupBy(F.col("ingestion_date").alias("date"), "page_name", "post_id").agg(
        F.count("comment_id").alias("comments"),
        F.sum(F.col("is_reply").cast("int")).alias("replies"),
        *[F.count_if(F.col("sentiment_label") == v).alias(v) for v in labels],
        F.sum(F.col("reaction_count").cast("double")).alias("reactions"),
        F.count("reaction_count").alias("reacted"),
    )
    daily = per_post.groupBy("date", "page_name").agg(
        F.count("post_id").alias("total_posts"),
        F.sum("comments").alias("total_comments"),
        F.sum("replies").alias("total_replies"),
        *[F.sum(v).alias(f"{v}_count") for v in labels],
        F.round(F.try_divide(F.sum("reactions"), F.sum("reacted")), 2).alias("avg_reaction_count"),
    )
    total = F.col("total_comments")
    return daily.withColumns({
        "positive_ratio": measures.ratio(F.col("positive_count"), total),
        "negative_ratio": measures.ratio(F.col("negative_count"), total),
    })


def agg_issue_weekly(df: DataFrame) -> DataFrame:
    """Mentions, ratios, intensity and trend per Monday week, entity and aspect."""
    def mentions(label: str) -> Column:
        return F.sum(F.when(F.col("sentiment") == label, F.col("mention_count")).otherwise(F.lit(0)))

    weekly = df.groupBy(
        moments.week_start(F.col("ingestion_date")).alias("week_start"), "model_entity", "aspect"
    ).agg(
        F.sum("mention_count").alias("total_mentions"),
        mentions("positive").alias("_pos"),
        mentions("negative").alias("_neg"),
        F.round(F.avg(measures.intensity_rank(F.col("intensity"))), 2).alias("avg_intensity_score"),
    )
    shares = weekly.withColumns({
        "positive_ratio": measures.ratio(F.col("_pos"), F.col("total_mentions")),
        "negative_ratio": measures.ratio(F.col("_neg"), F.col("total_mentions")),
    }).drop("_pos", "_neg")
    return with_trend(shares)


def with_trend(weekly: DataFrame) -> DataFrame:
    """Compares each week with the previous observed week of the same entity and aspect."""
    series = Window.partitionBy("model_entity", "aspect").orderBy("week_start")
    now, before = F.col("total_mentions"), F.col("prev_week_mentions")
    trend = (
        F.when((now > before * F.lit(1.3)) & (F.col("negative_ratio") > 0.5), "rising")
        .when(now < before * F.lit(0.7), "falling")
        .otherwise("stable")
    )
    return weekly.withColumn("prev_week_mentions", F.lag("total_mentions").over(series)).withColumn(
        "trend_direction", trend
    )


def dim_group_posts(df: DataFrame, order: Sequence[str] = ("ingestion_date", "comment_count")) -> DataFrame:
    optional = [c for c in ("permalink",) if c in df.columns]
    posts = df.select(
        "post_id", "page_name", "source_type", "text", text.preview(F.col("text")).alias("text_preview"),
        "comment_count", "sentiment_label", "ingestion_date", *optional,
    )
    return latest_by(posts, ["post_id"], order)


def group_stance(
    comments: DataFrame, posts: DataFrame, processed: DataFrame | None = None,
    load: Callable | None = None, lexicon: Lexicon = STANCE_LEXICON, min_hot_rows: int = HOT_ROWS,
    model_tokens: int | None = None,
) -> DataFrame:
    """Stance of each comment towards its post, for posts with a non-neutral label.

    Partitions (ingestion_date, page_name) in ``processed`` are skipped and
    price comments dropped. ``comment_text`` stores the first 50 tokens; the
    model sees the whole comment, or its first ``model_tokens``."""
    hot_posts = hot_keys(comments, ["post_id"], min_hot_rows)  # from the key column alone, before any text is read
    if processed is not None:
        partition = ["ingestion_date", "page_name"]
        done = processed.select(*partition).distinct()
        comments = skew_join(comments, done, partition, "left_anti", spread=["comment_id"], min_rows=min_hot_rows)
    eligible = posts.where(
        F.col("sentiment_label").isNotNull() & (F.col("sentiment_label") != "neutral")
        & ~text.is_blank(F.col("text"))
    ).select("post_id", F.col("text").alias("post_text"))
    wanted = comments.where(~text.names_price(F.col("text")))
    joined = skew_join(wanted, eligible, ["post_id"], "inner", spread=["comment_id"], hot=hot_posts)
    names = F.create_map(*[F.lit(v) for pair in STANCE_NAMES.items() for v in pair])
    seen = F.col("text") if model_tokens is None else text.first_tokens(F.col("text"), model_tokens)
    joined = joined.withColumn("_seen", seen)
    return score_stance(joined, "_seen", "post_text", "_label", load, lexicon).select(
        "post_id", "post_text", "comment_id",
        text.first_tokens(F.col("text")).alias("comment_text"),
        F.when(F.col("is_reply"), F.lit(2)).otherwise(F.lit(1)).alias("comment_level"),
        "parent_comment_id",
        F.coalesce(F.try_element_at(names, F.col("_label")), F.lit("neutral")).alias("stance"),
        "ingestion_date", "page_name",
    )


def clean_video_comments(df: DataFrame, unicode: bool = False) -> DataFrame:
    kept = df.dropna(subset=["comment_id", "text", "published_at"]).where(F.col("likes") >= 0)
    return kept.withColumn("text", text.clean_text(F.col("text"), unicode))


def add_comment_features(df: DataFrame) -> DataFrame:
    stamped = df.withColumn("published_at_ts", moments.parse_iso_timestamp(F.col("published_at")))
    return stamped.where(F.col("published_at_ts").isNotNull()).withColumns(
        moments.temporal_features(F.col("published_at_ts"), "comment")
    )


def silver_video_comments(raw: DataFrame, unicode: bool = False) -> DataFrame:
    return add_comment_features(clean_video_comments(raw, unicode))


def per_brand_mention(df: DataFrame, brands=VIDEO_BRANDS) -> DataFrame:
    """One row per comment and brand it names; ``is_root`` when it has no parent."""
    named = F.array_compact(F.array(*[
        F.when(text.mentions_any(F.col("text"), words), F.lit(name)) for name, words in brands
    ]))
    # The outer form keeps Spark from testing the array, and so the patterns, a second time.
    rows = df.withColumn("brand_mentioned", F.explode_outer(named)).where(F.col("brand_mentioned").isNotNull())
    return rows.withColumn("is_root", F.col("parent_id").isNull())


def video_sentiment(
    df: DataFrame, brands=VIDEO_BRANDS, load: Callable | None = None, lexicon: Lexicon = SENTIMENT_LEXICON,
) -> DataFrame:
    """Sentiment per (comment, brand): only texts that name the brand reach the model."""
    rows = per_brand_mention(df, brands)
    return score_text(rows, "text", load, lexicon).select(
        "comment_id", "video_id", "text", "brand_mentioned", F.initcap("sentiment_label").alias("sentiment"),
        F.col("author").alias("author_name"), "is_root",
        F.col("year").cast("bigint"), F.col("month").cast("bigint"),
    )


def replies_with_parents(df: DataFrame, min_hot_rows: int = HOT_ROWS) -> DataFrame:
    """Replies beside the text of the comment they answer, in the same video;
    replies to an unknown parent are dropped."""
    replies = df.where(F.col("parent_id").isNotNull()).select("video_id", "comment_id", "parent_id", "text")
    parents = df.select("video_id", F.col("comment_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return skew_join(
        replies, parents, ["video_id", "parent_id"], "inner", spread=["comment_id"], min_rows=min_hot_rows
    )


def video_stance(
    df: DataFrame, load: Callable | None = None, lexicon: Lexicon = STANCE_LEXICON, min_hot_rows: int = HOT_ROWS,
) -> DataFrame:
    pairs = replies_with_parents(df, min_hot_rows)
    return score_stance(pairs, "text", "parent_text", "stance_label", load, lexicon).select(
        "comment_id", "video_id", "parent_id", "stance_label"
    )
