"""Table contracts: the columns and types each layer promises, and their enforcement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw (bronze) records as they are landed. All fields nullable.
_AUTHOR = (
    "struct<userName string, id string, isBlueVerified boolean, followers int, following int,"
    " statusesCount int, createdAt string>"
)
_ENTITIES = (
    "struct<user_mentions array<struct<id_str string>>,"
    " hashtags array<struct<text string, indices array<int>>>>"
)


def _post_fields(count_type: str) -> str:
    counts = ", ".join(f"{c} {count_type}" for c in ("retweetCount", "replyCount", "likeCount", "quoteCount"))
    texts = ", ".join(f"{c} string" for c in (
        "createdAt", "lang", "inReplyToId", "conversationId", "inReplyToUserId", "inReplyToUsername"))
    return (
        f"type string, id string, url string, text string, source string, {counts}, {texts},"
        f" author {_AUTHOR}, entities {_ENTITIES}"
    )


_REPLY = "author_id string, author_name string, author_url string, text string, reaction_count string"

RAW_POST = f"{_post_fields('bigint')}, quoted_tweet struct<{_post_fields('int')}>, ingestion_date string"
RAW_VIDEO_COMMENT = (
    "comment_id string, parent_id string, author string, text string, likes bigint,"
    " published_at string, is_reply boolean"
)
RAW_GROUP_POST = (
    "post_id string, source_type string, page_name string, text string, feedback_id string,"
    " comment_count int, permalink string, ingestion_date string,"
    f" comments array<struct<{_REPLY}, parent_comment_id string, replies array<struct<{_REPLY}>>>>"
)
RAW = {"posts": RAW_POST, "video": RAW_VIDEO_COMMENT, "group": RAW_GROUP_POST}

# Cleaned (silver) tables.
_FLAT_TEXTS = ", ".join(f"{c} string" for c in (
    "id", "type", "url", "text", "source", "lang", "createdAt", "conversationId", "inReplyToId",
    "inReplyToUserId", "inReplyToUsername", "author_id", "author_username", "author_createdAt", "ingestion_date"))
SILVER_POST = (
    f"{_FLAT_TEXTS}, retweetCount bigint, replyCount bigint, likeCount bigint, quoteCount bigint,"
    " author_is_blue_verified boolean, author_followers int, author_following int, author_statuses_count int,"
    " hashtags array<string>, mentioned_user_ids array<string>, created_at_ts timestamp,"
    " author_created_at_ts timestamp, tweet_hour int, tweet_day_of_week int, year int, month int, day int,"
    " is_reply boolean, is_retweet boolean, hashtag_count int, mention_count int"
)
SILVER_GROUP_POST = (
    "post_id string, source_type string, page_name string, text string, comment_count int, permalink string,"
    " ingestion_date date"
)
SILVER_GROUP_COMMENT = (
    "comment_id string, post_id string, page_name string, author_id string, author_name string,"
    " author_url string, text string, reaction_count int, parent_comment_id string, is_reply boolean,"
    " ingestion_date date"
)
SILVER_VIDEO_COMMENT = (
    f"video_id string, {RAW_VIDEO_COMMENT}, published_at_ts timestamp, comment_hour int,"
    " comment_day_of_week int, year int, month int, day int"
)

# Published (gold) tables.
FACT_POSTS = (
    "tweet_id string not null, author_id string not null, author_username string, author_followers bigint,"
    " primary_brand string, all_brands array<string>, created_at_ts timestamp not null, date date not null,"
    " lang string, sentiment_score double, sentiment_label string, engagement_score double,"
    " is_viral boolean, is_bot boolean, hashtags array<string>"
)
DIM_BRANDS = (
    "brand_id string not null, brand_name string not null, brand_display_name string,"
    " brand_country string, brand_segment string, search_keywords array<string>"
)
DIM_AUTHORS = (
    "author_id string not null, author_username string, author_is_blue_verified boolean,"
    " author_followers int, author_following int, author_statuses_count int,"
    " author_influence_ratio double, top_brands array<string>, is_bot_flag boolean"
)
AGG_BRAND_DAILY = (
    "date date not null, brand_name string not null, lang string not null, total_mentions bigint,"
    " positive_count bigint, neutral_count bigint, negative_count bigint, avg_sentiment_score double,"
    " avg_engagement_score double, viral_count bigint, share_of_voice double, top_influencer_id string"
)
AGG_AUTHOR_PERF = (
    "author_id string not null, total_tweets bigint, avg_engagement double, viral_tweet_count bigint,"
    " top_brands array<string>, dominant_sentiment string"
)
DIM_GROUP_POSTS = (
    "post_id string, page_name string, source_type string, text string, text_preview string,"
    " comment_count int, sentiment_label string, ingestion_date date, permalink string"
)
COMMENT_SENTIMENT = (
    "comment_id string, video_id string, text string, brand_mentioned string, sentiment string,"
    " author_name string, is_root boolean, year bigint, month bigint"
)
COMMENT_STANCE = "comment_id string, video_id string, parent_id string, stance_label string"
GROUP_STANCE = (
    "post_id string not null, post_text string, comment_id string not null, comment_text string,"
    " comment_level int not null, parent_comment_id string, stance string not null,"
    " ingestion_date date, page_name string"
)
THREAD_INSIGHT = (
    "thread_id string not null, video_id string not null, entity string not null, aspect string not null,"
    " sentiment string, intensity string, mention_count int, evidence string, brand_comment_count int,"
    " analyzed_at timestamp, year bigint not null, month bigint not null"
)
GROUP_INSIGHT = (
    "post_id string not null, page_name string not null, model_entity string not null,"
    " aspect string not null, sentiment string, intensity string, mention_count int, evidence string,"
    " ingestion_date date, analyzed_at timestamp"
)
THREAD_DOCUMENT = (
    "thread_id string, video_id string, part int, parts int, brand_comment_count bigint,"
    " comments array<struct<comment_id string, text string, brand_mentioned string, sentiment string,"
    " author_name string, is_root boolean>>, root struct<comment_id string, text string, author_name string>"
)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _nullable(dtype):
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_nullable(dtype.elementType), True)
    return dtype


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns in contract order and type. Missing columns fail at analysis;
    columns outside the contract are dropped. NULLs in required columns are
    reported by ``required_nulls`` rather than at write time."""
    return df.select(*[
        F.col(f.name).cast(_nullable(f.dataType)).alias(f.name) for f in struct_of(ddl).fields
    ])


def required_nulls(df: DataFrame, ddl: str) -> DataFrame:
    """One row per required column with its number of NULLs, from a single pass."""
    names = [f.name for f in struct_of(ddl).fields if not f.nullable]
    counts = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    return counts.unpivot([], names, "column_name", "null_rows")


def catalog_type(dtype: T.DataType) -> str:
    """Type name for catalog DDL."""
    return dtype.simpleString()
