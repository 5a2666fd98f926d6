"""Default rows; tests override single fields."""

from threadloom import contracts

AUTHOR = {
    "userName": "alice", "id": "a1", "isBlueVerified": False, "followers": 1000, "following": 500,
    "statusesCount": 200, "createdAt": "Mon Jan 01 00:00:00 +0000 2024",
}
POST = {
    "type": "tweet", "id": "1", "url": "https://posts.example/1", "text": "hello", "source": "web",
    "retweetCount": 1, "replyCount": 2, "likeCount": 3, "quoteCount": 0,
    "createdAt": "Fri May 09 08:14:27 +0000 2026", "lang": "en", "inReplyToId": None, "conversationId": "1",
    "inReplyToUserId": None, "inReplyToUsername": None, "author": AUTHOR,
    "entities": {"user_mentions": [{"id_str": "7"}], "hashtags": [{"text": "ev", "indices": [0, 3]}]},
    "quoted_tweet": None, "ingestion_date": "2026-05-09T09:00:00Z",
}


def raw_posts(spark, *changes):
    return spark.createDataFrame([{**POST, **c} for c in changes], contracts.struct_of(contracts.RAW_POST))


SCORED = {
    "id": "1", "author_id": "a1", "author_username": "alice", "author_is_blue_verified": False,
    "author_followers": 1000, "author_following": 500, "author_statuses_count": 200,
    "likeCount": 0, "retweetCount": 0, "replyCount": 0, "quoteCount": 0, "text": "nothing",
    "hashtags": None, "lang": "en", "created_at_ts": "2026-05-09 08:00:00",
    "sentiment_label": "positive", "sentiment_score": 0.9,
}
SCORED_DDL = (
    "id string, author_id string, author_username string, author_is_blue_verified boolean, author_followers int,"
    " author_following int, author_statuses_count int, likeCount bigint, retweetCount bigint, replyCount bigint,"
    " quoteCount bigint, text string, hashtags array<string>, lang string, created_at_ts string,"
    " sentiment_label string, sentiment_score float"
)


def scored_posts(spark, *changes):
    rows = spark.createDataFrame([{**SCORED, **c} for c in changes], SCORED_DDL)
    return rows.withColumn("created_at_ts", rows.created_at_ts.cast("timestamp"))


GROUP_POST = {
    "post_id": "p1", "source_type": "group", "page_name": "page", "text": "hello", "feedback_id": "f1",
    "comment_count": 1, "permalink": "https://g.example/p1", "ingestion_date": "2026-05-09T09:00:00Z",
    "comments": [],
}
COMMENT = {
    "author_id": "u1", "author_name": "Ann", "author_url": "https://u.example/1", "text": "first",
    "reaction_count": "3", "parent_comment_id": None, "replies": [],
}


def raw_groups(spark, *changes):
    return spark.createDataFrame([{**GROUP_POST, **c} for c in changes], contracts.struct_of(contracts.RAW_GROUP_POST))


FLAT_COMMENT = {
    "comment_id": "c1", "post_id": "p1", "page_name": "page", "author_id": "u1", "author_name": "Ann",
    "author_url": "", "text": "first", "reaction_count": 4, "parent_comment_id": None, "is_reply": False,
    "ingestion_date": "2026-05-01",
}


def flat_comments(spark, *changes):
    rows = [{**FLAT_COMMENT, "comment_id": f"c{i}", **c} for i, c in enumerate(changes)]
    ddl = contracts.SILVER_GROUP_COMMENT.replace("ingestion_date date", "ingestion_date string")
    df = spark.createDataFrame(rows, ddl)
    return df.withColumn("ingestion_date", df.ingestion_date.cast("date"))


VIDEO = {
    "comment_id": "c1", "parent_id": None, "author": "Ann", "text": "fine", "likes": 1,
    "published_at": "2026-05-09T08:14:27Z", "is_reply": False,
}


def video_comments(spark, *changes):
    return spark.createDataFrame([{**VIDEO, **c} for c in changes], contracts.struct_of(contracts.RAW_VIDEO_COMMENT))


INSIGHT = {
    "post_id": "p1", "page_name": "page", "model_entity": "VF8", "aspect": "pin", "sentiment": "negative",
    "intensity": "strong", "mention_count": 3, "evidence": "drains fast", "ingestion_date": "2026-05-06",
}


def insight_rows(spark, *changes):
    df = spark.createDataFrame(
        [{**INSIGHT, **c} for c in changes],
        "post_id string, page_name string, model_entity string, aspect string, sentiment string, intensity string,"
        " mention_count int, evidence string, ingestion_date string",
    )
    return df.withColumn("ingestion_date", df.ingestion_date.cast("date"))
