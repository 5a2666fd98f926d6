"""Conversation documents: a thread or post with its comments nested, in bounded parts.

A thread can hold a large share of all comments, so it is not gathered into
one record whatever its size. Its comments are laid out over
``parts = ceil(comments / part_size)`` records by a hash of the comment id; the
usual thread has one part and is then the plain nested document. Nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.skew import HOT_ROWS, hottest, skew_join
from threadloom.sources.staging import stage

PART_SIZE = 1000
MIN_REPLIES = 50
MIN_COMMENTS = 5


def reply_counts(stance: DataFrame) -> DataFrame:
    return stance.groupBy("video_id", F.col("parent_id").alias("thread_id")).agg(F.count("*").alias("reply_count"))


def candidate_threads(
    stance: DataFrame, min_replies: int = MIN_REPLIES, analyzed: DataFrame | None = None
) -> DataFrame:
    """Threads with more than ``min_replies`` replies that are not in ``analyzed`` yet."""
    found = reply_counts(stance).where((F.col("reply_count") > min_replies) & F.col("thread_id").isNotNull())
    if analyzed is not None:
        found = found.join(analyzed.select("video_id", "thread_id").distinct(), ["video_id", "thread_id"], "left_anti")
    return found


def thread_rows(sentiment: DataFrame, stance: DataFrame) -> DataFrame:
    """Brand comments with their thread: roots stand for themselves, replies get the parent of the stance table."""
    links = stance.select("video_id", "comment_id", "parent_id")
    linked = sentiment.join(links, ["video_id", "comment_id"], "left")
    thread = F.when(F.col("is_root"), F.col("comment_id")).otherwise(F.col("parent_id"))
    return linked.withColumn("thread_id", thread).where(F.col("thread_id").isNotNull()).drop("parent_id")


def _parts(size: Column, part_size: int) -> Column:
    return F.greatest(F.ceil(size / part_size), F.lit(1)).cast("int")


def _part(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int")


def build_threads(
    sentiment: DataFrame, stance: DataFrame, min_replies: int = MIN_REPLIES, analyzed: DataFrame | None = None,
    part_size: int = PART_SIZE, min_hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Nested documents of the candidate threads, root first, then by comment id.

    A thread's root is a comment of its first part; later parts have it as ``root``, beside their own comments, so
    that each can be read by itself. Rows per thread are counted once, into a staged table."""
    rows = thread_rows(sentiment, stance)
    keys = ["video_id", "thread_id"]
    threads = stage(
        rows.sparkSession,
        rows.groupBy(*keys).agg(F.count("*").alias("brand_comment_count"))
        .join(candidate_threads(stance, min_replies, analyzed), keys)
        .withColumn("parts", _parts(F.col("brand_comment_count"), part_size))
    )
    joined = skew_join(
        rows, threads, keys, "inner", spread=["comment_id", "brand_mentioned"],
        hot=hottest(threads, keys, "brand_comment_count", min_hot_rows),
    )
    # A root goes to every part: one row for each thousand comments.
    part = F.when(F.col("is_root"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_part("comment_id")))
    item = F.struct(
        (~F.col("is_root")).alias("after_root"), "comment_id", "text", "brand_mentioned", "sentiment",
        "author_name", "is_root",
    )
    repeated = F.col("is_root") & (F.col("part") > 0)
    nested = joined.withColumn("part", F.explode(part)).groupBy(*keys, "part", "parts", "brand_comment_count").agg(
        F.array_sort(F.collect_list(F.when(~repeated, item))).alias("c"),
        F.min(F.when(repeated, F.struct("comment_id", "text", "author_name"))).alias("root"),
    )
    return nested.where(F.size("c") > 0).select(
        "thread_id", "video_id", "part", "parts", "brand_comment_count",
        F.transform("c", lambda x: x.dropFields("after_root")).alias("comments"), "root",
    )


def build_post_contexts(
    posts: DataFrame, comments: DataFrame, min_comments: int = MIN_COMMENTS, analyzed: DataFrame | None = None,
    part_size: int = PART_SIZE, min_hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Posts with at least ``min_comments`` comments and their nested comments, roots
    first; an eligible post whose comments are not at hand keeps an empty list. ``comments_at_hand`` counts those of all parts."""
    eligible = posts.where((F.col("comment_count") >= min_comments) & F.col("post_id").isNotNull()).select(
        "post_id", "page_name", "comment_count", "ingestion_date"
    )
    if analyzed is not None:
        eligible = eligible.join(analyzed.select("post_id").distinct(), "post_id", "left_anti")
    sizes = stage(comments.sparkSession, comments.groupBy("post_id").agg(F.count("*").alias("size")))
    planned = eligible.join(sizes, "post_id", "left").withColumn(
        "parts", _parts(F.coalesce("size", F.lit(0)), part_size)
    )
    rows = comments.select("post_id", "comment_id", "author_name", "text", "is_reply", "parent_comment_id")
    joined = skew_join(
        rows, planned.where("size > 0"), ["post_id"], "inner", spread=["comment_id"],
        hot=hottest(sizes, ["post_id"], "size", min_hot_rows),
    )
    head = ["post_id", "page_name", "comment_count", "ingestion_date", F.coalesce("size", F.lit(0)).alias("comments_at_hand")]
    item = F.struct("is_reply", "comment_id", "author_name", "text", "parent_comment_id")
    nested = joined.withColumn("part", _part("comment_id")).groupBy(*head, "part", "parts").agg(
        F.array_sort(F.collect_list(item)).alias("comments")
    )
    bare = planned.where("size is null").select(
        *head, F.lit(0).alias("part"), "parts", F.array().cast(nested.schema["comments"].dataType).alias("comments")
    )
    return nested.unionByName(bare)


def _quoted(author: Column, body: Column, max_chars: int | None) -> Column:
    body = F.coalesce(body, F.lit(""))
    if max_chars is not None:
        body = F.substring(body, 1, max_chars)
    return F.concat(F.lit(" "), F.coalesce(author, F.lit("")), F.lit(': "'), body, F.lit('"'))


def format_thread(comments: Column, max_chars: int | None = None, root: Column | None = None) -> Column:
    """A video thread as prompt lines. Texts are whole unless ``max_chars`` is given. The ``root`` of a later part
    comes first and is marked as context, not as a comment to judge once more."""
    def line(c: Column) -> Column:
        tag = F.when(c["is_root"], "[Root]").otherwise("[Reply]")
        brand = F.when(F.coalesce(c["brand_mentioned"], F.lit("")) != "",
                       F.concat(F.lit("["), c["brand_mentioned"], F.lit("]"))).otherwise("")
        return F.concat(tag, brand, _quoted(c["author_name"], c["text"], max_chars))

    lines = F.array_join(F.transform(comments, line), "\n")
    if root is None:
        return lines
    context = F.concat(F.lit("[Context]"), _quoted(root["author_name"], root["text"], max_chars), F.lit("\n"))
    return F.concat(F.when(root.isNotNull(), context).otherwise(F.lit("")), lines)


def format_post(comments: Column, max_chars: int | None = None) -> Column:
    """A group post's comments as prompt lines."""
    def line(c: Column) -> Column:
        tag = F.when(F.coalesce(c["is_reply"], F.lit(False)), "[Reply]").otherwise("[Root]")
        return F.concat(tag, _quoted(c["author_name"], c["text"], max_chars))

    return F.array_join(F.transform(comments, line), "\n")


def with_prompt(
    df: DataFrame, template: str, conversation: Column, comments: str = "comments", total: Column | None = None
) -> DataFrame:
    """``prompt``: the template with ``{n}`` and ``{conversation_text}`` filled in. ``{n}`` is ``total``,
    the comments of all parts, or by default the comments at hand."""
    n = F.size(comments) if total is None else total
    counted = F.replace(F.lit(template), F.lit("{n}"), n.cast("string"))
    return df.withColumn("prompt", F.replace(counted, F.lit("{conversation_text}"), conversation))
