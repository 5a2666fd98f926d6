"""Landed API pages and HTML -> records. One raw document per row; nothing is fetched here.

Parsed arrays are unpacked with the outer explode and empty rows dropped
afterwards: for a plain explode Spark would push an emptiness test below, and so
parse every document twice."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.moments import to_iso
from threadloom.operators.dedup import earliest_by
from threadloom.operators.skew import hottest, skew_join

# The parts of the API answers that are read.
_SNIPPET = "struct<authorDisplayName string, textOriginal string, likeCount bigint, publishedAt string>"
_REPLY = f"struct<id string, snippet {_SNIPPET}>"
THREAD_PAGE = (
    "struct<items array<struct<id string,"
    f" snippet struct<topLevelComment struct<snippet {_SNIPPET}>, totalReplyCount bigint>,"
    f" replies struct<comments array<{_REPLY}>>>>>"
)
REPLY_PAGE = f"struct<items array<{_REPLY}>>"
_TOTAL = "comments struct<total_count int>"
_MEDIA = "media struct<__typename string>"
STORY = (
    "struct<__typename string, post_id string, permalink_url string,"
    f" feedback struct<id string, comment_rendering_instance struct<{_TOTAL}>>,"
    f" attachments array<struct<{_MEDIA}, styles struct<attachment struct<{_MEDIA}>>>>,"
    " comet_sections struct<content struct<story struct<message struct<text string>>>,"
    " context_layout struct<story struct<comet_sections struct<title struct<story struct<"
    "to struct<__typename string, name string>>>>>>,"
    " feedback struct<story struct<story_ufi_container struct<story struct<feedback_context struct<"
    f"feedback_target_with_context struct<comment_rendering_instance struct<{_TOTAL}>>>>>>>>>"
)
# A feed block holds one story, or a group with a list of stories.
FEED_BLOCK = (
    f"struct<node {STORY[:-1]}, group_feed struct<edges array<struct<node {STORY}>>>>>"
)
_PERSON = "author struct<id string, name string>, body struct<text string>"
_REACTORS = "reactors struct<count_reduced string>"
COMMENT_PAGE = (
    "struct<data struct<node struct<comment_rendering_instance_for_feed_location struct<comments struct<"
    f"edges array<struct<node struct<{_PERSON}, feedback struct<id string, url string, {_REACTORS}>>>>>>>>>"
)
REPLIES_PAGE = (
    f"struct<data struct<node struct<replies_connection struct<edges array<struct<node struct<{_PERSON},"
    f" feedback struct<{_REACTORS}>>>>>>>>"
)
PROFILE_URL = "https://www.facebook.com/profile.php?id="


def flatten_comment_threads(pages: DataFrame, reply_pages: DataFrame) -> DataFrame:
    """Root and reply rows of video comment threads.

    ``pages`` (video_id, raw) hold threads with some inline replies;
    ``reply_pages`` (parent_id, raw) the separately fetched ones, used where a
    thread announces more replies than it carries inline. Fetched replies stay
    rows of their own and are never gathered per thread."""
    threads = pages.select("video_id", F.explode_outer(F.from_json("raw", THREAD_PAGE)["items"]).alias("t")).where(
        "t is not null"
    )
    inline = F.coalesce(F.col("t.replies.comments"), F.array())
    incomplete = F.coalesce(F.col("t.snippet.totalReplyCount"), F.lit(0)) > F.size(inline)

    def row(comment_id: Column, parent: Column, snippet: Column) -> Column:
        return F.struct(
            comment_id.alias("comment_id"), parent.cast("string").alias("parent_id"),
            snippet["authorDisplayName"].alias("author"), snippet["textOriginal"].alias("text"),
            F.coalesce(snippet["likeCount"], F.lit(0)).cast("bigint").alias("likes"),
            snippet["publishedAt"].alias("published_at"), parent.isNotNull().alias("is_reply"),
        )

    root = row(F.col("t.id"), F.lit(None), F.col("t.snippet.topLevelComment.snippet"))
    replies = F.transform(inline, lambda r: row(r["id"], F.col("t.id"), r["snippet"]))
    carried = threads.select(
        "video_id", F.explode_outer(F.concat(F.array(root), F.when(incomplete, F.array()).otherwise(replies))).alias("c")
    ).select("video_id", "c.*")

    wanted = threads.where(incomplete).select("video_id", F.col("t.id").alias("thread_id"))
    answers = skew_join(
        reply_pages.select(F.col("parent_id").alias("thread_id"), "raw"), wanted, ["thread_id"], "inner", spread=["raw"]
    )
    fetched = answers.select(
        "video_id", "thread_id", F.explode_outer(F.from_json("raw", REPLY_PAGE)["items"]).alias("r")
    ).where("r is not null").select(
        "video_id", row(F.col("r.id"), F.col("thread_id"), F.col("r.snippet")).alias("c")
    ).select("video_id", "c.*")
    return carried.unionByName(fetched)


def normalize_search_pages(pages: DataFrame, post_schema: str, limit: int | None = None) -> DataFrame:
    """Posts of search result pages (page_no, raw): the first copy of each id in
    page order and, if asked for a number of posts, the first ``limit`` of those.
    Posts without id are skipped."""
    items = pages.select(
        "page_no", F.posexplode_outer(F.from_json("raw", f"struct<tweets array<struct<{post_schema}>>>")["tweets"])
    ).select("page_no", F.col("pos").alias("_pos"), "col.*").where(F.coalesce("id", F.lit("")) != "")
    unique = earliest_by(items, ["id"], ["page_no", "_pos"])
    if limit is not None:
        unique = unique.orderBy("page_no", "_pos").limit(limit)
    return unique.drop("_pos")


def extract_group_feed(blocks: DataFrame, limit: int | None = None, min_comments: int = 0) -> DataFrame:
    """Posts of group feed blocks (group_id, block_no, raw): stories from both
    block shapes, without video attachments, with at least ``min_comments``
    comments, and the first ``limit`` of each group in feed order if a limit is given.

    The first story that states the group's name gives it to the stories after it."""
    parsed = blocks.select("group_id", "block_no", F.from_json("raw", FEED_BLOCK)["node"].alias("n"))
    one = F.array(F.struct(*[F.col(f"n.{c}") for c in _story_fields()]))
    many = F.transform(F.coalesce(F.col("n.group_feed.edges"), F.array()), lambda e: e["node"])
    stories = parsed.select(
        "group_id", "block_no",
        F.posexplode_outer(F.when(F.col("n.__typename") == "Group", many).otherwise(one)).alias("pos", "s"),
    ).where(F.col("s.__typename") == "Story")

    context = "s.comet_sections.feedback.story.story_ufi_container.story.feedback_context"
    count = F.coalesce(
        "s.feedback.comment_rendering_instance.comments.total_count",
        f"{context}.feedback_target_with_context.comment_rendering_instance.comments.total_count", F.lit(0),
    )
    to = "s.comet_sections.context_layout.story.comet_sections.title.story.to"
    rows = stories.withColumn("comment_count", count).where(F.col("comment_count") >= min_comments).withColumn(
        "own_name", F.when(F.col(f"{to}.__typename") == "Group", F.col(f"{to}.name"))
    )
    names = rows.where(F.col("own_name").isNotNull()).groupBy("group_id").agg(
        F.min(F.struct("block_no", "pos", "own_name")).alias("named")
    )
    is_video = F.exists(
        F.coalesce("s.attachments", F.array()),
        lambda a: F.coalesce(a["media"]["__typename"] == "Video", F.lit(False))
        | F.coalesce(a["styles"]["attachment"]["media"]["__typename"] == "Video", F.lit(False)),
    )
    kept = rows.where(~is_video & (F.coalesce("s.post_id", F.lit("")) != ""))
    named = skew_join(kept, names, ["group_id"], "left", spread=["block_no", "pos"])
    known = F.struct("block_no", "pos") >= F.struct("named.block_no", "named.pos")
    posts = named.withColumn("group_name", F.when(known, F.col("named.own_name"))).select(
        "group_id", "block_no", "pos", F.col("s.post_id").alias("post_id"),
        F.col("s.feedback.id").alias("feedback_id"),
        F.coalesce("s.comet_sections.content.story.message.text", F.lit("")).alias("message"),
        "comment_count", "group_name", F.coalesce("s.permalink_url", F.lit("")).alias("permalink"),
    )
    if limit is not None:
        in_feed = Window.partitionBy("group_id").orderBy("block_no", "pos")
        posts = posts.withColumn("_nth", F.row_number().over(in_feed)).where(F.col("_nth") <= limit).drop("_nth")
    return posts.drop("pos")


def _story_fields() -> list[str]:
    return ["__typename", "post_id", "permalink_url", "feedback", "attachments", "comet_sections"]


def _person(n: Column) -> list[Column]:
    author_id = F.coalesce(n["author"]["id"], F.lit(""))
    return [
        author_id.alias("author_id"),
        F.coalesce(n["author"]["name"], F.lit("")).alias("author_name"),
        F.when(author_id != "", F.concat(F.lit(PROFILE_URL), author_id)).otherwise(F.lit("")).alias("author_url"),
        F.coalesce(n["body"]["text"], F.lit("")).alias("text"),
        F.coalesce(n["feedback"]["reactors"]["count_reduced"], F.lit("0")).alias("reaction_count"),
    ]


def comment_rows(pages: DataFrame) -> DataFrame:
    """Comments of comment pages (feedback_id, page_no, raw), one row each, with
    their position and the post address without its query."""
    edges = F.from_json("raw", COMMENT_PAGE)["data"]["node"]["comment_rendering_instance_for_feed_location"]
    rows = pages.select("feedback_id", "page_no", F.posexplode_outer(edges["comments"]["edges"]["node"]).alias("pos", "n"))
    rows = rows.where("n is not null")
    url = F.coalesce("n.feedback.url", F.lit(""))
    trimmed = F.concat(F.regexp_replace(F.substring_index(url, "?", 1), "/+$", ""), F.lit("/"))
    return rows.select(
        "feedback_id", "page_no", "pos", *_person(F.col("n")), F.col("n.feedback.id").alias("comment_feedback_id"),
        F.when(url != "", trimmed).alias("permalink"),
    )


def reply_rows(pages: DataFrame) -> DataFrame:
    """Replies of reply pages (comment_feedback_id, page_no, raw), one row each."""
    edges = F.from_json("raw", REPLIES_PAGE)["data"]["node"]["replies_connection"]["edges"]
    rows = pages.select("comment_feedback_id", "page_no", F.posexplode_outer(edges["node"]).alias("pos", "n")).where(
        "n is not null"
    )
    return rows.select("comment_feedback_id", "page_no", "pos", *_person(F.col("n")))


def _in_parts(rows: DataFrame, key: str, sizes: DataFrame, spread: list[str], part_size: int) -> DataFrame:
    """Rows with ``part``: one of ``weight / part_size`` hash buckets of their key."""
    planned = sizes.withColumn("_parts", F.ceil(F.col("weight") / part_size))
    joined = skew_join(rows, planned, [key], "inner", spread=spread, hot=hottest(sizes, [key], "weight"))
    return joined.withColumn("part", F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")).drop("_parts")


def nest_post_comments(
    feed: DataFrame, comments: DataFrame, replies: DataFrame, part_size: int = 1000, source_type: str = "group"
) -> DataFrame:
    """Feed posts with their comments and replies nested back, in the raw group post shape.

    A post without feedback id keeps its own comment count and has no comments;
    text and permalink come from the feed. No group is gathered whole: a comment
    with very many replies appears once per ``part_size`` replies, a post once per
    ``part_size`` comments and replies (``part`` numbers the records). The
    flattening, which works by surrogate id, reads such records like any other."""
    person = ["author_id", "author_name", "author_url", "text", "reaction_count"]
    reply_sizes = replies.groupBy("comment_feedback_id").agg(F.count("*").alias("weight"))
    gathered = _in_parts(replies, "comment_feedback_id", reply_sizes, ["page_no", "pos"], part_size).groupBy(
        "comment_feedback_id", "part"
    ).agg(F.array_sort(F.collect_list(F.struct("page_no", "pos", *person))).alias("r"))
    lists = gathered.select(
        "comment_feedback_id", F.col("part").alias("reply_part"),
        F.transform("r", lambda x: x.dropFields("page_no", "pos")).alias("replies"),
    )
    answered = skew_join(
        lists, comments, ["comment_feedback_id"], "inner", spread=["reply_part"],
        hot=hottest(reply_sizes, ["comment_feedback_id"], "weight"),
    )
    silent = comments.join(reply_sizes, "comment_feedback_id", "left_anti").withColumns({
        "reply_part": F.lit(0), "replies": F.array().cast(lists.schema["replies"].dataType),
    })
    nested = answered.unionByName(silent)

    # A post weighs its comments and their replies, so a record stays small even if one comment has most replies.
    weighed = comments.select("feedback_id", "comment_feedback_id").join(reply_sizes, "comment_feedback_id", "left")
    sizes = weighed.groupBy("feedback_id").agg(
        F.count("*").alias("n"), F.sum(F.lit(1) + F.coalesce("weight", F.lit(0))).alias("weight")
    )
    item = F.struct(
        "page_no", "pos", "reply_part", *person, F.lit(None).cast("string").alias("parent_comment_id"), "replies"
    )
    parts = _in_parts(nested, "feedback_id", sizes, ["page_no", "pos", "reply_part"], part_size).groupBy(
        "feedback_id", "part", "n"
    ).agg(F.array_sort(F.collect_list(item)).alias("c")).select(
        "feedback_id", "part", "n",
        F.transform("c", lambda x: x.dropFields("page_no", "pos", "reply_part")).alias("comments"),
    )
    head = [
        "post_id", F.lit(source_type).alias("source_type"), F.coalesce("group_name", F.lit("")).alias("page_name"),
        F.coalesce("message", F.lit("")).alias("text"), "feedback_id",
    ]
    commented = skew_join(
        parts, feed, ["feedback_id"], "inner", spread=["part"], hot=hottest(sizes, ["feedback_id"], "weight")
    ).select(*head, F.col("n").cast("int").alias("comment_count"), "permalink", "part", "comments")
    bare = feed.join(sizes, "feedback_id", "left_anti").select(
        *head, F.when(F.col("feedback_id").isNull(), F.col("comment_count")).otherwise(0).cast("int")
        .alias("comment_count"),
        "permalink", F.lit(0).alias("part"),
        F.array().cast(parts.schema["comments"].dataType).alias("comments"),
    )
    return commented.unionByName(bare)


# Markers of the post text in a page.
MESSAGE_START = '"message":{"text":"'
MESSAGE_END_RANGES = '","ranges":'
MESSAGE_END = '"}'
OG_DESCRIPTION = r"""(?i)<meta[^>]+property=["']og:description["'][^>]+content=["']([^"']{5,})["']"""
MIN_TEXT = 10


@F.pandas_udf(T.StringType())
def _unescape_html(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(html.unescape, na_action="ignore")


def _message(page: Column, end: str, min_tokens: int) -> Column:
    """The first JSON string that follows the message marker and is closed by ``end``.

    The closing quote is found by position after hiding escaped characters, which
    stays linear on long pages where a backtracking pattern would overflow."""
    def cut(tail: Column) -> Column:
        hidden = F.replace(F.replace(tail, F.lit("\\\\"), F.lit("\u0001\u0001")), F.lit('\\"'), F.lit("\u0001\u0001"))
        stop = F.instr(hidden, '"')
        return F.struct(
            F.when(stop > 0, F.substring(tail, F.lit(1), stop - 1)).alias("body"),
            F.when(stop > 0, F.substring(tail, stop, F.lit(len(end)))).alias("close"),
        )

    tails = F.split(page, r'"message":\{"text":"', -1)
    cuts = F.transform(F.slice(tails, F.lit(2), F.size(tails)), cut)
    fits = F.filter(
        cuts,
        lambda c: (c["close"] == end)
        & (F.length(F.regexp_replace(c["body"], r"\\.", "x")) >= min_tokens),
    )
    body = F.get(fits, F.lit(0))["body"]
    decoded = F.from_json(F.concat(F.lit('{"t":"'), body, F.lit('"}')), "t string")["t"]
    stripped = F.regexp_replace(decoded, r"^\s+|\s+$", "")
    return F.when(F.length(stripped) > MIN_TEXT, stripped)


def with_post_text(df: DataFrame, page: str = "html", name: str = "post_text") -> DataFrame:
    """Post text of a page: the message with ranges, else a plain message, else the
    page description, else ''. Only pages without a message are searched for a
    description, and only descriptions cross to Python, to be unescaped."""
    message = F.coalesce(
        _message(F.col(page), MESSAGE_END_RANGES, 0), _message(F.col(page), MESSAGE_END, MIN_TEXT)
    )
    searched = df.withColumn("_message", message).withColumn(
        "_described",
        F.when(F.col("_message").isNull(), F.nullif(F.regexp_extract(F.col(page), OG_DESCRIPTION, 1), F.lit(""))),
    )
    described = F.regexp_replace(_unescape_html(F.col("_described")), r"^\s+|\s+$", "")
    return searched.withColumn(name, F.coalesce("_message", described, F.lit(""))).drop("_message", "_described")


def _first_match(col: Column, patterns) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(col, p, 1), F.lit("")) for p in patterns])


# Where ids stand in addresses and pages, most specific first.
GROUP_URL = (r"/groups/(\d+)", r"group_id=(\d+)", r"gid=(\d+)")
GROUP_HTML = (r"fb://group/(\d+)", r"fb://group/\?id=(\d+)", r'"group_id":"(\d+)"', r'"groupID":"(\d+)"')
POST_URL = (r"/groups/[^/]+/posts/(\d+)", r"/posts/(\d+)")
OG_URL = r'<meta property="og:url" content="([^"]+)"'
OG_POST = (r"/posts/(?:[^/]+/)?(\d+)", r"story_fbid=(\d+)")
STORY_ID = r'"storyID":"([^"]+)"'


def group_id(url: Column, page: Column | None = None) -> Column:
    """Group id of an address, else of the page behind it; NULL if neither has one."""
    from_url = _first_match(url, GROUP_URL)
    return from_url if page is None else F.coalesce(from_url, _first_match(page, GROUP_HTML))


def story_post_id(encoded: Column) -> Column:
    """Last part of a base64 story id; NULL unless it decodes to at least two parts."""
    parts = F.split(F.try_to_binary(encoded, F.lit("base64")).try_cast("string"), ":")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1))


def post_id(url: Column, page: Column | None = None) -> Column:
    """Post id of an address, else of the page: its story id, else its og:url."""
    from_url = _first_match(url, POST_URL)
    if page is None:
        return from_url
    story = story_post_id(F.nullif(F.regexp_extract(page, STORY_ID, 1), F.lit("")))
    og = F.replace(F.regexp_extract(page, OG_URL, 1), F.lit("&amp;"), F.lit("&"))
    return F.coalesce(from_url, story, _first_match(og, OG_POST))


def feedback_id(post: Column) -> Column:
    return F.base64(F.concat(F.lit("feedback:"), post).cast("binary"))


def stamp_ingestion(df: DataFrame, at) -> DataFrame:
    """``ingestion_date`` as ISO-8601 text."""
    return df.withColumn("ingestion_date", to_iso(F.lit(at).cast("timestamp")))
