"""Landed API pages, HTML and addresses. The raw documents are built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.moments import to_iso
from threadloom.operators import comments as C
from threadloom.operators import raw_pages as W
from threadloom.registry import adapters as a
from threadloom.registry.adapters import Tables
from threadloom.registry.comment_queries import TREE
from threadloom.registry.core import case

TURNS = f"t AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS replies FROM {a.duck(a.TURNS)})"


def _snippet():
    return F.struct(
        F.col("author_id").alias("authorDisplayName"), F.col("text").alias("textOriginal"),
        F.when(F.col("reactions") > 3, F.col("reactions")).alias("likeCount"),
        F.concat(F.col("ingestion_date").cast("string"), F.lit("T00:00:00Z")).alias("publishedAt"),
    )


def thread_pages(t: Tables) -> tuple[DataFrame, DataFrame]:
    """One page per chat with its first two replies inline, and reply pages of up to 100 replies."""
    reply = F.struct(F.col("comment_id").alias("id"), _snippet().alias("snippet"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", reply.alias("r")))))
    totals = t.turns.groupBy("conv_id").agg(F.count_if(F.col("turn") > 0).alias("total"))
    grouped = t.turns.where("turn <= 2").groupBy("video_id", "conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.struct(F.col("comment_id").alias("id"), _snippet().alias("s")))).alias("top"),
        ordered.alias("rs"),
    ).withColumn("rs", F.transform("rs", lambda x: x["r"])).join(totals, "conv_id")
    item = F.struct(
        F.col("top.id").alias("id"),
        F.struct(
            F.struct(F.col("top.s").alias("snippet")).alias("topLevelComment"), F.col("total").alias("totalReplyCount")
        ).alias("snippet"),
        F.struct(F.col("rs").alias("comments")).alias("replies"),
    )
    pages = grouped.select("video_id", F.to_json(F.struct(F.array(item).alias("items"))).alias("raw"))
    more = t.turns.where("turn > 0").groupBy("parent_id", F.floor(F.col("turn") / 100).alias("page_no")).agg(
        ordered.alias("rs")
    )
    return pages, more.select(
        "parent_id", F.to_json(F.struct(F.transform("rs", lambda x: x["r"]).alias("items"))).alias("raw")
    )


@case("prj_06_comment_threads", f"""WITH {TURNS} SELECT video_id, comment_id, parent_id, author_id AS author, text,
  CASE WHEN reactions > 3 THEN reactions ELSE 0 END::BIGINT AS likes,
  strftime(ingestion_date, '%Y-%m-%dT00:00:00Z') AS published_at, turn > 0 AS is_reply FROM t""")
def comment_threads(t: Tables):
    return W.flatten_comment_threads(*thread_pages(t))


SEARCH = """p AS (SELECT doc_id // 20 AS page_no, doc_id % 20 AS pos, cast(doc_id * 2 // 3 AS string) AS id, text, lang
  FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page_no, pos) AS rn FROM p)"""


def search(t: Tables) -> DataFrame:
    """Result pages of 20 posts; every third id comes twice."""
    post = F.struct(F.floor(F.col("doc_id") * 2 / 3).cast("string").alias("id"), "text", "lang")
    return t.table("documents").groupBy(F.floor(F.col("doc_id") / 20).alias("page_no")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", post.alias("p")))).alias("ps")
    ).select("page_no", F.to_json(F.struct(F.transform("ps", lambda x: x["p"]).alias("tweets"))).alias("raw"))


@case("prj_07_search_pages", f"WITH {SEARCH} SELECT page_no, id, text, lang FROM f WHERE rn = 1")
def search_pages(t: Tables):
    return W.normalize_search_pages(search(t), "id string, text string, lang string")


@case("sort_07_search_limit", f"WITH {SEARCH} SELECT page_no, id FROM f WHERE rn = 1 ORDER BY page_no, pos LIMIT 100")
def search_limit(t: Tables):
    return W.normalize_search_pages(search(t), "id string, text string, lang string", 100).select("page_no", "id")


def _story():
    total = F.struct(F.struct(F.col("reactions").alias("total_count")).alias("comments"))
    instance = F.struct(total.getField("comments").alias("comments")).alias("comment_rendering_instance")
    media = F.struct(F.when(F.col("reactions") % 7 == 0, "Video").otherwise("Photo").alias("__typename"))
    deep = F.struct(F.struct(F.struct(F.struct(F.struct(F.struct(instance).alias("feedback_target_with_context"))
        .alias("feedback_context")).alias("story")).alias("story_ufi_container")).alias("story"))
    to = F.struct(
        F.when(F.col("reactions") % 4 == 1, "Group").otherwise("User").alias("__typename"),
        F.concat(F.lit("Group "), F.col("comment_id")).alias("name"),
    )
    return F.struct(
        F.when(F.col("turn") == 5, "Ad").otherwise("Story").alias("__typename"),
        F.col("comment_id").alias("post_id"), F.concat(F.lit("https://g.example/"), "comment_id").alias("permalink_url"),
        F.struct(
            F.concat(F.lit("f"), "comment_id").alias("id"),
            F.when(F.col("reactions") % 2 == 0, instance.getField("comments")).alias("ignored"),
            F.when(F.col("reactions") % 2 == 0, F.struct(total.getField("comments").alias("comments")))
            .alias("comment_rendering_instance"),
        ).alias("feedback"),
        F.array(F.struct(
            F.when(F.col("turn") % 2 == 0, media).alias("media"),
            F.when(F.col("turn") % 2 == 1, F.struct(F.struct(media.alias("media")).alias("attachment"))).alias("styles"),
        )).alias("attachments"),
        F.struct(
            F.struct(F.struct(F.struct("text").alias("message")).alias("story")).alias("content"),
            F.struct(F.struct(F.struct(F.struct(F.struct(to.alias("to")).alias("story")).alias("title"))
                     .alias("comet_sections")).alias("story")).alias("context_layout"),
            F.when(F.col("reactions") % 3 == 1, deep).alias("feedback"),
        ).alias("comet_sections"),
    )


def feed_blocks(t: Tables) -> DataFrame:
    """Every turn is a story: each in a block of its own, or up to 50 of a chat as the stories of a group."""
    block_no = F.col("conv_id") * 1000 + F.when(F.col("conv_id") % 2 == 0, F.col("turn")).otherwise(
        F.floor(F.col("turn") / 50)
    )
    grouped = t.turns.groupBy("page_name", "conv_id", block_no.alias("block_no")).agg(
        F.array_sort(F.collect_list(F.struct("turn", _story().alias("s")))).alias("ss")
    ).withColumn("ss", F.transform("ss", lambda x: x["s"]))
    one = F.to_json(F.struct(F.get("ss", F.lit(0)).alias("node")))
    many = F.to_json(F.struct(F.struct(
        F.lit("Group").alias("__typename"),
        F.struct(F.transform("ss", lambda x: F.struct(x.alias("node"))).alias("edges")).alias("group_feed"),
    ).alias("node")))
    return grouped.select(
        F.col("page_name").alias("group_id"), "block_no",
        F.when(F.col("conv_id") % 2 == 0, one).otherwise(many).alias("raw"),
    )


FEED = f"""{TURNS}, story AS (SELECT page_name AS group_id, conv_id * 1000 + CASE WHEN conv_id % 2 = 0 THEN turn ELSE turn // 50 END AS block_no, turn, comment_id, text, reactions,
  CASE WHEN reactions % 2 = 0 OR reactions % 3 = 1 THEN reactions ELSE 0 END AS comment_count,
  CASE WHEN reactions % 4 = 1 THEN concat('Group ', comment_id) END AS own_name
  FROM t WHERE turn <> 5),
big AS (SELECT * FROM story WHERE comment_count >= 2),
feed AS (SELECT group_id, block_no, turn, comment_id AS post_id, concat('f', comment_id) AS feedback_id, text AS message, comment_count,
  (SELECT arg_min(own_name, (block_no, turn)) FROM big n WHERE n.group_id = b.group_id AND own_name IS NOT NULL
    AND (n.block_no, n.turn) <= (b.block_no, b.turn)) AS group_name, concat('https://g.example/', comment_id) AS permalink, reactions
  FROM big b)"""


@case("prj_08_group_feed", f"""WITH {FEED} SELECT * EXCLUDE (turn, reactions) FROM feed WHERE reactions % 7 <> 0""")
def group_feed(t: Tables):
    return W.extract_group_feed(feed_blocks(t), min_comments=2)


@case("sort_07_feed_limit", f"""WITH {FEED} SELECT post_id FROM feed WHERE reactions % 7 <> 0
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY block_no, turn) <= 5""")
def feed_limit(t: Tables):
    return W.extract_group_feed(feed_blocks(t), limit=5, min_comments=2).select("post_id")


def _node():
    return F.struct(
        F.struct(F.col("author_id").alias("id"), F.col("author_name").alias("name")).alias("author"),
        F.struct("text").alias("body"),
        F.struct(
            F.col("comment_id").alias("id"), F.concat(F.lit("https://g.example/"), "post_id", F.lit("/?ref=x")).alias("url"),
            F.struct(F.col("reactions").cast("string").alias("count_reduced")).alias("reactors"),
        ).alias("feedback"),
    )


def comment_pages(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pages of two comments (odd turns), and a reply page per answered comment (even turns)."""
    turns = t.turns
    edges = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", _node().alias("n")))), lambda x: F.struct(x["n"].alias("node"))
    )
    pages = turns.where("turn % 2 = 1").groupBy(
        F.concat(F.lit("f"), "post_id").alias("feedback_id"), F.floor(F.col("turn") / 4).alias("page_no")
    ).agg(edges.alias("edges")).select("feedback_id", "page_no", F.to_json(F.struct(F.struct(F.struct(F.struct(
        F.struct("edges").alias("comments")).alias("comment_rendering_instance_for_feed_location")).alias("node"))
        .alias("data"))).alias("raw"))
    opener = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string"))
    replies = turns.where("turn % 2 = 0 and turn > 0").groupBy(opener.alias("comment_feedback_id")).agg(
        edges.alias("edges")
    ).select("comment_feedback_id", F.lit(0).alias("page_no"), F.to_json(F.struct(F.struct(F.struct(
        F.struct("edges").alias("replies_connection")).alias("node")).alias("data"))).alias("raw"))
    return pages, replies


@case("prj_09_comment_pages", f"""WITH {TURNS} SELECT concat('f', post_id) AS feedback_id, author_id, author_name,
  concat('https://www.facebook.com/profile.php?id=', author_id) AS author_url, text, cast(reactions AS string) AS reaction_count,
  comment_id AS comment_feedback_id, concat('https://g.example/', post_id, '/') AS permalink FROM t WHERE turn % 2 = 1""")
def comment_page_rows(t: Tables):
    return W.comment_rows(comment_pages(t)[0]).drop("page_no", "pos")


def nested_posts(t: Tables, part_size: int = 1000) -> DataFrame:
    pages, replies = comment_pages(t)
    feed = t.turns.where("turn = 0").select(
        "post_id", F.when(F.col("reactions") > 2, F.concat(F.lit("f"), "post_id")).alias("feedback_id"),
        F.col("text").alias("message"), F.col("reactions").alias("comment_count"), F.col("page_name").alias("group_name"),
        F.concat(F.lit("https://groups.example/"), "post_id").alias("permalink"),
    )
    return W.nest_post_comments(feed, W.comment_rows(pages), W.reply_rows(replies), part_size)


@case("prj_10_posts_without_feedback", f"""WITH {TURNS} SELECT post_id, 'group' AS source_type, page_name, text,
  CASE WHEN reactions > 2 THEN concat('f', post_id) END AS feedback_id,
  CASE WHEN reactions > 2 THEN (replies + 1) // 2 ELSE reactions END AS comment_count,
  concat('https://groups.example/', post_id) AS permalink, 0 AS part,
  CASE WHEN reactions > 2 THEN (replies + 1) // 2 ELSE 0 END AS comments FROM t WHERE turn = 0""")
def posts_without_feedback(t: Tables):
    return nested_posts(t).withColumn("comments", F.size("comments"))


@case("prj_09_nest_then_flatten", f"""WITH {TREE} SELECT comment_id, tree.post_id, author_id, text, is_reply, parent_comment_id FROM tree
  JOIN (SELECT post_id FROM turns WHERE turn = 0 AND reactions > 2) k ON tree.post_id = k.post_id""")
def nest_then_flatten(t: Tables):
    raw = nested_posts(t, part_size=1).withColumn("ingestion_date", F.lit("2024-01-01T00:00:00Z"))
    return C.flatten_comment_tree(raw, keep_empty=False).select(
        "comment_id", "post_id", "author_id", "text", "is_reply", "parent_comment_id"
    )


def text_pages(t: Tables) -> DataFrame:
    """The pages, with their title once more as message, plain message or description, or not at all."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    json_title = F.to_json(F.struct(title.alias("text")))
    message = F.concat(F.lit('<script>{"x":1,"message":'), json_title)
    extra = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.regexp_replace(message, r"\}$", ',"ranges":[]}'), F.lit("}</script>")))
        .when(F.col("page_id") % 4 == 1, F.concat(message, F.lit("}</script>")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit('<META property="og:description" content="'), title, F.lit('">')))
        .otherwise(F.lit(""))
    )
    return t.table("pages").select("page_id", "url", F.concat("html", extra).alias("html"))


@case("prj_11_post_text", """WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT page_id, CASE WHEN page_id % 4 < 2 THEN CASE WHEN length(trim(title)) > 10 THEN trim(title) ELSE '' END
  WHEN page_id % 4 = 2 AND length(title) >= 5 AND title NOT LIKE '%''%' AND title NOT LIKE '%"%'
  THEN trim(regexp_replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g')) ELSE '' END AS post_text FROM p""")
def post_text(t: Tables):
    return W.with_post_text(text_pages(t)).select("page_id", "post_text")


ADDRESS = """SELECT page_id, number, CASE page_id % 6 WHEN 0 THEN concat('https://s.example/groups/', number, '/posts/', page_id)
  WHEN 1 THEN concat('https://s.example/x?group_id=', number) WHEN 2 THEN concat('https://s.example/posts/', number)
  WHEN 3 THEN concat('https://s.example/?gid=', number) ELSE url END AS address, html
FROM (SELECT page_id, url, html, regexp_extract(url, '([0-9]+)', 1) AS number FROM {pages}) p"""


def addressed(t: Tables) -> DataFrame:
    """Addresses of several shapes; the pages behind the others carry ids in their source."""
    n = F.col("number")
    story = F.base64(F.concat(F.lit("S:_I1:VK:"), n).cast("binary"))
    extra = (
        F.when(F.col("page_id") % 6 == 4, F.concat(F.lit('"groupID":"'), n, F.lit('","storyID":"'), story, F.lit('"')))
        .when(F.col("page_id") % 6 == 5, F.concat(
            F.lit('<meta property="og:url" content="https://s.example/p?a=1&amp;story_fbid='), n, F.lit('">')))
        .otherwise(F.lit(""))
    )
    return t.view(ADDRESS).withColumn("html", F.concat("html", extra))


@case("prj_12_ids_from_urls", f"""SELECT page_id, CASE WHEN page_id % 6 IN (0, 1, 3, 4) THEN number END AS group_id,
  CASE page_id % 6 WHEN 0 THEN cast(page_id AS string) WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE number END AS post_id
FROM {a.duck(ADDRESS)}""")
def ids(t: Tables):
    return addressed(t).select(
        "page_id", W.group_id(F.col("address"), F.col("html")).alias("group_id"),
        W.post_id(F.col("address"), F.col("html")).alias("post_id"),
    )


@case("prj_13_feedback_id", "SELECT page_id, to_base64(encode(concat('feedback:', cast(page_id AS string)))) AS feedback_id FROM pages")
def feedback(t: Tables):
    return t.table("pages").select("page_id", W.feedback_id(F.col("page_id").cast("string")).alias("feedback_id"))


@case("prj_14_ingestion_stamp", "SELECT page_id, url, '2024-05-28T00:00:00Z' AS ingestion_date FROM pages")
def stamp(t: Tables):
    return W.stamp_ingestion(t.table("pages").select("page_id", "url"), "2024-05-28 00:00:00")


@case("prj_21_iso_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events")
def iso(t: Tables):
    return t.table("events").select("event_id", to_iso(F.col("ts").cast("timestamp")).alias("ts"))
