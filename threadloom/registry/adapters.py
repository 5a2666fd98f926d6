"""Views that give the test tables the shape of posts, comments, insights and runs.

Each flat view is SQL text both engines run, so that a query and its check
start from the same rows. ``{documents}`` etc. stand for the tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.catalogue import Brand, Lexicon, Vocabulary

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

BRANDS = (
    Brand("b1", "Heble", "Heble Co", "FR", "A", ("heble", "nterti")),
    Brand("b2", "Anat", "Anat AG", "DE", "B", ("anat",)),
    Brand("b3", "Sich", "Sich GmbH", "DE", "B", ("sich", "nicht")),
    Brand("b4", "Pour", "Pour SA", "FR", "A", ("pour",)),
    Brand("b5", "Signup", "Signup Inc", "US", "C", ("signup",)),
)
LEXICON = Lexicon(positive=("here", "reon", "pour"), negative=("annd", "einach", "nicht"), whole_words=False)
STANCE = Lexicon(positive=("the", "que"), negative=("nicht", "ent"), whole_words=False)
VOCABULARY = Vocabulary(
    entities=("view", "click", "signup", "purchase"), aspects=("a0", "a1", "a2", "a3", "a4", "a5"),
    entity_field="model_entity",
)
AS_OF = "2024-02-01 00:00:00"

POSTS = """
SELECT cast(d.doc_id AS string) AS id,
  CASE WHEN e.event_type = 'purchase' THEN 'retweet' ELSE 'tweet' END AS type,
  concat('https://posts.example/', cast(d.doc_id AS string)) AS url,
  d.text AS text, d.source AS source, d.lang AS lang,
  e.k - 1 AS "retweetCount", nullif(e.k % 17, 16) AS "replyCount", e.k * 3 AS "likeCount", e.k % 5 AS "quoteCount",
  date_trunc('second', cast(e.ts AS timestamp)) AS stamp,
  e.event_type = 'error' AND e.k % 10 = 9 AS bad_stamp,
  CASE WHEN e.k % 3 = 0 THEN concat('r', cast(e.k AS string)) END AS "inReplyToId",
  cast(e.user_id AS string) AS author_id, concat('user', cast(e.user_id AS string)) AS author_username,
  e.user_id % 4 = 0 AS author_is_blue_verified,
  cast((e.user_id * 7919) % 2000 AS int) AS author_followers, cast(e.user_id % 25 AS int) AS author_following,
  cast((e.user_id * 104729) % 120000 AS int) AS author_statuses_count,
  e.k = 99 AS no_author_stamp,
  CASE WHEN e.k % 5 > 0 THEN split(concat(e.event_type, ',', d.source), ',') END AS hashtags,
  CASE WHEN e.k % 2 = 0 THEN split(concat('m', cast(e.k AS string)), ',') END AS mentioned_user_ids,
  cast(cast(e.ts AS date) AS string) AS ingestion_date, d.doc_id, e.k
FROM {documents} d JOIN (
  SELECT event_id, ts, user_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM {events}
) e ON d.doc_id = e.event_id
"""

# One chat is one group post (turn 0) with comments: odd turns open, even turns answer the turn before.
TURNS = """
SELECT concat('p', cast(conv_id AS string)) AS post_id, concat('page', cast(conv_id % 5 AS string)) AS page_name,
  concat('v', cast(conv_id % 4 AS string)) AS video_id,
  conv_id, turn, role, concat(role, '-', cast(conv_id % 40 AS string)) AS author_id, role AS author_name, text,
  cast((conv_id * 7 + turn * 5) % 23 AS int) AS reactions,
  cast(date '2024-01-01' + cast(conv_id % 7 AS int) AS date) AS ingestion_date,
  concat('c', cast(conv_id AS string), '-', cast(turn AS string)) AS comment_id,
  CASE WHEN turn > 0 THEN concat('c', cast(conv_id AS string), '-0') END AS parent_id
FROM {conversations}
"""

VIDEO = """
SELECT video_id, conv_id, turn, comment_id, parent_id, author_id AS author,
  concat(text, CASE (conv_id + turn) % 4 WHEN 0 THEN ' my iPhone' WHEN 1 THEN ' android or iOS'
    WHEN 2 THEN ' Android' ELSE '' END) AS text,
  cast(reactions - 1 AS bigint) AS likes, turn > 0 AS is_reply,
  CASE WHEN (conv_id + turn) % 50 = 49 THEN 'unknown'
    ELSE concat(cast(ingestion_date AS string), 'T0', cast(turn AS string), ':30:00Z') END AS published_at
FROM (""" + TURNS + """) t
"""

INSIGHTS = """
SELECT cast(user_id AS string) AS post_id, concat('t', cast(user_id AS string)) AS thread_id,
  concat('v', cast(user_id % 4 AS string)) AS video_id, concat('page', cast(user_id % 5 AS string)) AS page_name,
  event_id, event_type AS model_entity, concat('a', cast(k % 7 AS string)) AS aspect,
  CASE k % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 3 THEN 'mixed'
    ELSE 'angry' END AS sentiment,
  CASE k % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' WHEN 2 THEN 'mild' ELSE 'huge' END AS intensity,
  cast(k % 6 AS int) AS mention_count, concat('says ', cast(event_id AS string)) AS evidence,
  cast(ts AS date) AS ingestion_date
FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM {events}) e
"""

ACTIVITY = """
SELECT cast(event_id AS string) AS comment_id, CASE WHEN event_type = 'view' THEN '' ELSE cast(user_id AS string)
  END AS author_id, cast(ts AS date) AS ingestion_date,
  event_type = 'click' AS is_reply, cast(floor(value) AS int) AS reaction_count
FROM {events}
"""

RUNS = """
SELECT cast(o_orderkey AS string) AS run_id, o_orderpriority AS job,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS state,
  CASE WHEN o_orderstatus <> 'P' THEN cast(o_orderdate AS timestamp) END AS start_date,
  cast(o_orderdate AS timestamp) AS logical_date,
  cast(floor(o_totalprice) AS bigint) AS seconds, o_custkey % 7 AS task_no, o_custkey
FROM {orders}
"""

LABELLED = """
SELECT d.doc_id, d.text, l.quality,
  CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS label
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""


def duck(view: str) -> str:
    """The view as a DuckDB subquery."""
    return "(" + view.format(**{t: t for t in TABLES}).strip() + ")"


class Tables:
    """The test tables of one scale, and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text.replace('"', "`"), **used)

    @cached_property
    def posts(self) -> DataFrame:
        return self.view(POSTS)

    @cached_property
    def turns(self) -> DataFrame:
        return self.view(TURNS)

    @cached_property
    def raw_posts(self) -> DataFrame:
        """Nested records. Two records in five quote a post; three documents share one quoted id."""
        p = self.posts
        legacy = F.concat_ws(
            " ", F.date_format("stamp", "EEE MMM dd HH:mm:ss"), F.lit("+0000"), F.date_format("stamp", "yyyy")
        )
        created = F.when(F.col("bad_stamp"), F.lit("n/a")).otherwise(legacy)
        author = F.struct(
            F.col("author_username").alias("userName"), F.col("author_id").alias("id"),
            F.col("author_is_blue_verified").alias("isBlueVerified"), F.col("author_followers").alias("followers"),
            F.col("author_following").alias("following"), F.col("author_statuses_count").alias("statusesCount"),
            F.when(~F.col("no_author_stamp"), legacy).alias("createdAt"),
        )
        entities = F.struct(
            F.transform("mentioned_user_ids", lambda m: F.struct(m.alias("id_str"))).alias("user_mentions"),
            F.transform("hashtags", lambda h: F.struct(h.alias("text"), F.array(F.lit(0), F.lit(1)).alias("indices")))
            .alias("hashtags"),
        )
        null = F.lit(None).cast("string")

        def record(id_col, url, kind: str):
            return [
                F.col("type"), id_col.alias("id"), url.alias("url"), F.col("text"), F.col("source"),
                *[F.col(c).cast(kind).alias(c) for c in ("retweetCount", "replyCount", "likeCount", "quoteCount")],
                created.alias("createdAt"), F.col("lang"), F.col("inReplyToId"),
                null.alias("conversationId"), null.alias("inReplyToUserId"), null.alias("inReplyToUsername"),
                author.alias("author"), entities.alias("entities"),
            ]

        quoted_id = F.concat(F.lit("q"), F.floor(F.col("doc_id") / 3).cast("string"))
        quoted = F.struct(*record(quoted_id, F.concat("url", F.lit("?q")), "int"))
        return p.select(
            *record(F.col("id"), F.col("url"), "bigint"),
            F.when(F.col("k") % 5 < 2, quoted).alias("quoted_tweet"), F.col("ingestion_date"),
        )

    @cached_property
    def raw_groups(self) -> DataFrame:
        """Posts with nested comments and replies. A chat of very many turns becomes several records
        of its post, of up to 500 comments each; every comment has at most one reply."""
        node = ["author_id", "author_name", "author_url", "text", "reaction_count"]
        t = self.turns.withColumn("reaction_count", F.col("reactions").cast("string")).withColumn(
            "author_url", F.concat(F.lit("https://people.example/"), "author_id")
        )
        opener = (F.floor((F.col("turn") + 1) / 2)).cast("int")
        rows = t.where("turn > 0").withColumn("root_no", opener)
        replies = rows.where("turn % 2 = 0").groupBy("post_id", (F.col("root_no")).alias("root_no")).agg(
            F.collect_list(F.struct(*node)).alias("replies")
        )
        roots = rows.where("turn % 2 = 1").join(replies, ["post_id", "root_no"], "left")
        sizes = rows.where("turn % 2 = 1").groupBy("post_id").agg(F.count("*").alias("n"))
        comments = roots.groupBy("post_id", F.floor(F.col("root_no") / 500).alias("part")).agg(
            F.sort_array(F.collect_list(F.struct(
                "root_no", *node, F.lit(None).cast("string").alias("parent_comment_id"), "replies",
            ))).alias("c")
        )
        posts = t.where("turn = 0").join(sizes, "post_id", "left").join(comments, "post_id", "left")
        return posts.select(
            "post_id", F.lit("group").alias("source_type"), "page_name", "text",
            F.concat(F.lit("f"), "post_id").alias("feedback_id"),
            F.coalesce("n", F.lit(0)).cast("int").alias("comment_count"),
            F.concat(F.lit("https://groups.example/"), "post_id").alias("permalink"),
            F.concat(F.col("ingestion_date").cast("string"), F.lit("T10:00:00Z")).alias("ingestion_date"),
            F.transform("c", lambda x: x.dropFields("root_no")).alias("comments"),
        )

    @cached_property
    def raw_video(self) -> DataFrame:
        return self.view(VIDEO).drop("conv_id", "turn")
