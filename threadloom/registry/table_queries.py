"""Sources, sinks, merges, whole plans and streams: each writes to the shared folder and reads back."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import contracts
from threadloom.catalogue import Vocabulary
from threadloom.operators import posts as P
from threadloom.operators.scoring import score_text
from threadloom.plans import group, landing, short_posts, video
from threadloom.registry import adapters as a
from threadloom.registry import sqltext as s
from threadloom.registry.adapters import Tables
from threadloom.registry.comment_queries import (
    BURST, CONTEXT, DAY, SCORED, STANCE, THREADS, VSTANCE, documents, page_daily_sql, sentiment, stance_rows, tree,
)
from threadloom.registry.core import case
from threadloom.registry.insight_queries import ITEMS, items, lines_as_items
from threadloom.registry.page_queries import comment_pages, feed_blocks, thread_pages
from threadloom.registry.post_queries import TOP, analytics, scored, silver
from threadloom.session import fresh_dir
from threadloom.sources import catalog, tables, writers
from threadloom.streaming import streams

VIDEOS = ("v0", "v1", "v2", "v3")
POSTS = f"p AS (SELECT * FROM {a.duck(a.POSTS)})"


def landed_posts(t: Tables) -> str:
    """Raw posts landed as gzip JSON under the day they came in."""
    path = fresh_dir(t.spark, "bronze")
    writers.land_bronze(t.raw_posts, path, F.col("ingestion_date").cast("timestamp"), max_records=300)
    return path


@case("src_01_read_bronze", f"""WITH {POSTS} SELECT id, text, "likeCount", array_to_string(hashtags, ',') AS hashtags, ingestion_date FROM p""")
def read_bronze(t: Tables):
    raw = tables.read_bronze(t.spark, landed_posts(t), "posts")
    return P.flatten_posts(raw).select("id", "text", "likeCount", "hashtags", "ingestion_date")


@case("snk_01_files_by_bytes", f"""WITH {POSTS} SELECT id, text, "likeCount", array_to_string(hashtags, ',') AS hashtags, ingestion_date FROM p""")
def files_by_bytes(t: Tables):
    path = fresh_dir(t.spark, "bronze")
    writers.land_in_files(t.raw_posts, path, F.col("ingestion_date").cast("timestamp"), max_bytes=100_000)
    raw = tables.read_bronze(t.spark, path, "posts")
    return P.flatten_posts(raw).select("id", "text", "likeCount", "hashtags", "ingestion_date")


@case("src_02_latest_bronze", f"""WITH {POSTS} SELECT id, ingestion_date FROM p WHERE ingestion_date = (SELECT max(ingestion_date) FROM p)""")
def latest_bronze(t: Tables):
    return tables.read_latest_bronze(t.spark, landed_posts(t), "posts").select("id", "ingestion_date")


@case("src_03_latest_partition", f"""WITH {POSTS} SELECT DISTINCT cast(substr(d, 1, 4) AS BIGINT) AS year, cast(substr(d, 6, 2) AS BIGINT) AS month,
  cast(substr(d, 9, 2) AS BIGINT) AS day FROM (SELECT max(ingestion_date) AS d FROM p)""")
def latest_partition(t: Tables):
    path = landed_posts(t)
    rows = tables.with_partitions(t.spark, path, "posts")
    newest = tables.only_partition(rows, tables.latest_partition(t.spark, path))
    return writers.touched_partitions(newest, ["year", "month", "day"])


@case("snk_01_land_bronze", f"""WITH {POSTS} SELECT ingestion_date, count(*) AS n FROM p GROUP BY 1""")
def land_bronze(t: Tables):
    rows = tables.with_partitions(t.spark, landed_posts(t), "posts")
    day = F.date_format(F.make_date("year", "month", "day"), "yyyy-MM-dd")
    return rows.groupBy(day.alias("ingestion_date")).agg(F.count("*").alias("n"))


@case("snk_12_partition_path", f"""WITH {POSTS} SELECT DISTINCT concat('year=', substr(ingestion_date, 1, 4), '/month=', substr(ingestion_date, 6, 2),
  '/day=', substr(ingestion_date, 9, 2), '/') AS path FROM p""")
def partition_path(t: Tables):
    days = t.posts.withColumns(writers.day_columns(F.col("ingestion_date").cast("timestamp")))
    return days.select(writers.partition_path(days, ["year", "month", "day"]).alias("path")).distinct()


def silver_table(t: Tables) -> str:
    path = fresh_dir(t.spark, "silver")
    writers.write_table(silver(t), path)
    return path


SILVER_OUT = "id, author_id, \"likeCount\", strftime(created_at_ts, '%Y-%m-%d %H:%M:%S') AS created_at_ts"
OUT = ["id", "author_id", "likeCount", "created_at_ts"]


@case("src_04_read_silver", f"WITH {s.SILVER} SELECT {SILVER_OUT} FROM silver")
def read_silver(t: Tables):
    return tables.read_table(t.spark, silver_table(t)).select(*OUT)


@case("src_05_latest_silver", f"""WITH {s.SILVER} SELECT {SILVER_OUT} FROM silver
  WHERE CAST(created_at_ts AS DATE) = (SELECT max(CAST(created_at_ts AS DATE)) FROM silver)""")
def latest_silver(t: Tables):
    return tables.read_latest(t.spark, silver_table(t)).select(*OUT)


def by_day(t: Tables) -> str:
    path = fresh_dir(t.spark, "comments")
    writers.write_table(tree(t), path, ["ingestion_date"])
    return path


@case("src_07_read_day", f"WITH {SCORED} SELECT comment_id, {DAY} AS ingestion_date FROM tree WHERE ingestion_date = DATE '2024-01-04'")
def read_day(t: Tables):
    return tables.read_day(t.spark, by_day(t), "2024-01-04").select("comment_id", "ingestion_date")


@case("src_08_read_entity", f"SELECT comment_id, video_id FROM {a.duck(a.VIDEO)} WHERE video_id = 'v2'")
def read_entity(t: Tables):
    path = fresh_dir(t.spark, "video")
    writers.write_table(t.raw_video, path, ["video_id"])
    return tables.read_entity(t.spark, path, "v2").select("comment_id", "video_id")


@case("src_09_optional_table", f"WITH {SCORED} SELECT comment_id FROM tree")
def optional_table(t: Tables):
    missing = tables.read_or_empty(t.spark, fresh_dir(t.spark, "missing"), "comment_id string")
    present = tables.read_or_empty(t.spark, by_day(t), "comment_id string").select("comment_id")
    return present.unionByName(missing)


@case("src_10_report_prefix", f"WITH {SCORED} SELECT page_name, count(*) AS n FROM tree GROUP BY 1")
def report_prefix(t: Tables):
    assert tables.read_if_present(t.spark, fresh_dir(t.spark, "missing")) is None
    return tables.read_if_present(t.spark, by_day(t)).groupBy("page_name").agg(F.count("*").alias("n"))


@case("src_11_thread_documents", f"WITH {THREADS} SELECT thread_id, video_id, brand_comment_count, comment_id, brand_mentioned, text FROM docs")
def thread_documents(t: Tables):
    path = fresh_dir(t.spark, "threads")
    writers.write_threads(documents(t), path)
    rows = tables.read_threads(t.spark, path).select("*", F.explode("comments").alias("c"))
    return rows.select("thread_id", "video_id", "brand_comment_count", "c.comment_id", "c.brand_mentioned", "c.text")


@case("src_12_json_lines", "SELECT text FROM documents WHERE text <> ''")
def json_lines(t: Tables):
    path = fresh_dir(t.spark, "lines")
    broken = F.when(F.col("doc_id") % 10 == 0, F.lit('{"content": "cut off')).when(F.col("doc_id") % 10 == 1, F.lit(""))
    lines = F.array_compact(F.array(F.to_json(F.struct(F.col("text").alias("content"))), broken))
    t.table("documents").select(F.explode(lines).alias("value")).write.text(path)
    return tables.read_json_text(t.spark, path)


@case("src_13_labelled_csv", f"SELECT text, {s.label('text')} AS sentiment_label FROM documents")
def labelled_csv(t: Tables):
    path = fresh_dir(t.spark, "csv")
    writers.write_text_csv(score_text(t.table("documents"), lexicon=a.LEXICON).select("text", "sentiment_label"), path)
    return tables.read_labelled_csv(t.spark, path)


@case("snk_02_write_partitioned", f"WITH {s.ANALYTICS} SELECT strftime(created_at_ts, '%Y-%m-%d') AS date, primary_brand, count(*) AS n FROM analytics GROUP BY 1, 2")
def write_partitioned(t: Tables):
    path = fresh_dir(t.spark, "facts")
    writers.write_table(P.fact_posts(scored(t)), path, ["date", "primary_brand"])
    return tables.read_table(t.spark, path).groupBy("date", "primary_brand").agg(F.count("*").alias("n"))


@case("snk_03_small_dimension", f"WITH {s.ANALYTICS} SELECT primary_brand, count(*) AS n FROM analytics GROUP BY 1")
def small_dimension(t: Tables):
    path = fresh_dir(t.spark, "dim")
    writers.write_small_table(analytics(t).groupBy("primary_brand").agg(F.count("*").alias("n")), path)
    return tables.read_table(t.spark, path)


@case("snk_04_dynamic_overwrite", f"""WITH {ITEMS} SELECT {DAY} AS ingestion_date, model_entity, event_id + CASE WHEN dayofmonth(ingestion_date) = 5
  THEN 1000000 ELSE 0 END AS event_id FROM items""")
def dynamic_overwrite(t: Tables):
    path = fresh_dir(t.spark, "overwrite")
    rows = items(t).select("ingestion_date", "model_entity", "event_id")
    writers.write_table(rows, path, ["ingestion_date"])
    changed = rows.where(F.day("ingestion_date") == 5).withColumn("event_id", F.col("event_id") + 1_000_000)
    writers.write_table(changed, path, ["ingestion_date"])
    return tables.read_table(t.spark, path).select("ingestion_date", "model_entity", "event_id")


@case("snk_05_merge_twice", f"""WITH {ITEMS} SELECT {DAY} AS ingestion_date, model_entity, mention_count + CASE WHEN event_type = 'click'
  THEN 100 ELSE 0 END AS mention_count, event_id FROM (SELECT *, model_entity AS event_type FROM items)""")
def merge_twice(t: Tables):
    path = fresh_dir(t.spark, "merged")
    rows = items(t).select("event_id", "ingestion_date", "model_entity", "mention_count")
    update = rows.where("model_entity = 'click'").withColumn("mention_count", F.col("mention_count") + 100)
    for batch in (rows, update, update):
        writers.merge_partitions(t.spark, batch, path, ["event_id"], ["mention_count"], ["ingestion_date"])
    return tables.read_table(t.spark, path).select("ingestion_date", "model_entity", "mention_count", "event_id")


# A key is in the last batch that has it: on its first day, on the next day (every third), or gone back in a third batch (every sixth).
MOVES = ITEMS + """, moved AS (SELECT event_id, model_entity, mention_count + CASE WHEN event_id % 3 = 0 THEN 10 ELSE 0 END
    + CASE WHEN event_id % 6 = 0 THEN 10 ELSE 0 END AS mention_count,
  CAST(ingestion_date + CASE WHEN event_id % 3 = 0 AND event_id % 6 <> 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS DATE) AS ingestion_date FROM items)"""


@case("snk_05_moved_keys", f"WITH {MOVES} SELECT event_id, model_entity, mention_count, {DAY} AS ingestion_date FROM moved")
def moved_keys(t: Tables):
    """Keys that change their partition, and some of them back, are in one place only."""
    path = fresh_dir(t.spark, "moved")
    rows = items(t).select("event_id", "ingestion_date", "model_entity", "mention_count")
    third, sixth = rows.where("event_id % 3 = 0"), rows.where("event_id % 6 = 0")
    later = third.withColumns({"ingestion_date": F.date_add("ingestion_date", 1), "mention_count": F.col("mention_count") + 10})
    back = sixth.withColumn("mention_count", F.col("mention_count") + 20)
    for batch in (rows, later, back, back):
        writers.merge_partitions(t.spark, batch, path, ["event_id"], ["mention_count"], ["ingestion_date"])
    return tables.read_table(t.spark, path).select("event_id", "model_entity", "mention_count", "ingestion_date")


@case("snk_13_replaced_groups", f"""WITH {ITEMS} SELECT post_id, {DAY} AS ingestion_date, aspect, count(*) AS n FROM items
  WHERE CAST(post_id AS BIGINT) % 3 <> 0 OR (aspect = 'a1' AND CAST(post_id AS BIGINT) % 6 = 0) GROUP BY ALL""")
def replaced_groups(t: Tables):
    """Posts divisible by three get a new set of rows: some of their former ones, or none at all."""
    path = fresh_dir(t.spark, "groups")
    rows = items(t).select("post_id", "ingestion_date", "aspect", "event_id")
    number = F.col("post_id").cast("bigint")
    again = rows.where(number % 3 == 0)
    writers.replace_groups(t.spark, rows, rows, path, ["post_id"], ["ingestion_date"])
    for _ in range(2):
        writers.replace_groups(
            t.spark, again.where((F.col("aspect") == "a1") & (number % 6 == 0)), again, path, ["post_id"], ["ingestion_date"])
    return tables.read_table(t.spark, path, rows.schema).groupBy("post_id", "ingestion_date", "aspect").agg(F.count("*").alias("n"))


@case("src_16_listed_partitions", f"""WITH {ITEMS} SELECT event_id, model_entity, {DAY} AS ingestion_date FROM items
  WHERE (day(ingestion_date), model_entity) IN ((1, 'view'), (9, 'click'), (20, 'view'))""")
def listed_partitions(t: Tables):
    """Partitions of two levels that are far apart, and not those between or across."""
    path = fresh_dir(t.spark, "listed")
    rows = items(t).select("event_id", "model_entity", "ingestion_date")
    writers.write_table(rows, path, ["ingestion_date", "model_entity"])
    day = F.day("ingestion_date")
    wanted = rows.where(
        ((day == 1) & (F.col("model_entity") == "view")) | ((day == 9) & (F.col("model_entity") == "click"))
        | ((day == 20) & (F.col("model_entity") == "view")))
    found = tables.in_partitions(tables.read_table(t.spark, path, rows.schema), wanted.select("ingestion_date", "model_entity"))
    return found.select("event_id", "model_entity", "ingestion_date")


@case("snk_06_register_table", f"WITH {ITEMS} SELECT model_entity, {DAY} AS ingestion_date, count(*) AS n FROM items GROUP BY 1, 2")
def register(t: Tables):
    path = fresh_dir(t.spark, "registered")
    rows = items(t).select("event_id", "model_entity", "ingestion_date")
    writers.write_table(rows, path, ["ingestion_date"])
    name = "loom_checks.items_" + path.rsplit("-", 1)[1]
    catalog.ensure_database(t.spark, "loom_checks", fresh_dir(t.spark, "db"))
    catalog.register_table(t.spark, name, rows, path, ["ingestion_date"])
    catalog.register_table(t.spark, name, rows, path, ["ingestion_date"])
    return t.spark.table(name).groupBy("model_entity", "ingestion_date").agg(F.count("*").alias("n"))


@case("snk_06_register_in_place", f"WITH {ITEMS} SELECT model_entity, {DAY} AS ingestion_date, count(*) AS n, count(evidence) AS quoted FROM items GROUP BY 1, 2")
def register_in_place(t: Tables):
    """An entry gets a column at its end in place, and a quote in a partition's value is a value like others."""
    path = fresh_dir(t.spark, "it's registered")
    rows = items(t).select("event_id", "model_entity", "evidence", F.concat(F.lit("it's "), F.col("ingestion_date").cast("string")).alias("day"))
    name = "loom_checks.place_" + path.rsplit("-", 1)[1]
    catalog.ensure_database(t.spark, "loom_checks", fresh_dir(t.spark, "db"))
    writers.write_table(rows.drop("evidence"), path, ["day"])
    catalog.register_table(t.spark, name, rows.drop("evidence"), path, ["day"])
    t.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('kept' = 'yes')")
    writers.write_table(rows, path, ["day"])
    catalog.register_table(t.spark, name, rows.select("event_id", "model_entity", "evidence", "day"), path, ["day"])
    days = [{"day": r["day"]} for r in rows.select("day").distinct().collect()]
    catalog.replace_partitions(t.spark, name, days, chunk=7)
    kept = t.spark.sql(f"SHOW TBLPROPERTIES {name}").where("key = 'kept'").count()
    found = t.spark.table(name).groupBy("model_entity", F.substring("day", 6, 10).alias("ingestion_date")).agg(
        F.count("*").alias("n"), F.count("evidence").alias("quoted"))
    return found.where(F.lit(kept == 1))


@case("snk_09_touched_partitions", f"WITH {ITEMS} SELECT DISTINCT {DAY} AS ingestion_date, page_name FROM items")
def touched(t: Tables):
    return writers.touched_partitions(items(t), ["ingestion_date", "page_name"])


@case("snk_10_full_refresh", f"WITH {ITEMS} SELECT event_id, model_entity FROM items WHERE model_entity <> 'view'")
def full_refresh(t: Tables):
    path = fresh_dir(t.spark, "refresh")
    rows = items(t).select("event_id", "model_entity")
    writers.replace_table(rows, path, ["model_entity"])
    writers.replace_table(rows.where("model_entity <> 'view'"), path, ["model_entity"])
    return tables.read_table(t.spark, path).select("event_id", "model_entity")


@case("snk_11_write_threads", f"WITH {THREADS} SELECT thread_id, brand_comment_count, count(*) AS comments FROM docs GROUP BY 1, 2")
def write_threads(t: Tables):
    path = fresh_dir(t.spark, "threads")
    writers.write_threads(documents(t), path)
    return tables.read_threads(t.spark, path).groupBy("thread_id", "brand_comment_count").agg(
        F.sum(F.size("comments")).alias("comments")
    )


@case("set_05_raw_dedup", f"WITH {POSTS} SELECT id, \"likeCount\", count(*) AS n FROM p GROUP BY 1, 2")
def raw_dedup(t: Tables):
    path = landed_posts(t)
    writers.land_bronze(t.raw_posts, path, "2024-03-01 00:00:00")
    raw = tables.read_raw_with_origin(t.spark, path, "posts")
    return landing.without_repeats(raw).groupBy("id", "likeCount").agg(F.count("*").alias("n"))


@case("set_06_compact_silver", f"WITH {s.SILVER} SELECT {SILVER_OUT} FROM silver")
def compact(t: Tables):
    path = silver_table(t)
    writers.write_table(silver(t), path, mode="append")
    writers.compact_duplicates(t.spark, path, ["id"], ["ingestion_date"], ["year", "month", "day"])
    return tables.read_table(t.spark, path).select(*OUT)


@case("inc_01_full_then_incremental", f"WITH {s.SILVER} SELECT {SILVER_OUT} FROM silver")
def full_then_incremental(t: Tables):
    bronze, path = landed_posts(t), fresh_dir(t.spark, "silver")
    short_posts.build_silver(t.spark, bronze, path)
    short_posts.build_silver(t.spark, bronze, path, incremental=True)
    return tables.read_table(t.spark, path).select(*OUT)


def gold_posts(t: Tables) -> str:
    silver_path, gold = silver_table(t), fresh_dir(t.spark, "gold")
    for latest_only in (False, True):
        short_posts.build_gold(
            t.spark, silver_path, gold, a.AS_OF, a.BRANDS, lexicon=a.LEXICON, window_days=10,
            latest_only=latest_only, viral_threshold=s.VIRAL,
        )
    return gold


@case("inc_04_gold_posts", f"""WITH {s.ANALYTICS}, x AS (SELECT CAST(created_at_ts AS DATE) AS date, unnest(all_brands) AS brand_name,
  coalesce(lang, 'unknown') AS lang, author_id, engagement_score FROM analytics)
SELECT strftime(date, '%Y-%m-%d') AS date, brand_name, lang, count(*) AS total_mentions,
  arg_max(author_id, (engagement_score, author_id)) AS top_influencer_id FROM x GROUP BY ALL""")
def gold(t: Tables):
    daily = tables.read_table(t.spark, f"{gold_posts(t)}/agg_brand_daily")
    return daily.select("date", "brand_name", "lang", "total_mentions", "top_influencer_id")


@case("inc_04_authors_day_by_day", f"""WITH {s.ANALYTICS}, {TOP},
t AS (SELECT author_id, string_agg(brand, ',' ORDER BY rank) AS top_brands FROM r WHERE rank <= 3 GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY created_at_ts DESC, id DESC) AS rn FROM analytics)
SELECT b.author_id, author_username, author_followers, author_statuses_count, round(author_influence_ratio, 6) AS author_influence_ratio, top_brands,
  is_bot AS is_bot_flag FROM b LEFT JOIN t ON b.author_id = t.author_id WHERE rn = 1""")
def authors_day_by_day(t: Tables):
    """The author dimension after three batches; the second has posts in an older form, which the third replaces."""
    path, state = fresh_dir(t.spark, "silver"), fresh_dir(t.spark, "state")
    rows = silver(t)
    third = F.pmod(F.crc32("id"), F.lit(3))
    old = rows.where(third == 2).withColumns({
        "text": F.lit("an older text"), "created_at_ts": F.col("created_at_ts") - F.expr("INTERVAL 40 DAYS"), "ingestion_date": F.lit("2000-01-01")})
    old = old.withColumns(writers.day_columns(F.col("created_at_ts")))
    for batch in (rows.where(third == 0), rows.where(third == 1).unionByName(old), rows.where(third == 2)):
        writers.merge_partitions(t.spark, batch, path, ["id"], short_posts.SILVER_ORDER, short_posts.SILVER_DAYS)
        parts = short_posts.author_state(t.spark, tables.read_table(t.spark, path, rows.schema), path, state, a.BRANDS)
        authors = P.merge_author_parts(parts, a.BRANDS)
    return authors.drop("author_is_blue_verified", "author_following")


def group_tables(t: Tables, incremental: bool = False) -> str:
    bronze, path = fresh_dir(t.spark, "bronze"), fresh_dir(t.spark, "silver")
    writers.land_bronze(t.raw_groups, bronze, F.col("ingestion_date").cast("timestamp"))
    group.build_silver(t.spark, bronze, path)
    if incremental:
        group.build_silver(t.spark, bronze, path, incremental=True)
    return path


@case("inc_02_group_silver", f"WITH {SCORED} SELECT comment_id, post_id, text, reaction_count, is_reply, {DAY} AS ingestion_date FROM tree")
def group_silver(t: Tables):
    path = group_tables(t, incremental=True)
    return tables.read_table(t.spark, f"{path}/comments").select(
        "comment_id", "post_id", "text", "reaction_count", "is_reply", "ingestion_date"
    )


@case("inc_03_group_gold", f"WITH {SCORED} " + page_daily_sql("scored"))
def group_gold(t: Tables):
    path, gold_path = group_tables(t), fresh_dir(t.spark, "gold")
    group.build_gold(t.spark, path, gold_path, lexicon=a.LEXICON, burst=BURST)
    group.build_gold(t.spark, path, gold_path, day="2024-01-03", lexicon=a.LEXICON, burst=BURST)
    return tables.read_table(t.spark, f"{gold_path}/agg_page_daily")


@case("ml_06_stance_job", f"WITH {STANCE} SELECT comment_id, stance, comment_level FROM stance")
def stance_job(t: Tables):
    path, gold_path = group_tables(t), fresh_dir(t.spark, "gold")
    group.build_gold(t.spark, path, gold_path, lexicon=a.LEXICON, burst=BURST)
    for day in ("2024-01-04", None, "2024-01-02"):
        group.build_stance(t.spark, path, gold_path, day, lexicon=a.STANCE)
    stances = tables.read_or_empty(t.spark, f"{gold_path}/comment_stance", contracts.GROUP_STANCE)
    return stances.select("comment_id", "stance", "comment_level")


def video_tables(t: Tables) -> str:
    """Silver, sentiment and stance of one video, then of all videos at once, into the same tables."""
    root, bronze = fresh_dir(t.spark, "video"), fresh_dir(t.spark, "bronze")
    writers.land_video(t.raw_video, bronze)
    for video_id in (VIDEOS[0], None):
        video.build_silver(t.spark, bronze, f"{root}/silver", video_id)
        video.build_sentiment(t.spark, f"{root}/silver", f"{root}/sentiment", video_id, lexicon=a.LEXICON)
        video.build_stance(t.spark, f"{root}/silver", f"{root}/stance", video_id, lexicon=a.STANCE)
    return root


@case("ml_05_stance_job", f"WITH {VSTANCE} SELECT comment_id, video_id, parent_id, stance_label FROM links")
def video_stance_job(t: Tables):
    return tables.read_table(t.spark, f"{video_tables(t)}/stance").select(
        "comment_id", "video_id", "parent_id", "stance_label"
    )


@case("llm_06_insight_job", f"""WITH {THREADS} SELECT thread_id, lower(brand_mentioned) AS entity,
  CASE WHEN is_root THEN 'overall' ELSE 'price' END AS aspect, count(*) AS mention_count FROM docs GROUP BY ALL""")
def insight_job(t: Tables):
    root = fresh_dir(t.spark, "video")
    writers.write_table(sentiment(t), f"{root}/sentiment", ["video_id", "year", "month"])
    writers.write_table(stance_rows(t), f"{root}/stance", ["video_id"])
    for video_id in (VIDEOS[0], None, VIDEOS[1]):
        documents_path = fresh_dir(t.spark, "documents")
        video.build_threads(
            t.spark, f"{root}/sentiment", f"{root}/stance", f"{root}/insights", documents_path, video_id, 3
        )
        video.build_insights(
            t.spark, documents_path, f"{root}/insights", lines_as_items("entity"), "2024-02-03 04:05:06"
        )
    return tables.read_table(t.spark, f"{root}/insights").select("thread_id", "entity", "aspect", "mention_count")


def aspects_as_items(*wanted):
    """A stand-in answerer for posts: an item for each of the wanted kinds of comments."""

    def answer(prompt: str) -> str:
        kinds = re.findall(r"^\[(Root|Reply)\] ", prompt, re.MULTILINE)
        rows = [{"model_entity": kind.lower(), "aspect": "price", "sentiment": "positive", "intensity": "strong", "mention_count": kinds.count(kind),
                 "evidence": kind} for kind in wanted if kind in kinds]
        return json.dumps(rows)

    return answer


KINDS = Vocabulary(entities=("root", "reply"), aspects=("price",), entity_field="model_entity")
MENTIONS = CONTEXT + """, said AS (SELECT post_id, page_name, ingestion_date, CASE WHEN is_reply THEN 'reply' ELSE 'root' END AS model_entity,
  count(*) AS mention_count FROM ctx WHERE comment_id IS NOT NULL GROUP BY ALL)"""


def insights_table(t: Tables, *runs) -> DataFrame:
    """The insight table after runs of (answerer, day, force, part size)."""
    path, gold = group_tables(t), fresh_dir(t.spark, "gold")
    for answer, day, force, part_size in runs:
        group.build_insights(t.spark, path, gold, day, answer, "2024-02-03 04:05:06", KINDS, 2, force, part_size)
    found = tables.read_table(t.spark, f"{gold}/post_insights", contracts.GROUP_INSIGHT)
    return found.select("post_id", "page_name", "ingestion_date", "model_entity", "mention_count")


@case("llm_05_insights_in_parts", f"WITH {MENTIONS} SELECT post_id, page_name, {DAY} AS ingestion_date, model_entity, mention_count FROM said")
def insights_in_parts(t: Tables):
    """Posts in parts of two comments: one row for each entity and aspect, with the mentions of all parts."""
    return insights_table(t, (aspects_as_items("Root", "Reply"), None, False, 2))


@case("llm_05_append_and_skip", f"WITH {MENTIONS} SELECT post_id, page_name, {DAY} AS ingestion_date, model_entity, mention_count FROM said")
def append_and_skip(t: Tables):
    """One day, then all: posts that have insights are not asked about again, so a poorer answer changes nothing there."""
    every = aspects_as_items("Root", "Reply")
    return insights_table(t, (every, "2024-01-03", False, 1000), (every, None, False, 1000), (aspects_as_items("Root"), None, False, 1000))


@case("llm_05_forced_with_fewer_items", f"""WITH {MENTIONS} SELECT post_id, page_name, {DAY} AS ingestion_date, model_entity, mention_count FROM said
  WHERE model_entity = 'root' OR day(ingestion_date) <> 3""")
def forced_with_fewer(t: Tables):
    """Posts of one day are asked about again; what the new answer lacks is gone, other days stay."""
    every = aspects_as_items("Root", "Reply")
    return insights_table(t, (every, None, False, 1000), (aspects_as_items("Root"), "2024-01-03", True, 2))


@case("llm_06_answer_with_fewer_items", f"""WITH {THREADS} SELECT video_id, thread_id, lower(brand_mentioned) AS entity,
  CASE WHEN is_root THEN 'overall' ELSE 'price' END AS aspect, count(*) AS mention_count FROM docs
  WHERE video_id <> 'v1' OR NOT is_root GROUP BY ALL""")
def thread_answer_with_fewer(t: Tables):
    """A video's threads are analysed again, without their roots' items: those are gone, other videos keep theirs."""
    root = fresh_dir(t.spark, "video")
    writers.write_table(sentiment(t), f"{root}/sentiment", ["video_id", "year", "month"])
    writers.write_table(stance_rows(t), f"{root}/stance", ["video_id"])
    every = lines_as_items("entity")

    def replies_only(prompt: str) -> str:
        return every("\n".join(line for line in prompt.split("\n") if not line.startswith("[Root]")))

    for video_id, answer, at in ((None, every, "2024-02-03 04:05:06"), (VIDEOS[1], replies_only, "2024-03-03 04:05:06")):
        documents_path = fresh_dir(t.spark, "documents")
        video.build_threads(t.spark, f"{root}/sentiment", f"{root}/stance", f"{root}/insights", documents_path, video_id, 3, force=True)
        video.build_insights(t.spark, documents_path, f"{root}/insights", answer, at)
    return tables.read_table(t.spark, f"{root}/insights").select("video_id", "thread_id", "entity", "aspect", "mention_count")


@case("str_01_stream_to_silver", f"WITH {s.SILVER} SELECT {SILVER_OUT} FROM silver")
def stream_to_silver(t: Tables):
    bronze, path = landed_posts(t), fresh_dir(t.spark, "silver")
    checkpoint = fresh_dir(t.spark, "checkpoint")
    for _ in range(2):
        streams.silver_from_stream(t.spark, bronze, path, checkpoint, max_files=20).awaitTermination()
    return tables.read_table(t.spark, path).select(*OUT)


def event_stream(t: Tables) -> DataFrame:
    schema = t.table("events").schema
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@case("str_02_unique_in_stream", "SELECT DISTINCT concat(cast(user_id AS string), '/', event_type) AS key FROM events")
def unique_in_stream(t: Tables):
    keyed = event_stream(t).select("ts", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("key"))
    path = fresh_dir(t.spark, "unique")
    streams.to_table(
        streams.unique_by_id(keyed, "key", "ts", "400 days"), path, fresh_dir(t.spark, "checkpoint")
    ).awaitTermination()
    return tables.read_table(t.spark, path).select("key")


@case("str_03_daily_counts", """WITH x AS (SELECT CAST(ts AS DATE) AS date, event_type AS brand_name, 'l' || cast(user_id % 3 AS string) AS lang,
  CASE user_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS label FROM events)
SELECT strftime(date, '%Y-%m-%d') AS date, brand_name, lang, count(*) AS total_mentions, count(*) FILTER (label = 'positive') AS positive_count,
  count(*) FILTER (label = 'neutral') AS neutral_count, count(*) FILTER (label = 'negative') AS negative_count
FROM x GROUP BY ALL""")
def daily_counts(t: Tables):
    label = F.when(F.col("user_id") % 4 == 0, "Positive").when(F.col("user_id") % 4 == 1, "negative").otherwise("neutral")
    rows = event_stream(t).select(
        "ts", F.col("event_type").alias("brand_name"),
        F.concat(F.lit("l"), (F.col("user_id") % 3).cast("string")).alias("lang"), label.alias("sentiment_label"),
    )
    path = fresh_dir(t.spark, "daily")
    streams.to_daily_table(
        streams.daily_brand_counts(rows, "ts", "12 hours"), path, fresh_dir(t.spark, "checkpoint")
    ).awaitTermination()
    return tables.read_table(t.spark, path)


@case("snk_08_register_partitions", f"WITH {ITEMS} SELECT {DAY} AS ingestion_date, count(*) AS n FROM items GROUP BY 1")
def register_partitions(t: Tables):
    path = fresh_dir(t.spark, "partitions")
    rows = items(t).select("event_id", "ingestion_date")
    writers.write_table(rows, path, ["ingestion_date"])
    name = "loom_checks.parts_" + path.rsplit("-", 1)[1]
    catalog.ensure_database(t.spark, "loom_checks", fresh_dir(t.spark, "db"))
    catalog.register_table(t.spark, name, rows, path, ["ingestion_date"])
    days = [{"ingestion_date": d} for d in ("2024-01-05", "2024-01-06")]
    catalog.replace_partitions(t.spark, name, days)
    return t.spark.table(name).groupBy("ingestion_date").agg(F.count("*").alias("n"))


@case("prj_06_landed_video_comments", f"""SELECT video_id, comment_id, parent_id, author_id AS author, text,
  CASE WHEN reactions > 3 THEN reactions ELSE 0 END::BIGINT AS likes FROM {a.duck(a.TURNS)}""")
def landed_video_comments(t: Tables):
    bronze = fresh_dir(t.spark, "bronze")
    landing.land_video_comments(*thread_pages(t), bronze)
    videos = [tables.read_bronze(t.spark, bronze, "video", v).withColumn("video_id", F.lit(v)) for v in VIDEOS]
    rows = reduce(DataFrame.unionByName, videos)
    return rows.select("video_id", "comment_id", "parent_id", "author", "text", "likes")


@case("prj_10_landed_group_posts", f"""WITH t AS (SELECT * FROM {a.duck(a.TURNS)})
SELECT comment_id AS post_id, '2024-05-28T00:00:00Z' AS ingestion_date FROM t
WHERE turn <> 5 AND reactions % 7 <> 0""")
def landed_group_posts(t: Tables):
    bronze = fresh_dir(t.spark, "bronze")
    landing.land_group_posts(feed_blocks(t), *comment_pages(t), bronze, "2024-05-28 00:00:00")
    return tables.read_latest_bronze(t.spark, bronze, "group").select("post_id", "ingestion_date")
