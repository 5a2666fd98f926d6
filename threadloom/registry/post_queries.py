"""Short posts: flattening, cleaning, features, star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.contracts import FACT_POSTS, conform
from threadloom.functions.measures import ratio
from threadloom.functions.moments import parse_legacy_timestamp as parse
from threadloom.functions.text import clean_text, fold_tags, keyword_match
from threadloom.operators import posts as P
from threadloom.operators import quality as Q
from threadloom.operators.quality import drop_funnel
from threadloom.operators.reports import author_influence, brand_sentiment_overview
from threadloom.operators.scoring import lexicon_text_model, score_text
from threadloom.operators.topk import collect_ranked, topk_per_group
from threadloom.registry import adapters as a
from threadloom.registry import sqltext as s
from threadloom.registry.adapters import Tables
from threadloom.registry.core import case
from threadloom.sources.tables import read_window


def flat(t: Tables):
    return P.flatten_posts_with_quotes(t.raw_posts)


def silver(t: Tables):
    return P.silver_posts(t.raw_posts)


def analytics(t: Tables):
    return P.add_analytics(silver(t), a.BRANDS, a.AS_OF, s.VIRAL)


def scored(t: Tables):
    return score_text(analytics(t), lexicon=a.LEXICON)


@case("agg_01_brand_daily", f"""WITH {s.ANALYTICS}, x AS (
  SELECT CAST(created_at_ts AS DATE) AS date, unnest(all_brands) AS brand_name, coalesce(lang, 'unknown') AS lang,
    sentiment_label, sentiment_score, engagement_score, is_viral, author_id FROM analytics),
g AS (SELECT date, brand_name, lang, count(*) AS total_mentions,
    count(*) FILTER (sentiment_label = 'positive') AS positive_count,
    count(*) FILTER (sentiment_label = 'neutral') AS neutral_count,
    count(*) FILTER (sentiment_label = 'negative') AS negative_count,
    round(avg(sentiment_score), 6) AS avg_sentiment_score, round(avg(engagement_score), 6) AS avg_engagement_score,
    CAST(sum(is_viral::int) AS BIGINT) AS viral_count,
    arg_max(author_id, (engagement_score, author_id)) AS top_influencer_id
  FROM x GROUP BY 1, 2, 3)
SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date),
  {s.half_up('total_mentions', 'CAST(sum(total_mentions) OVER (PARTITION BY date, lang) AS BIGINT)')} AS share_of_voice
FROM g""")
def brand_daily(t: Tables):
    return P.agg_brand_daily(scored(t))


POST_OUT = (
    'id, type, url, text, source, lang, "retweetCount", "replyCount", "likeCount", "quoteCount", "inReplyToId",'
    " author_id, author_username, author_is_blue_verified, author_followers, author_following, author_statuses_count,"
    " array_to_string(hashtags, ',') AS hashtags, array_to_string(mentioned_user_ids, ',') AS mentioned_user_ids,"
    " ingestion_date"
)
EMPTY = '"conversationId", "inReplyToUserId", "inReplyToUsername"'.replace('"', "").split(", ")
LEGACY = "CASE WHEN {bad} THEN {other} ELSE strftime(stamp, '%a %b %d %H:%M:%S +0000 %Y') END"
CREATED = LEGACY.format(bad="bad_stamp", other="'n/a'") + ' AS "createdAt"'
AUTHOR_CREATED = LEGACY.format(bad="no_author_stamp", other="NULL") + ' AS "author_createdAt"'


@case("prj_01_flatten_post", f"SELECT {POST_OUT}, {CREATED}, {AUTHOR_CREATED} FROM {a.duck(a.POSTS)}")
def flatten_post(t: Tables):
    return P.flatten_posts(t.raw_posts).drop(*EMPTY)


@case("prj_01_flatten_quoted_post", f"""SELECT concat('q', cast(doc_id // 3 AS string)) AS id, concat(url, '?q') AS url,
  {POST_OUT.replace('id, type, url,', 'type,', 1)}, {CREATED}, {AUTHOR_CREATED} FROM {a.duck(a.POSTS)} WHERE k % 5 < 2""")
def flatten_quoted(t: Tables):
    return P.flatten_posts(t.raw_posts.where("quoted_tweet is not null"), "quoted_tweet").drop(*EMPTY)


@case("prj_02_posts_with_quotes", f"WITH {s.FLAT} SELECT {POST_OUT}, {CREATED}, {AUTHOR_CREATED} FROM flat")
def posts_with_quotes(t: Tables):
    return flat(t).drop(*EMPTY)


@case("set_01_union_by_name", f"""SELECT count(*) AS n, CAST(sum("likeCount") AS BIGINT) AS likes FROM (
  SELECT "likeCount" FROM {a.duck(a.POSTS)} UNION ALL SELECT "likeCount" FROM {a.duck(a.POSTS)} WHERE k % 5 < 2)""")
def union_by_name(t: Tables):
    raw = t.raw_posts
    both = P.flatten_posts(raw).unionByName(P.flatten_posts(raw.where("quoted_tweet is not null"), "quoted_tweet"))
    return both.agg(F.count("*").alias("n"), F.sum("likeCount").alias("likes"))


@case("flt_01_complete_posts", f"""WITH {s.FLAT} SELECT id FROM flat WHERE id IS NOT NULL AND text IS NOT NULL
  AND author_id IS NOT NULL AND NOT no_author_stamp""")
def complete(t: Tables):
    return P.drop_incomplete_posts(flat(t)).select("id")


@case("flt_02_valid_counts", f"""WITH {s.FLAT} SELECT id, "likeCount", "retweetCount" FROM flat
  WHERE "retweetCount" >= 0 AND "likeCount" >= 0 AND "replyCount" >= 0 AND "quoteCount" >= 0""")
def valid_counts(t: Tables):
    return P.drop_negative_counts(flat(t)).select("id", "likeCount", "retweetCount")


@case("flt_05_parsed_timestamp", f"""WITH {s.FLAT} SELECT id, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS created_at_ts
  FROM flat WHERE NOT bad_stamp""")
def parsed(t: Tables):
    return P.add_post_features(flat(t)).select("id", "created_at_ts")


@case("fn_01_clean_text", f"SELECT doc_id, {s.clean('text')} AS cleaned FROM documents")
def clean(t: Tables):
    return t.table("documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@case("fn_01_clean_text_unicode", f"SELECT doc_id, {s.clean('text', True)} AS cleaned FROM documents")
def clean_unicode(t: Tables):
    return t.table("documents").select("doc_id", clean_text(F.col("text"), unicode=True).alias("cleaned"))


@case("fn_02_legacy_timestamp", f"""SELECT id, CASE WHEN NOT bad_stamp THEN strftime(stamp, '%Y-%m-%d %H:%M:%S') END AS parsed,
  CASE WHEN NOT no_author_stamp THEN strftime(stamp, '%Y-%m-%d %H:%M:%S') END AS author_parsed
  FROM {a.duck(a.POSTS)}""")
def legacy(t: Tables):
    return t.raw_posts.select(
        "id", parse(F.col("createdAt")).alias("parsed"), parse(F.col("author.createdAt")).alias("author_parsed")
    )


@case("fn_04_post_features", f"""WITH {s.SILVER} SELECT id, hour(created_at_ts) AS tweet_hour,
  dayofweek(created_at_ts) + 1 AS tweet_day_of_week, year(created_at_ts) AS year, month(created_at_ts) AS month,
  day(created_at_ts) AS day, "inReplyToId" IS NOT NULL AS is_reply, type = 'retweet' AS is_retweet,
  coalesce(len(hashtags), 0) AS hashtag_count, coalesce(len(mentioned_user_ids), 0) AS mention_count FROM silver""")
def features(t: Tables):
    return silver(t).select(
        "id", "tweet_hour", "tweet_day_of_week", "year", "month", "day", "is_reply", "is_retweet", "hashtag_count",
        "mention_count",
    )


@case("fn_05_type_flags", f"""WITH {s.SILVER} SELECT is_reply, is_retweet, count(*) AS n FROM (
  SELECT "inReplyToId" IS NOT NULL AS is_reply, type = 'retweet' AS is_retweet FROM silver) GROUP BY 1, 2""")
def type_flags(t: Tables):
    return silver(t).groupBy("is_reply", "is_retweet").count().withColumnRenamed("count", "n")


@case("fn_06_entity_counts", f"""SELECT id, coalesce(len(hashtags), 0) AS hashtags,
  coalesce(len(mentioned_user_ids), 0) AS mentions FROM {a.duck(a.POSTS)}""")
def entity_counts(t: Tables):
    return P.flatten_posts(t.raw_posts).select(
        "id", P.entity_count("hashtags").alias("hashtags"), P.entity_count("mentioned_user_ids").alias("mentions")
    )


@case("inc_01_silver_posts", f"""WITH {s.SILVER} SELECT id, text, "likeCount", author_id,
  strftime(created_at_ts, '%Y-%m-%d %H:%M:%S') AS created_at_ts, hour(created_at_ts) AS tweet_hour FROM silver""")
def silver_posts(t: Tables):
    return silver(t).select("id", "text", "likeCount", "author_id", "created_at_ts", "tweet_hour")


@case("fn_07_engagement", f"""WITH {s.ANALYTICS} SELECT id, round(engagement_score, 6) AS engagement_score,
  is_viral FROM analytics""")
def engagement(t: Tables):
    return analytics(t).select("id", "engagement_score", "is_viral")


@case("fn_08_viral_flag", f"WITH {s.ANALYTICS} SELECT is_viral, count(*) AS n FROM analytics GROUP BY 1")
def viral(t: Tables):
    return analytics(t).groupBy("is_viral").count().withColumnRenamed("count", "n")


@case("fn_09_influence_ratio", f"""WITH {s.ANALYTICS} SELECT id, round(author_influence_ratio, 6) AS ratio
  FROM analytics""")
def influence(t: Tables):
    return analytics(t).selectExpr("id", "author_influence_ratio AS ratio")


@case("fn_10_keyword_match", f"""WITH {s.SILVER} SELECT id, {', '.join(f'{s.keyword(b)} AS {b.name.lower()}' for b in a.BRANDS)}
  FROM silver""")
def keywords(t: Tables):
    return silver(t).select("id", *[
        keyword_match(F.lower("text"), fold_tags(F.col("hashtags")), b.keywords).alias(b.name.lower()) for b in a.BRANDS
    ])


@case("fn_11_tag_brands", f"""WITH {s.ANALYTICS} SELECT id, array_to_string(all_brands, ',') AS all_brands,
  primary_brand FROM analytics""")
def tags(t: Tables):
    return analytics(t).select("id", "all_brands", "primary_brand")


@case("flt_15_compact_array", f"""WITH {s.ANALYTICS} SELECT len(all_brands) AS brands, count(*) AS n FROM analytics GROUP BY 1""")
def compact(t: Tables):
    return analytics(t).selectExpr("size(all_brands) AS brands").groupBy("brands").count().withColumnRenamed("count", "n")


@case("fn_12_bot_flag", f"WITH {s.ANALYTICS} SELECT id, is_bot FROM analytics")
def bots(t: Tables):
    return analytics(t).select("id", "is_bot")


@case("ml_01_lexicon_sentiment", f"""SELECT doc_id, {s.label('text')} AS sentiment_label,
  round(CAST({s.score('text')} AS DOUBLE), 6) AS sentiment_score FROM documents""")
def lexicon(t: Tables):
    return score_text(t.table("documents"), lexicon=a.LEXICON).select("doc_id", "sentiment_label", "sentiment_score")


@case("ml_01_pandas_sentiment", f"""SELECT doc_id, {s.label('text')} AS sentiment_label,
  round(CAST({s.score('text')} AS DOUBLE), 6) AS sentiment_score FROM documents""")
def pandas_sentiment(t: Tables):
    return score_text(t.table("documents"), load=lexicon_text_model(a.LEXICON)).select(
        "doc_id", "sentiment_label", "sentiment_score"
    )


FACT = """id AS tweet_id, author_id, author_username, author_followers, primary_brand,
  array_to_string(all_brands, ',') AS all_brands, strftime(created_at_ts, '%Y-%m-%d %H:%M:%S') AS created_at_ts,
  strftime(created_at_ts, '%Y-%m-%d') AS date, lang, round(CAST(sentiment_score AS DOUBLE), 6) AS sentiment_score,
  sentiment_label, round(engagement_score, 6) AS engagement_score, is_viral, is_bot,
  array_to_string(hashtags, ',') AS hashtags"""


@case("prj_15_fact_posts", f"WITH {s.ANALYTICS} SELECT {FACT} FROM analytics")
def fact(t: Tables):
    return P.fact_posts(scored(t))


@case("qc_09_contract_fact_posts", f"""WITH {s.ANALYTICS} SELECT {FACT.replace('author_followers', 'CAST(author_followers AS BIGINT) AS author_followers')}
  FROM analytics""")
def fact_contract(t: Tables):
    return conform(P.fact_posts(scored(t)), FACT_POSTS)


TOP = """x AS (SELECT author_id, unnest(all_brands) AS brand FROM analytics),
c AS (SELECT author_id, brand, count(*) AS n FROM x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY n DESC, brand) AS rank FROM c)"""


@case("agg_04_dim_authors", f"""WITH {s.ANALYTICS}, {TOP},
t AS (SELECT author_id, string_agg(brand, ',' ORDER BY rank) AS top_brands FROM r WHERE rank <= 3 GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY created_at_ts DESC, id DESC) AS rn FROM analytics)
SELECT b.author_id, author_username, author_is_blue_verified, author_followers, author_following,
  author_statuses_count, round(author_influence_ratio, 6) AS author_influence_ratio, top_brands, is_bot AS is_bot_flag
FROM b LEFT JOIN t ON b.author_id = t.author_id WHERE rn = 1""")
def dim_authors(t: Tables):
    return P.dim_authors(analytics(t), a.BRANDS)


@case("win_01_top3_brands", f"WITH {s.ANALYTICS}, {TOP} SELECT * FROM r WHERE rank <= 3")
def top3(t: Tables):
    return topk_per_group(P.brand_mentions(analytics(t), "author_id").withColumnRenamed("brand_name", "brand"), ["author_id"], "brand", 3)


@case("win_02_top5_brands", f"""WITH {s.ANALYTICS}, {TOP} SELECT author_id, string_agg(brand, ',' ORDER BY rank) AS top_brands
  FROM r WHERE rank <= 5 GROUP BY 1""")
def top5(t: Tables):
    ranked = topk_per_group(P.brand_mentions(analytics(t), "author_id").withColumnRenamed("brand_name", "brand"), ["author_id"], "brand", 5)
    return collect_ranked(ranked, ["author_id"], "brand", "top_brands")


DOMINANT = """l AS (SELECT author_id, sentiment_label, count(*) AS n FROM analytics GROUP BY 1, 2),
d AS (SELECT author_id, sentiment_label AS dominant_sentiment FROM (
  SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY n DESC, sentiment_label) AS rank FROM l) WHERE rank = 1)"""


@case("win_03_dominant_sentiment", f"WITH {s.ANALYTICS}, {DOMINANT} SELECT * FROM d")
def dominant(t: Tables):
    top = topk_per_group(scored(t).select("author_id", "sentiment_label"), ["author_id"], "sentiment_label", 1)
    return top.selectExpr("author_id", "sentiment_label AS dominant_sentiment")


@case("agg_03_author_perf", f"""WITH {s.ANALYTICS}, {TOP}, {DOMINANT},
t AS (SELECT author_id, string_agg(brand, ',' ORDER BY rank) AS top_brands FROM r WHERE rank <= 5 GROUP BY 1),
g AS (SELECT author_id, count(*) AS total_tweets, round(avg(engagement_score), 6) AS avg_engagement,
  CAST(sum(is_viral::int) AS BIGINT) AS viral_tweet_count FROM analytics GROUP BY 1)
SELECT g.*, top_brands, dominant_sentiment FROM g LEFT JOIN t ON g.author_id = t.author_id
  LEFT JOIN d ON g.author_id = d.author_id""")
def author_perf(t: Tables):
    return P.agg_author_perf(scored(t), a.BRANDS)


@case("join_01_authors_top_brands", f"""WITH {s.ANALYTICS}, {TOP},
t AS (SELECT author_id, string_agg(brand, ',' ORDER BY rank) AS top_brands FROM r WHERE rank <= 3 GROUP BY 1),
b AS (SELECT author_id, count(*) AS posts FROM analytics GROUP BY 1)
SELECT b.author_id, posts, top_brands FROM b LEFT JOIN t ON b.author_id = t.author_id""")
def join_top_brands(t: Tables):
    posts = analytics(t)
    ranked = topk_per_group(P.brand_mentions(posts, "author_id").withColumnRenamed("brand_name", "brand"), ["author_id"], "brand", 3)
    base = posts.groupBy("author_id").count().withColumnRenamed("count", "posts")
    return base.join(collect_ranked(ranked, ["author_id"], "brand", "top_brands"), "author_id", "left")


@case("agg_02_top_author", f"""WITH {s.ANALYTICS} SELECT strftime(created_at_ts, '%Y-%m-%d') AS date,
  arg_max(author_id, (engagement_score, author_id)) AS top_influencer_id FROM analytics GROUP BY 1""")
def top_author(t: Tables):
    dated = analytics(t).withColumn("date", F.to_date("created_at_ts"))
    return dated.groupBy("date").agg(P.top_author().alias("top_influencer_id"))


@case("win_04_share_of_voice", f"""WITH {s.ANALYTICS}, x AS (
  SELECT lang, unnest(all_brands) AS brand FROM analytics),
g AS (SELECT lang, brand, count(*) AS n FROM x GROUP BY 1, 2)
SELECT *, {s.half_up('n', 'CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT)')} AS share FROM g""")
def share(t: Tables):
    counts = P.brand_mentions(analytics(t), "lang").groupBy("lang", F.col("brand_name").alias("brand")).agg(
        F.count("*").alias("n")
    )
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("lang"))))


@case("src_14_dim_brands_mentions", f"""WITH {s.ANALYTICS}, x AS (SELECT unnest(all_brands) AS brand FROM analytics),
b AS (SELECT * FROM (VALUES {', '.join(f"('{b.brand_id}', '{b.name}', '{b.segment}')" for b in a.BRANDS)}) v(brand_id, brand_name, brand_segment))
SELECT brand_id, brand_name, brand_segment, count(brand) AS mentions FROM b LEFT JOIN x ON brand = brand_name GROUP BY 1, 2, 3""")
def brand_dim(t: Tables):
    n = P.brand_mentions(analytics(t)).groupBy("brand_name").agg(F.count("*").alias("mentions"))
    dim = P.dim_brands(t.spark, a.BRANDS).select("brand_id", "brand_name", "brand_segment")
    return dim.join(n, "brand_name", "left").na.fill(0, ["mentions"])


@case("agg_15_brand_sentiment_overview", f"""WITH {s.ANALYTICS}, g AS (
  SELECT primary_brand, count(*) AS total_mentions, count(*) FILTER (sentiment_label = 'positive') AS positive_count,
    count(*) FILTER (sentiment_label = 'neutral') AS neutral_count,
    count(*) FILTER (sentiment_label = 'negative') AS negative_count, count(*) FILTER (is_bot) AS bot_count
  FROM analytics WHERE CAST(created_at_ts AS DATE) >= DATE '{a.AS_OF[:10]}' - 30 GROUP BY 1)
SELECT *, {s.half_up('positive_count * 100', 'total_mentions', 2)} AS positive_pct,
  {s.half_up('neutral_count * 100', 'total_mentions', 2)} AS neutral_pct,
  {s.half_up('negative_count * 100', 'total_mentions', 2)} AS negative_pct,
  {s.half_up('bot_count * 100', 'total_mentions', 2)} AS bot_pct FROM g""")
def brand_overview(t: Tables):
    return brand_sentiment_overview(t.spark, P.fact_posts(scored(t)), a.AS_OF[:10])


@case("agg_16_author_influence", f"""WITH {s.ANALYTICS}, {TOP},
st AS (SELECT author_id, author_username, count(*) AS n, round(avg(engagement_score), 4) AS e FROM analytics GROUP BY 1, 2),
t AS (SELECT brand, author_username, st.n, e FROM st JOIN r ON st.author_id = r.author_id AND rank = 1
  ORDER BY e DESC, st.author_id LIMIT 10)
SELECT brand AS top_brand, author_username, round(log10(sum(e) + 1), 6) AS log_engagement,
  CAST(sum(n) AS BIGINT) AS total_tweets FROM t GROUP BY 1, 2""")
def influence_report(t: Tables):
    return author_influence(t.spark, P.fact_posts(scored(t)))


@case("src_06_rolling_window", f"""WITH {s.ANALYTICS} SELECT id AS tweet_id, strftime(created_at_ts, '%Y-%m-%d') AS date
  FROM analytics WHERE CAST(created_at_ts AS DATE) >= DATE '2024-01-03' - 1""")
def rolling(t: Tables):
    return read_window(P.fact_posts(scored(t)), "date", 1, "2024-01-03").select("tweet_id", "date")


@case("inc_04_author_perf_window", f"""WITH {s.ANALYTICS}, w AS (SELECT * FROM analytics
  WHERE CAST(created_at_ts AS DATE) >= DATE '2024-01-03' - 1)
SELECT author_id, count(*) AS total_tweets, round(avg(engagement_score), 6) AS avg_engagement FROM w GROUP BY 1""")
def perf_window(t: Tables):
    facts = read_window(P.fact_posts(scored(t)), "date", 1, "2024-01-03")
    return P.agg_author_perf(facts, a.BRANDS).select("author_id", "total_tweets", "avg_engagement")


def quality_sql(source: str, checks: list[tuple[str, str, str]], unique: str | None = None) -> str:
    """Check report over ``source``: (name, failing condition, status when failing rows exceed 0)."""
    rows = [
        f"SELECT '{n}' AS \"check\", count(*) FILTER ({c}) AS failing, count(*) AS rows,"
        f" CASE WHEN {limit} THEN 'ok' ELSE '{status}' END AS status FROM {source}"
        for n, c, status, limit in [(*x, f"count(*) FILTER ({x[1]}) = 0") if len(x) == 3 else x for x in checks]
    ]
    if unique:
        dup = f"count({unique}) - count(DISTINCT {unique})"
        rows.append(f"SELECT 'duplicate_{unique}', {dup}, count(*), CASE WHEN {dup} = 0 THEN 'ok' ELSE 'fail' END"
                    f" FROM {source}")
    return "SELECT * FROM (" + " UNION ALL ".join(rows) + ")"


@case("qc_02_post_checks", f"WITH {s.FLAT} " + quality_sql("flat", [
    ("null_critical_fields", "id IS NULL OR text IS NULL OR author_id IS NULL OR no_author_stamp", "fail"),
    ("negative_engagement", '"retweetCount" < 0 OR "likeCount" < 0 OR "replyCount" < 0 OR "quoteCount" < 0', "fail"),
]))
def post_checks(t: Tables):
    return Q.report(flat(t), Q.post_checks()[:2])


@case("qc_02_post_checks_silver", f"WITH {s.SILVER} " + quality_sql("silver", [
    ("null_critical_fields", "false", "fail"), ("negative_engagement", "false", "fail"),
    ("invalid_numeric_features", "false", "fail")], "id"))
def silver_checks(t: Tables):
    return Q.report(silver(t), Q.post_checks(), unique="id")


@case("qc_04_analytics_checks", f"WITH {s.ANALYTICS} " + quality_sql("analytics", [
    ("invalid_engagement_score", "engagement_score IS NULL OR engagement_score < 0", "fail"),
    ("null_is_bot", "is_bot IS NULL", "fail"),
    ("brand_coverage", "primary_brand = 'Unknown'", "warn",
     "count(*) FILTER (primary_brand = 'Unknown') <= count(*) * 0.5")]))
def analytics_checks(t: Tables):
    return Q.report(analytics(t), Q.analytics_checks())


@case("qc_05_gold_checks", f"WITH {s.ANALYTICS}, f AS (SELECT id AS tweet_id, * FROM analytics) " + quality_sql("f", [
    ("fact_tweets_null_keys", "id IS NULL OR author_id IS NULL OR created_at_ts IS NULL", "fail"),
    ("fact_tweets_null_sentiment", "sentiment_label IS NULL", "fail")], "tweet_id"))
def gold_checks(t: Tables):
    return Q.report(P.fact_posts(scored(t)), Q.fact_post_checks(), unique="tweet_id")


@case("qc_05_brand_daily_checks", f"""WITH {s.ANALYTICS}, x AS (
  SELECT DISTINCT CAST(created_at_ts AS DATE) AS date, unnest(all_brands) AS brand_name, lang FROM analytics) """
      + quality_sql("x", [
          ("agg_brand_daily_null_keys", "false", "fail"), ("agg_brand_daily_invalid_mentions", "false", "fail"),
          ("agg_brand_daily_invalid_sov", "false", "fail")]))
def brand_daily_checks(t: Tables):
    return Q.report(P.agg_brand_daily(scored(t)), Q.brand_daily_checks())


@case("qc_06_author_perf_checks", f"""WITH {s.ANALYTICS}, x AS (SELECT DISTINCT author_id FROM analytics) """
      + quality_sql("x", [("agg_author_perf_null_keys", "author_id IS NULL", "fail")]))
def perf_checks(t: Tables):
    return Q.report(P.agg_author_perf(scored(t), a.BRANDS), Q.author_perf_checks())


@case("qc_01_failing_rows", f"""WITH {s.FLAT} SELECT id, "likeCount" FROM flat
  WHERE "retweetCount" < 0 OR "likeCount" < 0 OR "replyCount" < 0 OR "quoteCount" < 0 ORDER BY id LIMIT 5""")
def failing_rows(t: Tables):
    return Q.failing_sample(flat(t).orderBy("id"), Q.post_checks()[1]).select("id", "likeCount")


@case("qc_10_drop_funnel", f"""WITH {s.FLAT}, n AS (SELECT
    (SELECT count(*) FROM {a.duck(a.POSTS)}) + (SELECT count(*) FROM {a.duck(a.POSTS)} WHERE k % 5 < 2) AS total,
    count(*) AS a1, count(*) FILTER (NOT no_author_stamp AND text <> '') AS a2,
    count(*) FILTER (NOT no_author_stamp AND text <> '' AND coalesce("retweetCount", 0) >= 0) AS a3,
    count(*) FILTER (NOT no_author_stamp AND text <> '' AND coalesce("retweetCount", 0) >= 0 AND NOT bad_stamp) AS a4
  FROM flat)
SELECT 0 AS step_no, 'total' AS step, total AS rows_left, 0 AS rows_lost FROM n
UNION ALL SELECT 1, 'after_dedup', a1, total - a1 FROM n UNION ALL SELECT 2, 'after_critical', a2, a1 - a2 FROM n
UNION ALL SELECT 3, 'after_engagement', a3, a2 - a3 FROM n
UNION ALL SELECT 4, 'after_timestamp', a4, a3 - a4 FROM n""")
def funnel(t: Tables):
    raw = t.raw_posts
    both = P.flatten_posts(raw).unionByName(P.flatten_posts(raw.where("quoted_tweet is not null"), "quoted_tweet"))
    return drop_funnel(both, ["ingestion_date", "likeCount", "retweetCount", "url"])


@case("join_02_author_left_joins", f"""WITH {s.ANALYTICS}, {TOP}, {DOMINANT},
t AS (SELECT author_id, string_agg(brand, ',' ORDER BY rank) AS top_brands FROM r WHERE rank <= 5 GROUP BY 1)
SELECT g.author_id, total_tweets, top_brands, dominant_sentiment FROM (
  SELECT author_id, count(*) AS total_tweets FROM analytics GROUP BY 1) g
  LEFT JOIN t ON g.author_id = t.author_id LEFT JOIN d ON g.author_id = d.author_id""")
def author_left_joins(t: Tables):
    rows = scored(t).select("author_id", "all_brands", "sentiment_label")
    brands = topk_per_group(rows.selectExpr("author_id", "explode_outer(all_brands) AS brand"), ["author_id"], "brand", 5)
    label = topk_per_group(rows, ["author_id"], "sentiment_label", 1)
    return (
        rows.groupBy("author_id").agg(F.count("*").alias("total_tweets"))
        .join(collect_ranked(brands, ["author_id"], "brand", "top_brands"), "author_id", "left")
        .join(label.selectExpr("author_id", "sentiment_label AS dominant_sentiment"), "author_id", "left")
    )


@case("join_08_unnest_brands", f"""WITH {s.ANALYTICS}, x AS (SELECT id, unnest(all_brands) AS brand_name FROM analytics)
SELECT id, brand_name FROM x""")
def unnest_brands(t: Tables):
    facts = analytics(t)
    return t.spark.sql("SELECT id, brand_name FROM {facts} LATERAL VIEW OUTER explode(all_brands) b AS brand_name"
                       " WHERE brand_name IS NOT NULL", facts=facts)


@case("join_09_favourite_brand", f"""WITH {s.ANALYTICS}, {TOP} SELECT a.author_id, a.posts, r.brand AS top_brand FROM (
  SELECT author_id, count(*) AS posts FROM analytics GROUP BY 1) a JOIN r ON a.author_id = r.author_id AND r.rank = 1""")
def favourite_brand(t: Tables):
    rows = analytics(t)
    ranked = topk_per_group(rows.selectExpr("author_id", "explode_outer(all_brands) AS brand"), ["author_id"], "brand", 1)
    posts = rows.groupBy("author_id").agg(F.count("*").alias("posts"))
    return posts.join(ranked.selectExpr("author_id", "brand AS top_brand"), "author_id")


@case("win_08_rank_over_aggregate", f"WITH {s.ANALYTICS}, {TOP} SELECT author_id, brand, rank AS rn FROM r")
def rank_over_aggregate(t: Tables):
    return t.spark.sql("""
      SELECT author_id, brand, row_number() OVER (PARTITION BY author_id ORDER BY count(*) DESC, brand) AS rn
      FROM {facts} LATERAL VIEW OUTER explode(all_brands) b AS brand WHERE brand IS NOT NULL
      GROUP BY author_id, brand""", facts=analytics(t))


@case("flt_16_last_days_not_null", f"""WITH {s.ANALYTICS} SELECT primary_brand, count(*) AS n FROM analytics
  WHERE CAST(created_at_ts AS DATE) >= DATE '2024-02-01' - 30 AND engagement_score IS NOT NULL GROUP BY 1""")
def last_days(t: Tables):
    facts = read_window(P.fact_posts(scored(t)), "date", 30, "2024-02-01").where("engagement_score is not null")
    return facts.groupBy("primary_brand").agg(F.count("*").alias("n"))


@case("sort_02_top_ten_authors", f"""WITH {s.ANALYTICS} SELECT author_id, round(avg(engagement_score), 4) AS e FROM analytics
  GROUP BY 1 ORDER BY e DESC, author_id LIMIT 10""")
def top_ten(t: Tables):
    scores = analytics(t).groupBy("author_id").agg(F.round(F.avg("engagement_score"), 4).alias("e"))
    return scores.orderBy(F.col("e").desc(), "author_id").limit(10)
