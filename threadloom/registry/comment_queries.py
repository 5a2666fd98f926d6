"""Group and video comments: flattening, enrichment, stance, sentiment, threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalogue import SALE_PHRASES, VIDEO_BRANDS
from threadloom.functions import measures, text
from threadloom.functions.moments import parse_iso_timestamp
from threadloom.operators import comments as C
from threadloom.operators import quality as Q
from threadloom.operators import threads as TH
from threadloom.operators.reports import controversial_posts, video_sentiment_counts
from threadloom.operators.scoring import lexicon_pair_model, lexicon_text_model, score_present_text, score_text
from threadloom.plans.group import PROMPT as GROUP_PROMPT
from threadloom.registry import adapters as a
from threadloom.registry import sqltext as s
from threadloom.registry.adapters import Tables
from threadloom.registry.core import case
from threadloom.registry.post_queries import quality_sql

EDGE = r"[^\p{L}\p{M}\p{N}_]"
SALE = "|".join(p.replace(" ", r"[\s_]?") for p in SALE_PHRASES)
IS_SALE = rf"regexp_matches(text, '(?i)(^|{EDGE})({SALE})($|{EDGE})')"
PRICE = rf"regexp_matches(text, '(?i)[0-9]+\s*tr($|{EDGE})')"

KEY = "sha256(concat_ws('|', {0}.post_id, {0}.author_id, {0}.text))[1:16]"
TREE = f"""turns AS (SELECT * FROM {a.duck(a.TURNS)}),
tree AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY ingestion_date DESC, reaction_count DESC,
    author_name DESC, parent_comment_id DESC NULLS LAST, is_reply DESC) AS rn
  FROM (SELECT {KEY.format('t')} AS comment_id, t.post_id, t.page_name, t.author_id, t.author_name,
      concat('https://people.example/', t.author_id) AS author_url, t.text, t.reactions AS reaction_count,
      CASE WHEN t.turn % 2 = 0 THEN {KEY.format('p')} END AS parent_comment_id, t.turn % 2 = 0 AS is_reply,
      t.ingestion_date
    FROM turns t LEFT JOIN turns p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1 WHERE t.turn > 0)
) WHERE rn = 1),
posts AS (SELECT post_id, 'group' AS source_type, page_name, text,
  (SELECT count(*) FROM turns c WHERE c.conv_id = t.conv_id AND c.turn % 2 = 1) AS comment_count,
  concat('https://groups.example/', post_id) AS permalink, ingestion_date FROM turns t
  WHERE turn = 0 AND NOT {IS_SALE})"""
BURST = 2
SCORED = TREE + f""", scored AS (SELECT *,
  reaction_count * ln(CASE WHEN is_reply THEN 3.0 ELSE 2.0 END) AS engagement_score,
  count(*) OVER (PARTITION BY author_id, ingestion_date) > {BURST} AS is_bot,
  {s.label('text')} AS sentiment_label, {s.score('text')} AS sentiment_score FROM tree),
dim AS (SELECT *, CASE WHEN trim(text) <> '' THEN {s.label('text')} END AS sentiment_label FROM posts)"""
DAY = "strftime(ingestion_date, '%Y-%m-%d')"


def tree(t: Tables):
    return C.flatten_comment_tree(t.raw_groups)


def group_posts(t: Tables):
    return C.flatten_group_posts(t.raw_groups)


def scored(t: Tables):
    return score_text(C.enrich_group_comments(tree(t), limit=BURST), lexicon=a.LEXICON)


def dim_posts(t: Tables):
    return C.dim_group_posts(score_present_text(group_posts(t), lexicon=a.LEXICON))


@case("prj_03_flatten_group_posts", f"WITH {TREE} SELECT * REPLACE ({DAY} AS ingestion_date) FROM posts")
def flatten_group_posts(t: Tables):
    return group_posts(t)


@case("prj_04_comment_tree", f"WITH {TREE} SELECT * REPLACE ({DAY} AS ingestion_date) FROM tree")
def comment_tree(t: Tables):
    return tree(t)


@case("prj_05_surrogate_key", f"SELECT doc_id, sha256(concat_ws('|', lang, source, text))[1:16] AS key FROM documents")
def surrogate(t: Tables):
    return t.table("documents").select(
        "doc_id", text.surrogate_key(F.col("lang"), F.col("source"), F.col("text")).alias("key")
    )


# The documents with an offer or a price at their end, depending on language and length.
OFFERS = """SELECT doc_id, concat(text, CASE lang WHEN 'de' THEN ' Thanh_Lý xe' WHEN 'fr' THEN ' giaxe cần bánh'
  WHEN 'es' THEN concat(' giá ', cast(n_chars AS string), ' TR') ELSE concat(' ', cast(n_chars AS string), ' tram') END) AS text
  FROM {documents}"""


@case("flt_06_resale_posts", f"SELECT doc_id FROM {a.duck(OFFERS)} WHERE NOT {IS_SALE}")
def resale(t: Tables):
    return t.view(OFFERS).where(~text.is_sale(F.col("text"))).select("doc_id")


@case("flt_07_price_comments", f"SELECT doc_id FROM {a.duck(OFFERS)} WHERE NOT {PRICE}")
def price(t: Tables):
    return t.view(OFFERS).where(~text.names_price(F.col("text"))).select("doc_id")


@case("fn_13_comment_engagement", f"WITH {SCORED} SELECT comment_id, round(engagement_score, 6) AS engagement_score FROM scored")
def engagement(t: Tables):
    return tree(t).select("comment_id", measures.comment_engagement().alias("engagement_score"))


@case("win_05_burst_flag", f"""SELECT comment_id, author_id, {DAY} AS ingestion_date, is_reply, reaction_count,
  count(*) OVER (PARTITION BY author_id, ingestion_date) > 5 AS is_bot FROM {a.duck(a.ACTIVITY)}""")
def burst(t: Tables):
    return C.flag_bursts(t.view(a.ACTIVITY), limit=5, min_hot_rows=50)


@case("win_05_burst_flag_known_authors", f"""SELECT comment_id, author_id <> '' AND
  count(*) OVER (PARTITION BY author_id, ingestion_date) > 5 AS is_bot FROM {a.duck(a.ACTIVITY)}""")
def burst_known(t: Tables):
    return C.flag_bursts(t.view(a.ACTIVITY), limit=5, ignore_blank_author=True).select("comment_id", "is_bot")


@case("prj_16_fact_comments", f"""WITH {SCORED} SELECT comment_id, post_id, author_id, text, reaction_count, is_reply,
  parent_comment_id, round(engagement_score, 6) AS engagement_score, is_bot, sentiment_label,
  round(CAST(sentiment_score AS DOUBLE), 6) AS sentiment_score, {DAY} AS date, page_name FROM scored""")
def fact_comments(t: Tables):
    return C.fact_comments(scored(t))


def page_daily_sql(source: str) -> str:
    return f"""SELECT strftime(ingestion_date, '%Y-%m-%d') AS date, page_name, count(DISTINCT post_id) AS total_posts,
  count(*) AS total_comments, CAST(sum(is_reply::int) AS BIGINT) AS total_replies,
  count(*) FILTER (sentiment_label = 'positive') AS positive_count,
  count(*) FILTER (sentiment_label = 'negative') AS negative_count,
  count(*) FILTER (sentiment_label = 'neutral') AS neutral_count,
  {s.half_up('sum(reaction_count)', 'count(*)', 2)} AS avg_reaction_count,
  {s.half_up("count(*) FILTER (sentiment_label = 'positive')", 'count(*)')} AS positive_ratio,
  {s.half_up("count(*) FILTER (sentiment_label = 'negative')", 'count(*)')} AS negative_ratio
FROM {source} GROUP BY 1, 2"""


@case("agg_05_page_daily", f"WITH {SCORED} {page_daily_sql('scored')}")
def page_daily(t: Tables):
    return C.agg_page_daily(scored(t))


@case("agg_08_count_distinct", f"WITH {SCORED} SELECT count(DISTINCT post_id) AS posts, count(DISTINCT author_id) AS authors FROM scored")
def distinct(t: Tables):
    return scored(t).agg(F.count_distinct("post_id").alias("posts"), F.count_distinct("author_id").alias("authors"))


@case("prj_17_dim_posts", f"""WITH {SCORED} SELECT post_id, page_name, source_type, text,
  substr(coalesce(text, ''), 1, 200) AS text_preview, comment_count, sentiment_label, {DAY} AS ingestion_date, permalink FROM dim""")
def dimension(t: Tables):
    return dim_posts(t)


@case("prj_18_label_present_text", f"WITH {SCORED} SELECT post_id, sentiment_label FROM dim")
def present(t: Tables):
    return score_present_text(group_posts(t), load=lexicon_text_model(a.LEXICON)).select("post_id", "sentiment_label")


@case("qc_07_silver_checks", f"WITH {TREE} " + quality_sql("tree", [
    ("silver_comments_null_comment_id", "comment_id IS NULL", "fail"),
    ("silver_comments_null_post_id", "post_id IS NULL", "fail")]))
def silver_checks(t: Tables):
    return Q.report(tree(t), Q.silver_group_comment_checks())


@case("qc_08_fact_comment_checks", f"WITH {SCORED} " + quality_sql("scored", [
    ("fact_comments_null_keys", "comment_id IS NULL", "fail"),
    ("fact_comments_null_sentiment", "sentiment_label IS NULL", "fail")], "comment_id"))
def fact_checks(t: Tables):
    return Q.report(C.fact_comments(scored(t)), Q.fact_comment_checks(), unique="comment_id")


@case("qc_08_page_daily_checks", f"WITH {SCORED}, d AS (SELECT DISTINCT ingestion_date AS date, page_name FROM scored) "
      + quality_sql("d", [("agg_page_daily_null_keys", "false", "fail"), ("agg_page_daily_invalid_ratio", "false", "warn")]))
def page_checks(t: Tables):
    return Q.report(C.agg_page_daily(scored(t)), Q.page_daily_checks())


STANCE = SCORED + f""", eligible AS (SELECT post_id, text AS post_text FROM dim
  WHERE sentiment_label IS NOT NULL AND sentiment_label <> 'neutral' AND trim(text) <> ''),
stance AS (SELECT c.post_id, post_text, comment_id,
  array_to_string(list_slice(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), 1, 50), ' ') AS comment_text,
  CASE WHEN is_reply THEN 2 ELSE 1 END AS comment_level, parent_comment_id,
  CASE {s.stance('text', 'post_text')} WHEN 'agreement' THEN 'agree' WHEN 'disagreement' THEN 'disagree' ELSE 'neutral' END AS stance,
  ingestion_date, page_name
  FROM tree c JOIN eligible e ON c.post_id = e.post_id WHERE NOT {PRICE})"""


def group_stance(t: Tables, **kw):
    return C.group_stance(tree(t), dim_posts(t), lexicon=a.STANCE, **kw)


@case("ml_06_group_stance", f"WITH {STANCE} SELECT * REPLACE ({DAY} AS ingestion_date) FROM stance")
def stance(t: Tables):
    return group_stance(t, min_hot_rows=4)


@case("join_05_unprocessed_partitions", f"""WITH {STANCE} SELECT comment_id, stance FROM stance s
  WHERE NOT EXISTS (SELECT 1 FROM turns d WHERE d.role = 'system' AND d.page_name IN ('page0', 'page1') AND d.ingestion_date = s.ingestion_date
    AND d.page_name = s.page_name)""")
def unprocessed(t: Tables):
    done = t.turns.where("role = 'system' and page_name in ('page0', 'page1')").select("ingestion_date", "page_name")
    return group_stance(t, processed=done).select("comment_id", "stance")


@case("flt_08_eligible_posts", f"WITH {STANCE} SELECT post_id FROM eligible")
def eligible(t: Tables):
    return dim_posts(t).where(
        F.col("sentiment_label").isNotNull() & (F.col("sentiment_label") != "neutral") & ~text.is_blank(F.col("text"))
    ).select("post_id")


@case("join_06_post_text_lookup", f"""WITH {SCORED} SELECT c.comment_id, d.text AS post_text FROM tree c
  LEFT JOIN dim d ON c.post_id = d.post_id""")
def lookup(t: Tables):
    posts = dim_posts(t).select("post_id", F.col("text").alias("post_text"))
    return tree(t).join(posts, "post_id", "left").select("comment_id", "post_text")


@case("fn_15_first_tokens", r"""SELECT doc_id, array_to_string(list_slice(regexp_split_to_array(
  regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), 1, 50), ' ') AS tokens FROM documents""")
def tokens(t: Tables):
    return t.table("documents").select("doc_id", text.first_tokens(F.col("text"), 50).alias("tokens"))


@case("agg_10_controversial_posts", f"""WITH {STANCE}, g AS (SELECT post_id,
    count(*) FILTER (stance = 'agree') AS agree_count, count(*) FILTER (stance = 'disagree') AS disagree_count,
    count(*) AS total_comments FROM stance GROUP BY 1)
SELECT substr(coalesce(text, ''), 1, 200) AS text_preview, sentiment_label, page_name, permalink, agree_count,
  disagree_count, total_comments, CAST(floor(100.0 * agree_count / total_comments + 0.5) AS BIGINT) AS agree_pct,
  CAST(floor(100.0 * disagree_count / total_comments + 0.5) AS BIGINT) AS disagree_pct
FROM g JOIN dim d ON g.post_id = d.post_id ORDER BY total_comments DESC, g.post_id LIMIT 2""")
def controversial(t: Tables):
    return controversial_posts(group_stance(t), dim_posts(t))


CONTEXT = TREE + """, ctx AS (SELECT p.post_id, p.page_name, p.comment_count, p.ingestion_date,
  c.comment_id, c.author_name, c.text, c.is_reply, c.parent_comment_id,
  row_number() OVER (PARTITION BY p.post_id ORDER BY c.is_reply, c.comment_id) AS place
  FROM posts p LEFT JOIN tree c ON p.post_id = c.post_id WHERE comment_count >= 2)"""


def contexts(t: Tables, **kw):
    return TH.build_post_contexts(group_posts(t), tree(t), min_comments=2, **kw)


@case("conv_02_post_contexts", f"""WITH {CONTEXT} SELECT post_id, page_name, comment_count, {DAY} AS ingestion_date, 0 AS part,
  1 AS parts, place, comment_id, author_name, is_reply, parent_comment_id FROM ctx""")
def post_contexts(t: Tables):
    rows = contexts(t).select("*", F.posexplode_outer("comments").alias("pos", "c"))
    return rows.select(
        "post_id", "page_name", "comment_count", "ingestion_date", "part", "parts",
        (F.coalesce("pos", F.lit(0)) + 1).alias("place"), "c.comment_id", "c.author_name", "c.is_reply",
        "c.parent_comment_id",
    )


@case("join_11_contexts_in_parts", f"""WITH {CONTEXT} SELECT post_id, count(comment_id) AS comments, count(DISTINCT comment_id) AS ids
  FROM ctx GROUP BY 1""")
def contexts_in_parts(t: Tables):
    rows = contexts(t, part_size=2, min_hot_rows=3).select("post_id", F.explode_outer("comments").alias("c"))
    return rows.groupBy("post_id").agg(
        F.count("c.comment_id").alias("comments"), F.count_distinct("c.comment_id").alias("ids")
    )


@case("llm_01_group_prompt_text", f"""WITH {CONTEXT} SELECT post_id, string_agg(concat(CASE WHEN is_reply THEN '[Reply] ' ELSE '[Root] ' END,
  author_name, ': "', text, '"'), chr(10) ORDER BY place) AS conversation FROM ctx GROUP BY 1""")
def group_prompt(t: Tables):
    return contexts(t).select("post_id", TH.format_post(F.col("comments")).alias("conversation"))


@case("llm_01_prompt", f"""WITH {CONTEXT}, p AS (SELECT post_id, count(comment_id) AS n, string_agg(concat(
  CASE WHEN is_reply THEN '[Reply] ' ELSE '[Root] ' END, author_name, ': "', text, '"'), chr(10) ORDER BY place) AS conv
  FROM ctx GROUP BY 1) SELECT post_id, replace(replace('{GROUP_PROMPT}', '{{n}}', cast(n AS string)), '{{conversation_text}}', conv) AS prompt FROM p""")
def prompt(t: Tables):
    return TH.with_prompt(contexts(t), GROUP_PROMPT, TH.format_post(F.col("comments"))).select("post_id", "prompt")


@case("flt_09_min_comments", f"WITH {TREE} SELECT post_id FROM posts WHERE comment_count >= 2")
def min_comments(t: Tables):
    return contexts(t).select("post_id").distinct()


@case("flt_12_skip_analyzed", f"""WITH {TREE} SELECT post_id FROM posts WHERE comment_count >= 2
  AND post_id NOT IN (SELECT post_id FROM turns WHERE role = 'system')""")
def skip(t: Tables):
    return contexts(t, analyzed=t.turns.where("role = 'system'")).select("post_id").distinct()


STAMP = "published_at <> 'unknown'"
VIDEO = f"""raw AS (SELECT * FROM {a.duck(a.VIDEO)}),
video AS (SELECT * REPLACE ({s.clean('text')} AS text),
  CAST(replace(replace(published_at, 'T', ' '), 'Z', '') AS TIMESTAMP) AS published_at_ts
  FROM (SELECT * FROM raw WHERE comment_id IS NOT NULL AND text IS NOT NULL AND likes >= 0 AND {STAMP}))"""


def video(t: Tables):
    return C.silver_video_comments(t.raw_video)


@case("inc_05_silver_video", f"""WITH {VIDEO} SELECT video_id, comment_id, parent_id, author, text, likes, is_reply, published_at,
  strftime(published_at_ts, '%Y-%m-%d %H:%M:%S') AS published_at_ts, hour(published_at_ts) AS comment_hour,
  dayofweek(published_at_ts) + 1 AS comment_day_of_week, year(published_at_ts) AS year, month(published_at_ts) AS month,
  day(published_at_ts) AS day FROM video""")
def silver_video(t: Tables):
    return video(t)


@case("flt_03_complete_comments", "SELECT comment_id FROM " + a.duck(a.VIDEO) + " WHERE comment_id IS NOT NULL AND text IS NOT NULL AND published_at IS NOT NULL AND likes >= 0")
def complete_comments(t: Tables):
    return C.clean_video_comments(t.raw_video).select("comment_id")


@case("flt_04_valid_likes", "SELECT likes, count(*) AS n FROM " + a.duck(a.VIDEO) + " WHERE likes >= 0 GROUP BY 1")
def valid_likes(t: Tables):
    return C.clean_video_comments(t.raw_video).groupBy("likes").agg(F.count("*").alias("n"))


@case("fn_03_iso_timestamp", f"""SELECT comment_id, CASE WHEN {STAMP} THEN replace(replace(published_at, 'T', ' '), 'Z', '') END AS parsed
  FROM {a.duck(a.VIDEO)}""")
def iso(t: Tables):


    return t.raw_video.select("comment_id", parse_iso_timestamp(F.col("published_at")).alias("parsed"))


@case("qc_03_video_checks", f"WITH {VIDEO} " + quality_sql("video", [
    ("null_critical_fields", "false", "fail"), ("negative_likes", "likes < 0", "fail"),
    ("invalid_temporal_features", "false", "fail")]))
def video_checks(t: Tables):
    return Q.report(video(t), Q.video_comment_checks())


def brand_sql(words) -> str:
    return rf"regexp_matches(text, '(?i)(^|{EDGE})({'|'.join(words)})($|{EDGE})')"


NAMED = "list_filter([" + ", ".join(f"CASE WHEN {brand_sql(w)} THEN '{n}' END" for n, w in VIDEO_BRANDS) + "], lambda x: x IS NOT NULL)"
LABEL = s.label("text")
SENT = VIDEO + f""", sentiment AS (SELECT comment_id, video_id, text, unnest({NAMED}) AS brand_mentioned,
  concat(upper(substr({LABEL}, 1, 1)), substr({LABEL}, 2)) AS sentiment, author AS author_name, parent_id IS NULL AS is_root,
  year(published_at_ts) AS year, month(published_at_ts) AS month FROM video)"""


def sentiment(t: Tables, **kw):
    return C.video_sentiment(video(t), lexicon=a.LEXICON, **kw)


@case("fn_14_brand_mention", f"SELECT comment_id, {', '.join(f'{brand_sql(w)} AS {n.lower()}' for n, w in VIDEO_BRANDS)} FROM {a.duck(a.VIDEO)}")
def brand_mention(t: Tables):
    return t.raw_video.select("comment_id", *[text.mentions_any(F.col("text"), w).alias(n.lower()) for n, w in VIDEO_BRANDS])


@case("prj_19_row_per_brand", f"WITH {SENT} SELECT comment_id, brand_mentioned, is_root FROM sentiment")
def per_brand(t: Tables):
    return C.per_brand_mention(video(t)).select("comment_id", "brand_mentioned", "is_root")


@case("ml_07_video_sentiment", f"WITH {SENT} SELECT * FROM sentiment")
def video_sentiment(t: Tables):
    return sentiment(t)


@case("ml_03_aspect_sentiment_model", f"WITH {SENT} SELECT comment_id, brand_mentioned, sentiment FROM sentiment")
def aspect_model(t: Tables):
    return C.video_sentiment(video(t), load=lexicon_text_model(a.LEXICON)).select("comment_id", "brand_mentioned", "sentiment")


@case("agg_17_video_sentiment_counts", f"WITH {SENT} SELECT brand_mentioned, sentiment, count(*) AS total_comments FROM sentiment GROUP BY 1, 2")
def sentiment_counts(t: Tables):
    return video_sentiment_counts(t.spark, sentiment(t))


VSTANCE = SENT + f""", links AS (SELECT r.comment_id, r.video_id, r.parent_id, {s.stance('r.text', 'p.text')} AS stance_label
  FROM video r JOIN video p ON r.parent_id = p.comment_id AND r.video_id = p.video_id WHERE r.parent_id IS NOT NULL)"""


def stance_rows(t: Tables, **kw):
    return C.video_stance(video(t), lexicon=a.STANCE, **kw)


@case("join_04_replies_with_parents", f"""WITH {VIDEO} SELECT r.comment_id, r.text, p.text AS parent_text
  FROM video r JOIN video p ON r.parent_id = p.comment_id""")
def pairs(t: Tables):
    return C.replies_with_parents(video(t), min_hot_rows=5).select("comment_id", "text", "parent_text")


@case("ml_05_video_stance", f"WITH {VSTANCE} SELECT * FROM links")
def video_stance(t: Tables):
    return stance_rows(t)


@case("ml_04_pair_model", f"WITH {VSTANCE} SELECT comment_id, stance_label FROM links")
def pair_model(t: Tables):
    return C.video_stance(video(t), load=lexicon_pair_model(a.STANCE)).select("comment_id", "stance_label")


MIN_REPLIES = 3
THREADS = VSTANCE + f""", cand AS (SELECT video_id, parent_id AS thread_id, count(*) AS reply_count FROM links GROUP BY 1, 2
  HAVING count(*) > {MIN_REPLIES}),
linked AS (SELECT s.*, CASE WHEN is_root THEN s.comment_id ELSE l.parent_id END AS thread_id
  FROM sentiment s LEFT JOIN links l ON s.comment_id = l.comment_id AND s.video_id = l.video_id),
docs AS (SELECT k.*, row_number() OVER (PARTITION BY k.thread_id ORDER BY NOT is_root, comment_id, text, brand_mentioned) AS place,
  count(*) OVER (PARTITION BY k.thread_id) AS brand_comment_count
  FROM linked k JOIN cand c ON k.thread_id = c.thread_id AND k.video_id = c.video_id)"""


def documents(t: Tables, **kw):
    return TH.build_threads(sentiment(t), stance_rows(t), min_replies=MIN_REPLIES, **kw)


@case("agg_07_reply_counts", f"WITH {VSTANCE} SELECT video_id, parent_id AS thread_id, count(*) AS reply_count FROM links GROUP BY 1, 2")
def reply_counts(t: Tables):
    return TH.reply_counts(stance_rows(t))


@case("flt_10_large_threads", f"WITH {THREADS} SELECT * FROM cand")
def large_threads(t: Tables):
    return TH.candidate_threads(stance_rows(t), MIN_REPLIES)


@case("flt_12_unanalyzed_threads", f"""WITH {THREADS} SELECT video_id, thread_id FROM cand
  WHERE thread_id NOT IN (SELECT comment_id FROM turns0)""".replace("WITH ", f"WITH turns0 AS (SELECT comment_id FROM {a.duck(a.TURNS)} WHERE turn = 0 AND role = 'system'), ", 1))
def unanalyzed(t: Tables):
    done = t.turns.where("turn = 0 AND role = 'system'").selectExpr("video_id", "comment_id AS thread_id")
    return TH.candidate_threads(stance_rows(t), MIN_REPLIES, done).select("video_id", "thread_id")


@case("join_03_rows_with_thread", f"WITH {THREADS} SELECT comment_id, brand_mentioned, thread_id FROM linked WHERE thread_id IS NOT NULL")
def with_thread(t: Tables):
    return TH.thread_rows(sentiment(t), stance_rows(t)).select("comment_id", "brand_mentioned", "thread_id")


@case("conv_01_build_threads", f"""WITH {THREADS} SELECT thread_id, video_id, brand_comment_count, place, comment_id, text, brand_mentioned,
  sentiment, author_name, is_root FROM docs""")
def threads(t: Tables):
    rows = documents(t).select("thread_id", "video_id", "brand_comment_count", F.posexplode("comments").alias("pos", "c"))
    return rows.select("thread_id", "video_id", "brand_comment_count", (F.col("pos") + 1).alias("place"), "c.*")


@case("sort_04_threads_in_parts", f"""WITH {THREADS} SELECT thread_id, brand_comment_count, count(*) AS comments,
  count(DISTINCT comment_id) AS ids, true AS root_first FROM docs GROUP BY 1, 2""")
def threads_in_parts(t: Tables):
    docs = documents(t, part_size=2, min_hot_rows=4)
    rows = docs.select("thread_id", "brand_comment_count", "part", F.posexplode("comments").alias("pos", "c"))
    first = (~F.col("c.is_root")) | ((F.col("part") == 0) & (F.col("pos") < 2))
    return rows.groupBy("thread_id", "brand_comment_count").agg(
        F.count("*").alias("comments"), F.count_distinct("c.comment_id").alias("ids"), F.bool_and(first).alias("root_first")
    )


@case("flt_11_semi_join", f"""WITH {THREADS} SELECT comment_id FROM video WHERE parent_id IN (SELECT thread_id FROM cand)""")
def semi(t: Tables):
    ids = TH.candidate_threads(stance_rows(t), MIN_REPLIES).selectExpr("thread_id AS parent_id")
    return C.skew_join(video(t), ids, ["parent_id"], "left_semi", spread=["comment_id"], min_rows=4).select("comment_id")


@case("llm_01_thread_prompt_text", f"""WITH {THREADS} SELECT thread_id, string_agg(concat(CASE WHEN is_root THEN '[Root]' ELSE '[Reply]' END,
  '[', brand_mentioned, '] ', author_name, ': "', text, '"'), chr(10) ORDER BY place) AS conversation FROM docs GROUP BY 1""")
def thread_prompt(t: Tables):
    return documents(t).select("thread_id", TH.format_thread(F.col("comments")).alias("conversation"))


@case("join_07_stance_with_posts", f"""WITH {STANCE}, g AS (SELECT post_id, count(*) FILTER (stance = 'agree') AS agree_count,
  count(*) AS total_comments FROM stance GROUP BY 1)
SELECT g.*, d.sentiment_label, d.page_name FROM g JOIN dim d ON g.post_id = d.post_id""")
def stance_with_posts(t: Tables):
    counts = group_stance(t).groupBy("post_id").agg(
        F.count_if(F.col("stance") == "agree").alias("agree_count"), F.count("*").alias("total_comments")
    )
    return counts.join(dim_posts(t).select("post_id", "sentiment_label", "page_name"), "post_id")


@case("prj_20_stance_levels", f"WITH {STANCE} SELECT comment_level, stance, count(*) AS n FROM stance GROUP BY 1, 2")
def stance_levels(t: Tables):
    return group_stance(t).groupBy("comment_level", "stance").agg(F.count("*").alias("n"))


@case("prj_23_optional_permalink", f"WITH {SCORED} SELECT post_id, text, comment_count FROM dim")
def optional_permalink(t: Tables):
    posts = C.dim_group_posts(score_present_text(group_posts(t).drop("permalink"), lexicon=a.LEXICON))
    assert "permalink" not in posts.columns
    return posts.select("post_id", "text", "comment_count")


@case("set_02_union_roots_and_replies", f"""WITH {TREE} SELECT comment_id, is_reply FROM tree WHERE NOT is_reply
  UNION ALL SELECT comment_id, is_reply FROM tree WHERE is_reply""")
def union_roots_and_replies(t: Tables):
    rows = tree(t)
    roots = rows.where("not is_reply").select("is_reply", "comment_id")
    return roots.unionByName(rows.where("is_reply").select("comment_id", "is_reply"))
