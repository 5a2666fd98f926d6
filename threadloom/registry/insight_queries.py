"""Insight tables, reports, run history, evaluation."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from threadloom import contracts
from threadloom.catalogue import Vocabulary
from threadloom.functions import measures, moments, text
from threadloom.operators import comments as C
from threadloom.operators import evaluation as E
from threadloom.operators import insights as I
from threadloom.operators import reports as R
from threadloom.operators import runs as U
from threadloom.operators.dedup import duplicate_keys, duplicate_summary, latest_by
from threadloom.operators.labelling import train
from threadloom.operators.scoring import label_with_answerer, score_text
from threadloom.plans import group, video
from threadloom.registry import adapters as a
from threadloom.registry import sqltext as s
from threadloom.registry.adapters import Tables
from threadloom.registry.comment_queries import CONTEXT, THREADS, contexts, documents
from threadloom.registry.core import case

ITEMS = f"items AS (SELECT * FROM {a.duck(a.INSIGHTS)})"
DAY = "strftime(ingestion_date, '%Y-%m-%d')"
VIDEO_VOCAB = Vocabulary(
    entities=("view", "click", "purchase"), aspects=None, aliases=(("view", "click"),), entity_field="entity",
    fold_case=True,
)


def items(t: Tables):
    return t.view(a.INSIGHTS)


VALID = ITEMS + """, valid AS (SELECT post_id, page_name, model_entity, aspect,
  CASE WHEN sentiment IN ('positive', 'negative', 'neutral', 'mixed') THEN sentiment ELSE 'neutral' END AS sentiment,
  CASE WHEN intensity IN ('strong', 'moderate', 'mild') THEN intensity ELSE 'mild' END AS intensity,
  greatest(mention_count, 1) AS mention_count, evidence, ingestion_date, event_id FROM items
  WHERE model_entity IN ('view', 'click', 'signup', 'purchase') AND aspect IN ('a0', 'a1', 'a2', 'a3', 'a4', 'a5'))"""


@case("llm_04_validate_insights", f"WITH {VALID} SELECT * REPLACE ({DAY} AS ingestion_date) FROM valid")
def validate(t: Tables):
    return I.validate_post_insights(items(t), a.VOCABULARY).drop("thread_id", "video_id")


@case("flt_13_vocabulary_filter", f"WITH {VALID} SELECT model_entity, aspect, count(*) AS n FROM valid GROUP BY 1, 2")
def vocabulary(t: Tables):
    return I.in_vocabulary(items(t), a.VOCABULARY).groupBy("model_entity", "aspect").agg(F.count("*").alias("n"))


@case("fn_17_default_fields", f"WITH {VALID} SELECT sentiment, intensity, mention_count, count(*) AS n FROM valid GROUP BY 1, 2, 3")
def defaults(t: Tables):
    rows = I.default_fields(I.in_vocabulary(items(t), a.VOCABULARY))
    return rows.groupBy("sentiment", "intensity", "mention_count").agg(F.count("*").alias("n"))


@case("fn_18_intensity_rank", f"""WITH {ITEMS} SELECT event_id, CASE intensity WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END AS weekly,
  CASE intensity WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 WHEN 'mild' THEN 1 ELSE 0 END AS merging FROM items""")
def ranks(t: Tables):
    return items(t).select(
        "event_id", measures.intensity_rank(F.col("intensity")).alias("weekly"),
        measures.intensity_rank(F.col("intensity"), otherwise=0).alias("merging"),
    )


WEEKLY = f"""g AS (SELECT CAST(date_trunc('week', ingestion_date) AS DATE) AS week_start, model_entity, aspect,
  CAST(sum(mention_count) AS BIGINT) AS total_mentions,
  sum(CASE WHEN sentiment = 'positive' THEN mention_count ELSE 0 END) AS pos,
  sum(CASE WHEN sentiment = 'negative' THEN mention_count ELSE 0 END) AS neg,
  {s.half_up("sum(CASE intensity WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END)", 'count(*)', 2)} AS avg_intensity_score
  FROM items GROUP BY 1, 2, 3),
w AS (SELECT strftime(week_start, '%Y-%m-%d') AS week_start, model_entity, aspect, total_mentions, avg_intensity_score,
  {s.half_up('pos', 'total_mentions')} AS positive_ratio, {s.half_up('neg', 'total_mentions')} AS negative_ratio,
  lag(total_mentions) OVER (PARTITION BY model_entity, aspect ORDER BY g.week_start) AS prev_week_mentions FROM g)"""
TREND = """CASE WHEN total_mentions > prev_week_mentions * 1.3 AND negative_ratio > 0.5 THEN 'rising'
  WHEN total_mentions < prev_week_mentions * 0.7 THEN 'falling' ELSE 'stable' END AS trend_direction"""


@case("agg_06_issue_weekly", f"WITH {ITEMS}, {WEEKLY} SELECT *, {TREND} FROM w")
def weekly(t: Tables):
    return C.agg_issue_weekly(items(t))


@case("win_06_previous_week", f"WITH {ITEMS}, {WEEKLY} SELECT week_start, model_entity, aspect, prev_week_mentions FROM w")
def previous(t: Tables):
    return C.agg_issue_weekly(items(t)).select("week_start", "model_entity", "aspect", "prev_week_mentions")


@case("win_07_trend_counts", f"WITH {ITEMS}, {WEEKLY}, x AS (SELECT *, {TREND} FROM w) SELECT trend_direction, count(*) AS n FROM x GROUP BY 1")
def trends(t: Tables):
    return C.agg_issue_weekly(items(t)).groupBy("trend_direction").agg(F.count("*").alias("n"))


@case("fn_19_ratio", f"""WITH {ITEMS} SELECT model_entity, {s.half_up("count(*) FILTER (sentiment = 'negative')", 'count(*)')} AS share
  FROM items GROUP BY 1""")
def ratio(t: Tables):
    return items(t).groupBy("model_entity").agg(
        measures.ratio(F.count_if(F.col("sentiment") == "negative"), F.count("*")).alias("share")
    )


@case("fn_23_week_start", "SELECT event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start FROM events")
def week(t: Tables):
    return t.table("events").select("event_id", moments.week_start(F.col("ts").cast("timestamp")).alias("week_start"))


def answers(t: Tables):
    """One answer per event: its item as a JSON array, wrapped in prose, broken, or with a bad count."""
    item = F.to_json(F.struct(
        F.col("model_entity").alias("entity"), "aspect", "sentiment", "intensity",
        F.when(F.col("intensity") == "huge", F.lit("many")).otherwise(F.col("mention_count").cast("string"))
        .alias("mention_count"), "evidence",
    ))
    shape = F.pmod(F.col("event_id"), F.lit(5))
    raw = (
        F.when(shape == 0, F.concat(F.lit("["), item, F.lit("]")))
        .when(shape == 1, F.concat(F.lit("Here you are:\n["), item, F.lit(", "), item, F.lit("]\nDone.")))
        .when(shape == 2, F.lit("nothing to report"))
        .when(shape == 3, F.concat(F.lit("["), item, F.lit(" {broken]")))
        .otherwise(F.concat(F.lit("```json\n["), item, F.lit("]\n```")))
    )
    return items(t).select("event_id", "video_id", "thread_id", raw.alias("raw"))


PARSED = ITEMS + """, one AS (SELECT *, event_id % 5 AS shape FROM items WHERE intensity <> 'huge' AND event_id % 5 IN (0, 1, 4)),
parsed AS (SELECT event_id, video_id, thread_id, pos, CASE model_entity WHEN 'view' THEN 'click' ELSE model_entity END AS entity,
  aspect, sentiment, intensity, mention_count, evidence
  FROM one, (VALUES (0), (1)) p(pos) WHERE model_entity IN ('view', 'click', 'purchase') AND (pos = 0 OR shape = 1))"""


def parsed(t: Tables, **kw):
    return I.parse_answers(answers(t), VIDEO_VOCAB, keep=["event_id", "video_id", "thread_id"], **kw)


@case("llm_02_parse_answers", f"WITH {PARSED} SELECT * FROM parsed")
def parse(t: Tables):
    return parsed(t)


@case("llm_02_parse_answers_strict", f"WITH {PARSED} SELECT event_id, pos, mention_count FROM parsed")
def parse_strict(t: Tables):
    return parsed(t, strict=True).select("event_id", "pos", "mention_count")


@case("fn_16_entity_names", f"WITH {PARSED} SELECT entity, count(*) AS n FROM parsed GROUP BY 1")
def entity_names(t: Tables):
    return parsed(t).groupBy("entity").agg(F.count("*").alias("n"))


RANK = "CASE intensity WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 WHEN 'mild' THEN 1 ELSE 0 END"


def merged_sql(source: str, keys: str, entity: str = "entity") -> str:
    """``source`` has the item columns and an ``ord`` giving the item order."""
    return f"""votes AS (SELECT {keys}, {entity}, aspect, sentiment, count(*) AS n FROM {source} GROUP BY ALL),
top AS (SELECT {keys}, {entity}, aspect, CASE WHEN count(*) = 1 THEN min(sentiment) ELSE 'mixed' END AS sentiment
  FROM (SELECT *, max(n) OVER (PARTITION BY {keys}, {entity}, aspect) AS best FROM votes) WHERE n = best
  GROUP BY ALL),
lead AS (SELECT {keys}, {entity}, aspect, intensity, evidence FROM (SELECT *, row_number() OVER (
  PARTITION BY {keys}, {entity}, aspect ORDER BY {RANK} DESC, ord, intensity, evidence) AS rn FROM {source}) WHERE rn = 1),
total AS (SELECT {keys}, {entity}, aspect, CAST(sum(mention_count) AS BIGINT) AS mention_count FROM {source}
  GROUP BY ALL),
merged AS (SELECT * FROM top NATURAL JOIN lead NATURAL JOIN total)"""


MERGED = ITEMS + ", src AS (SELECT *, CASE model_entity WHEN 'view' THEN 'click' ELSE model_entity END AS entity, event_id AS ord FROM items), " + merged_sql("src", "video_id, thread_id")


def merged(t: Tables):
    rows = items(t).withColumnsRenamed({"model_entity": "entity", "event_id": "pos"})
    return I.merge_thread_insights(rows, ["video_id", "thread_id"], VIDEO_VOCAB)


@case("agg_09_merge_insights", f"WITH {MERGED} SELECT * FROM merged")
def merge(t: Tables):
    return merged(t)


# A thread table as the reports read it: merged insights with the size of their thread.
TABLE = MERGED + """, tbl AS (SELECT m.*, n AS brand_comment_count FROM merged m JOIN (
  SELECT video_id, thread_id, count(*) AS n FROM items GROUP BY 1, 2) c
  ON m.thread_id = c.thread_id AND m.video_id = c.video_id)"""


def insight_table(t: Tables):
    sizes = items(t).groupBy("video_id", "thread_id").agg(F.count("*").alias("brand_comment_count"))
    return I.stamp_analysis(merged(t).join(sizes, ["video_id", "thread_id"]), "2024-02-03 04:05:06")


SENT = ("positive", "negative", "neutral", "mixed")
PIVOT = ", ".join(f"CAST(coalesce(sum(mention_count) FILTER (sentiment = '{v}'), 0) AS BIGINT) AS {v}" for v in SENT)


@case("agg_11_entity_scorecard", f"""WITH {TABLE}, e AS (SELECT entity, CAST(sum(mention_count) AS BIGINT) AS total_mentions, {PIVOT} FROM tbl GROUP BY 1),
x AS (SELECT entity, aspect, row_number() OVER (PARTITION BY entity ORDER BY sum(mention_count) DESC, aspect) AS rn FROM tbl GROUP BY 1, 2)
SELECT e.*, replace(aspect, '_', ' ') AS top_aspect, {', '.join(f"CAST(floor(100.0 * {v} / total_mentions + 0.5) AS BIGINT) AS {v}_pct" for v in SENT)}
FROM e JOIN x ON e.entity = x.entity AND rn = 1""")
def scorecard(t: Tables):
    return R.entity_scorecard(insight_table(t))


@case("agg_12_aspect_breakdown", f"""WITH {TABLE} SELECT replace(aspect, '_', ' ') AS aspect, {PIVOT},
  CAST(sum(mention_count) AS BIGINT) AS total FROM tbl WHERE entity = 'click' GROUP BY tbl.aspect
  ORDER BY total DESC, tbl.aspect LIMIT 10""")
def breakdown(t: Tables):
    return R.aspect_breakdown(insight_table(t), "click")


@case("agg_13_top_threads", f"""WITH {TABLE}, big AS (SELECT video_id, thread_id, max(brand_comment_count) AS size, count(*) AS insights
  FROM tbl GROUP BY 1, 2 ORDER BY size DESC, video_id, thread_id LIMIT 6),
r AS (SELECT b.video_id, b.thread_id, size, insights, entity, aspect, mention_count,
  row_number() OVER (PARTITION BY b.thread_id ORDER BY mention_count DESC, entity, aspect) AS rank
  FROM tbl t JOIN big b ON t.thread_id = b.thread_id AND t.video_id = b.video_id)
SELECT video_id, thread_id, size AS brand_comment_count, insights,
  max(CASE WHEN rank = 1 THEN concat(entity, '/', aspect, '/', cast(mention_count AS string)) END) AS headline,
  string_agg(CASE WHEN rank BETWEEN 2 AND 4 THEN concat(entity, '/', aspect, '/', cast(mention_count AS string)) END, ',' ORDER BY rank) AS others
FROM r GROUP BY 1, 2, 3, 4""")
def top_threads(t: Tables):
    def short(c):
        return F.concat_ws("/", c["entity"], c["aspect"], c["mention_count"].cast("string"))

    return R.top_threads(insight_table(t)).withColumns({
        "headline": short(F.col("headline")), "others": F.transform("others", short),
    })


@case("agg_14_report_totals", f"""WITH {TABLE} SELECT CAST(sum(mention_count) AS BIGINT) AS total_mentions,
  count(DISTINCT thread_id) AS threads, count(DISTINCT video_id) AS videos FROM tbl""")
def totals(t: Tables):
    return R.insight_totals(insight_table(t))


@case("flt_14_video_filter", f"""WITH {TABLE} SELECT CAST(sum(mention_count) AS BIGINT) AS total_mentions,
  count(DISTINCT thread_id) AS threads, count(DISTINCT video_id) AS videos FROM tbl WHERE video_id = 'v1'""")
def one_video(t: Tables):
    return R.insight_totals(R.for_video(insight_table(t), "v1"))


@case("prj_21_report_columns", f"""WITH {TABLE} SELECT *, '2024-02-03T04:05:06Z' AS analyzed_at FROM tbl""")
def report_columns(t: Tables):
    return R.thread_insight_rows(insight_table(t))


@case("prj_22_nan_to_null", """SELECT event_id, CASE WHEN event_type <> 'view' THEN round(value, 6) END AS score FROM events""")
def nan(t: Tables):
    score = F.when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(F.col("value"))
    return R.nan_to_null(t.table("events").select("event_id", score.alias("score")))


@case("fn_20_percent", """SELECT user_id, CAST(floor(100.0 * count(*) FILTER (event_type = 'click') / count(*) + 0.5) AS BIGINT) AS clicks
  FROM events GROUP BY 1""")
def percent(t: Tables):
    return t.table("events").groupBy("user_id").agg(
        measures.percent(F.count_if(F.col("event_type") == "click"), F.count("*")).alias("clicks")
    )


FLAGGED = "(nicht|que|the[ny])"


@case("fn_21_mask", f"SELECT doc_id, regexp_replace(text, '{FLAGGED}', '***', 'g') AS masked FROM documents")
def mask(t: Tables):
    return t.table("documents").select("doc_id", text.mask_profanity(F.col("text"), pattern=FLAGGED).alias("masked"))


@case("fn_21_segments", f"""SELECT doc_id, text, len(regexp_extract_all(text, '{FLAGGED}')) AS flagged FROM documents""")
def segments(t: Tables):
    parts = t.table("documents").select("doc_id", text.profanity_segments(F.col("text"), FLAGGED).alias("s"))
    return parts.select(
        "doc_id", F.array_join(F.transform("s", lambda p: p["text"]), "").alias("text"),
        F.size(F.filter("s", lambda p: p["flagged"])).alias("flagged"),
    )


@case("ml_02_answerer_labels", """SELECT user_id, c_name, CASE WHEN contains(c_name, '7') THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  1.0::DOUBLE AS sentiment_score FROM (SELECT c_custkey AS user_id, c_name FROM customer)""")
def answerer(t: Tables):
    def answer(prompt: str) -> str:
        rows = [{"index": int(n), "label": "negative" if "7" in name else "unsure"}
                for n, name in re.findall(r"^(\d+)\. (.*)$", prompt, re.MULTILINE)]
        return "Labels:\n" + json.dumps(rows)

    rows = t.table("customer").selectExpr("c_custkey AS user_id", "c_name")
    return label_with_answerer(rows, answer, "c_name", batch=50)


@case("ml_02_failed_answerer", "SELECT c_custkey, 'neutral' AS sentiment_label, 1.0::DOUBLE AS sentiment_score, false AS scored FROM customer")
def failing_answerer(t: Tables):
    def answer(prompt: str) -> str:
        raise TimeoutError("no answer")

    rows = t.table("customer").select("c_custkey", "c_name")
    return label_with_answerer(rows, answer, "c_name", flag_failures=True).drop("c_name")


def lines_as_items(field: str):
    """A stand-in answerer for conversations: one item about each comment that names a brand."""

    def answer(prompt: str) -> str:
        lines = re.findall(r"^\[(Root|Reply)\](?:\[(\w+)\])? ", prompt, re.MULTILINE)
        rows = [{field: (brand or kind).lower(), "aspect": "overall" if kind == "Root" else "price",
                 "sentiment": "positive", "intensity": "strong", "mention_count": 1, "evidence": kind}
                for kind, brand in lines]
        return "```json\n" + json.dumps(rows) + "\n```"

    return answer


@case("llm_06_thread_insights", f"""WITH {THREADS} SELECT thread_id, video_id, lower(brand_mentioned) AS entity,
  CASE WHEN is_root THEN 'overall' ELSE 'price' END AS aspect, 'positive' AS sentiment, 'strong' AS intensity,
  count(*) AS mention_count, CASE WHEN is_root THEN 'Root' ELSE 'Reply' END AS evidence, brand_comment_count,
  '2024-02-03 04:05:06' AS analyzed_at, 2024 AS year, 2 AS month FROM docs GROUP BY ALL""")
def thread_insights(t: Tables):
    return video.thread_insights(documents(t), lines_as_items("entity"), "2024-02-03 04:05:06")


@case("llm_06_thread_insights_in_parts", f"""WITH {THREADS} SELECT thread_id, lower(brand_mentioned) AS entity,
  CASE WHEN is_root THEN 'overall' ELSE 'price' END AS aspect, count(*) AS mention_count FROM docs GROUP BY ALL""")
def thread_insights_parts(t: Tables):
    rows = video.thread_insights(documents(t, part_size=2), lines_as_items("entity"), "2024-02-03 04:05:06")
    return rows.select("thread_id", "entity", "aspect", "mention_count")


@case("llm_05_post_insights", f"""WITH {CONTEXT} SELECT post_id, page_name, CASE WHEN is_reply THEN 'reply' ELSE 'root' END AS model_entity,
  CASE WHEN is_reply THEN 'price' ELSE 'overall' END AS aspect, 'positive' AS sentiment, 'strong' AS intensity,
  1 AS mention_count, CASE WHEN is_reply THEN 'Reply' ELSE 'Root' END AS evidence, {DAY} AS ingestion_date,
  '2024-02-03 04:05:06' AS analyzed_at FROM ctx WHERE comment_id IS NOT NULL""")
def post_insights(t: Tables):
    vocab = Vocabulary(entities=("root", "reply"), aspects=("overall", "price"), entity_field="model_entity")
    return group.post_insights(contexts(t), lines_as_items("model_entity"), "2024-02-03 04:05:06", vocab)


RUNS = f"""runs AS (SELECT run_id, job, state, coalesce(start_date, logical_date) AS start_date,
  CASE WHEN state = 'success' THEN cast(seconds AS DOUBLE) ELSE round(epoch(TIMESTAMP '2000-01-01 00:00:00')
    - epoch(coalesce(start_date, logical_date)), 1) END AS duration_seconds
  FROM {a.duck(a.RUNS)})"""


def clean_runs(t: Tables):
    rows = t.view(a.RUNS).withColumn(
        "end_date", F.when(F.col("state") == "success", F.timestamp_seconds(F.unix_timestamp("start_date") + F.col("seconds")))
    )
    return U.clean_runs(rows, "2000-01-01 00:00:00")


@case("run_01_clean_runs", f"""WITH {RUNS} SELECT run_id, job, state, strftime(start_date, '%Y-%m-%d %H:%M:%S') AS start_date,
  duration_seconds FROM runs""")
def clean(t: Tables):
    return clean_runs(t).select("run_id", "job", "state", "start_date", "duration_seconds")


@case("fn_22_duration_label", f"""WITH {RUNS} SELECT run_id, CASE WHEN duration_seconds IS NULL THEN '—'
  WHEN floor(duration_seconds / 60) = 0 THEN concat(cast(cast(round(duration_seconds) AS BIGINT) AS string), 's')
  ELSE concat(cast(cast(floor(duration_seconds / 60) AS BIGINT) AS string), 'm ',
    cast(cast(duration_seconds - 60 * floor(duration_seconds / 60) AS BIGINT) AS string), 's') END AS duration_label FROM runs""")
def labels(t: Tables):
    return clean_runs(t).select("run_id", "duration_label")


@case("run_02_last_runs", f"""WITH {RUNS} SELECT job, run_id, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY job ORDER BY start_date DESC, run_id DESC) AS rank FROM runs) WHERE rank <= 10""")
def last(t: Tables):
    return U.last_runs(clean_runs(t), 10).select("job", "run_id", "rank")


@case("win_09_latest_run", f"""WITH {RUNS} SELECT job, arg_max(run_id, (start_date, run_id)) AS run_id FROM runs GROUP BY 1""")
def latest_run(t: Tables):
    return latest_by(clean_runs(t).select("job", "start_date", "run_id"), ["job"], ["start_date", "run_id"]).drop("start_date")


@case("run_03_task_grid", """WITH r AS (SELECT cast(o_orderkey AS string) AS run_id FROM orders),
e AS (SELECT run_id, 'l' || cast(k AS string) AS task_id FROM r, (VALUES (1), (2), (3)) v(k)),
t AS (SELECT cast(l_orderkey AS string) AS run_id, 'l' || cast(l_linenumber AS string) AS task_id,
  max(l_linestatus) AS state, count(*) AS try_number FROM lineitem GROUP BY 1, 2)
SELECT e.run_id, e.task_id, coalesce(state, 'none') AS state, coalesce(try_number, 0) AS try_number
FROM e LEFT JOIN t ON e.run_id = t.run_id AND e.task_id = t.task_id""")
def grid(t: Tables):
    expected = t.table("orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.explode(F.array(F.lit("l1"), F.lit("l2"), F.lit("l3"))).alias("task_id"),
    )
    tasks = t.table("lineitem").groupBy(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("task_id"),
    ).agg(F.max("l_linestatus").alias("state"), F.count("*").alias("try_number"))
    return U.task_grid(expected, tasks)


LABELLED = f"l AS (SELECT *, {s.label('text')} AS predicted FROM {a.duck(a.LABELLED)})"


def predicted(t: Tables):
    return score_text(t.view(a.LABELLED), lexicon=a.LEXICON).withColumnRenamed("sentiment_label", "predicted")


@case("eval_01_split", """SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('42:' || cast(doc_id AS string)), 1, 8) AS BIGINT) % 100 < 80
  THEN 'train' ELSE 'test' END AS split FROM documents""")
def split(t: Tables):
    return E.with_split(t.table("documents").select("doc_id"), "doc_id")


@case("eval_02_model_labels", f"""WITH {LABELLED} SELECT doc_id, predicted AS sentiment_label FROM l""")
def model_labels(t: Tables):
    code = F.when(F.col("predicted") == "negative", "LABEL_0").when(F.col("predicted") == "neutral", "LABEL_1").otherwise("LABEL_2")
    return predicted(t).select("doc_id", E.map_model_labels(code).alias("sentiment_label"))


@case("agg_19_label_distribution", f"WITH {LABELLED} SELECT label, count(*) AS n FROM l GROUP BY 1")
def distribution(t: Tables):
    return E.label_distribution(predicted(t))


@case("eval_03_accuracy", f"""WITH {LABELLED} SELECT count(*) AS n, count(*) FILTER (label = predicted) AS correct,
  round(avg((label = predicted)::int), 6) AS accuracy FROM l""")
def accuracy(t: Tables):
    return E.accuracy(predicted(t))


@case("eval_04_confusion_matrix", f"""WITH {LABELLED} SELECT label, {', '.join(f"count(*) FILTER (predicted = '{v}') AS {v}" for v in SENT[:3])}
  FROM l GROUP BY 1""")
def confusion(t: Tables):
    return E.confusion_matrix(predicted(t), SENT[:3])


@case("eval_05_macro_f1", f"""WITH {LABELLED}, s AS (SELECT unnest(CASE WHEN label = predicted THEN [label] ELSE [label, predicted] END) AS name, label = predicted AS hit FROM l),
e AS (SELECT name, sum(CASE WHEN hit THEN 2 ELSE 0 END) / sum(CASE WHEN hit THEN 2 ELSE 1 END) AS f1 FROM s GROUP BY 1)
SELECT count(*) AS labels, round(avg(f1), 6) AS macro_f1 FROM e""")
def macro_f1(t: Tables):
    return E.macro_f1(predicted(t))


def held_out_labels(t: Tables):
    """Labels of the texts kept from training, by a labeller trained on the others and by the lexicon."""
    rows = E.with_split(t.view(a.LABELLED), "doc_id").select("doc_id", "text", "label", "split")
    labeller = train(rows.where("split = 'train'"))
    test = score_text(rows.where("split = 'test'"), labeller=labeller).withColumnRenamed("sentiment_label", "trained").drop("sentiment_score")
    return score_text(test, lexicon=a.LEXICON).withColumnRenamed("sentiment_label", "by_lexicon").drop("sentiment_score", "text", "split")


@case("ml_09_trained_labeller")
def trained_labeller(t: Tables):
    return held_out_labels(t)


@case("set_07_duplicate_keys", """SELECT user_id, event_type, ts, n AS "rows" FROM (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS ts,
  count(*) AS n FROM events GROUP BY ALL) WHERE n > 1""")
def duplicates(t: Tables):
    rows = t.table("events").select(F.struct(
        "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("ts")).alias("k"))
    return duplicate_keys(rows, "k").select("k.*", "rows")


@case("set_07_duplicate_summary", """SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS "unique", CAST(sum(n - 1) AS BIGINT) AS duplicates,
  count(*) FILTER (n > 1) AS repeated_keys FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)""")
def summary(t: Tables):
    return duplicate_summary(t.table("documents"), "text")


@case("set_03_latest_by_key", """SELECT text, max(doc_id) AS doc_id FROM documents GROUP BY 1""")
def latest(t: Tables):
    return latest_by(t.table("documents").select("text", "doc_id"), ["text"], ["doc_id"])


@case("set_04_distinct", "SELECT DISTINCT lang, source FROM documents")
def distinct(t: Tables):
    return t.table("documents").select("lang", "source").distinct()


@case("agg_18_quality_counters", f"""WITH {TABLE} SELECT unnest(['aspect', 'entity', 'month', 'thread_id', 'video_id', 'year']) AS column_name, 0 AS null_rows FROM (SELECT 1)""")
def counters(t: Tables):
    return contracts.required_nulls(insight_table(t), contracts.THREAD_INSIGHT)


@case("sort_05_largest_threads", f"""WITH {TABLE} SELECT thread_id, max(brand_comment_count) AS size FROM tbl GROUP BY 1, video_id
  ORDER BY size DESC, video_id, thread_id LIMIT 6""")
def largest_threads(t: Tables):
    return R.top_threads(insight_table(t)).selectExpr("thread_id", "brand_comment_count AS size")
