import math

import pytest
from pyspark.sql import functions as F

from tests.rows import COMMENT, flat_comments, insight_rows, raw_groups, video_comments
from threadloom.catalogue import Lexicon
from threadloom.operators import comments as C
from threadloom.operators import quality as Q
from threadloom.operators import threads as TH
from threadloom.operators.scoring import (
    label_with_answerer, lexicon_pair_model, lexicon_text_model, score_present_text, score_text,
)


def test_resale_posts_go_and_textless_posts_stay(spark):
    rows = C.flatten_group_posts(raw_groups(
        spark, {"post_id": "1", "text": "Cần bán xe"}, {"post_id": "2", "text": None}, {"post_id": "3"},
        {"post_id": "3", "comment_count": 9}, {"post_id": "4", "ingestion_date": "bad"},
    )).collect()
    got = {r["post_id"]: r for r in rows}
    assert set(got) == {"2", "3", "4"} and got["3"]["comment_count"] == 9 and got["4"]["ingestion_date"] is None


def test_comment_tree_links_replies(spark):
    reply = {k: v for k, v in COMMENT.items() if k not in ("replies", "parent_comment_id")}
    raw = raw_groups(spark, {"comments": [{**COMMENT, "replies": [{**reply, "text": "second", "reaction_count": "1.2K"}]}]})
    rows = {r["text"]: r for r in C.flatten_comment_tree(raw).collect()}
    assert rows["second"]["parent_comment_id"] == rows["first"]["comment_id"]
    assert rows["second"]["is_reply"] and rows["second"]["reaction_count"] == 0
    assert rows["first"]["reaction_count"] == 3 and len(rows["first"]["comment_id"]) == 16


@pytest.mark.parametrize("comments", [[], None])
def test_post_without_comments_gives_one_blank_row(spark, comments):
    raw = raw_groups(spark, {"comments": comments})
    rows = C.flatten_comment_tree(raw).collect()
    assert [(r["author_id"], r["text"], r["is_reply"]) for r in rows] == [("", "", False)]
    assert C.flatten_comment_tree(raw, keep_empty=False).count() == 0


def test_comment_engagement(spark):
    rows = C.enrich_group_comments(flat_comments(spark, {}, {"is_reply": True}, {"reaction_count": None})).collect()
    scores = {r["comment_id"]: r["engagement_score"] for r in rows}
    assert scores["c0"] == pytest.approx(4 * math.log(2)) and scores["c1"] == pytest.approx(4 * math.log(3))
    assert scores["c2"] == 0.0


def test_burst_is_per_day(spark):
    rows = [{}] * 21 + [{"ingestion_date": "2026-05-02"}] + [{"author_id": None}] * 22
    for hot in (1_000_000, 5):
        flags = C.flag_bursts(flat_comments(spark, *rows), min_hot_rows=hot).collect()
        assert len(flags) == 44
        assert {r["is_bot"] for r in flags if r["author_id"] and str(r["ingestion_date"]) == "2026-05-01"} == {True}
        assert {r["is_bot"] for r in flags if str(r["ingestion_date"]) == "2026-05-02"} == {False}
        assert {r["is_bot"] for r in flags if r["author_id"] is None} == {True}


def test_blank_authors_can_be_ignored(spark):
    rows = flat_comments(spark, *([{"author_id": ""}] * 25))
    assert {r["is_bot"] for r in C.flag_bursts(rows).collect()} == {True}
    assert {r["is_bot"] for r in C.flag_bursts(rows, ignore_blank_author=True).collect()} == {False}


def test_page_daily(spark):
    df = flat_comments(spark, {}, {"post_id": "p2", "is_reply": True, "reaction_count": 1}, {"reaction_count": None})
    df = df.withColumn("sentiment_label", F.when(F.col("comment_id") == "c0", "positive").otherwise("neutral"))
    row = C.agg_page_daily(df).head()
    assert (row["total_posts"], row["total_comments"], row["total_replies"]) == (2, 3, 1)
    assert (row["avg_reaction_count"], row["positive_ratio"], row["negative_ratio"]) == (2.5, 0.3333, 0.0)


@pytest.mark.parametrize("before, now, sentiment, trend", [
    (5, 10, "negative", "rising"), (5, 10, "positive", "stable"), (10, 3, "negative", "falling"),
])
def test_weekly_trend(spark, before, now, sentiment, trend):
    rows = C.agg_issue_weekly(insight_rows(
        spark, {"mention_count": before, "ingestion_date": "2026-04-22"},
        {"mention_count": now, "sentiment": sentiment},
    )).orderBy("week_start").collect()
    assert [str(r["week_start"]) for r in rows] == ["2026-04-20", "2026-05-04"]
    assert [r["trend_direction"] for r in rows] == ["stable", trend]
    assert rows[1]["prev_week_mentions"] == before


def test_weekly_without_mentions_has_no_ratio(spark):
    row = C.agg_issue_weekly(insight_rows(spark, {"mention_count": 0})).head()
    assert row["positive_ratio"] is None and row["trend_direction"] == "stable"


def test_group_checks(spark):
    good = flat_comments(spark, {}, {})
    Q.enforce(good, Q.silver_group_comment_checks())
    with pytest.raises(Q.QualityError, match="null_post_id"):
        Q.enforce(flat_comments(spark, {"post_id": None}), Q.silver_group_comment_checks())
    with pytest.raises(Q.QualityError, match="null_sentiment"):
        Q.enforce(good.withColumn("sentiment_label", F.lit(None).cast("string")), Q.fact_comment_checks())
    with pytest.raises(Q.QualityError, match="duplicate_comment_id"):
        Q.enforce(flat_comments(spark, {"comment_id": "x"}, {"comment_id": "x"}), [], unique="comment_id")


def test_video_comments(spark):
    rows = C.silver_video_comments(video_comments(
        spark, {}, {"comment_id": "c2", "published_at": "not-a-date"}, {"comment_id": "c3", "likes": -1},
        {"comment_id": "c4", "text": None}, {"comment_id": "c5", "likes": None},
    )).collect()
    assert [r["comment_id"] for r in rows] == ["c1"]
    assert (rows[0]["comment_hour"], rows[0]["comment_day_of_week"], rows[0]["day"]) == (8, 7, 9)
    Q.enforce(C.silver_video_comments(video_comments(spark, {})), Q.video_comment_checks())


def test_row_per_brand(spark):
    df = video_comments(spark, {"text": "iPhone or Android"}, {"comment_id": "c2", "parent_id": "c1", "text": "ios"},
                        {"comment_id": "c3", "text": "none"})
    rows = {(r["comment_id"], r["brand_mentioned"], r["is_root"]) for r in C.per_brand_mention(df).collect()}
    assert rows == {("c1", "iPhone", True), ("c1", "Android", True), ("c2", "iPhone", False)}


def stance_input(spark):
    rows = [{"text": "parent"}] + [
        {"comment_id": f"r{i}", "parent_id": "c1", "text": t}
        for i, t in enumerate(["exactly right", "that is wrong", "hm", "yes and no"])
    ] + [{"comment_id": "lost", "parent_id": "gone"}]
    return video_comments(spark, *rows).withColumn("video_id", F.lit("v1"))


def test_video_stance_native_and_model_agree(spark):
    expected = {"r0": "agreement", "r1": "disagreement", "r2": "neutral", "r3": "agreement"}
    for load in (None, lexicon_pair_model()):
        for hot in (1_000_000, 2):
            rows = C.video_stance(stance_input(spark), load=load, min_hot_rows=hot).collect()
            assert {r["comment_id"]: r["stance_label"] for r in rows} == expected


def test_sentiment_native_and_model_agree(spark):
    texts = ["Good, great!", "bad news", "goodness", "good bad", "", None, "TỐT lắm"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    native = {r["n"]: (r["sentiment_label"], round(r["sentiment_score"], 4)) for r in score_text(df).collect()}
    model = {r["n"]: (r["sentiment_label"], round(r["sentiment_score"], 4))
             for r in score_text(df, load=lexicon_text_model()).collect()}
    assert native == model
    assert native[0] == ("positive", 1.0) and native[2] == ("neutral", 1.0) and native[3] == ("neutral", 0.5)


def test_blank_texts_never_reach_the_model(spark):
    def load():
        def predict(texts):
            return [("positive" if t else "seen", 1.0) for t in texts]
        return predict

    df = spark.createDataFrame([("x",), (" ",), (None,)], "text string")
    assert [r["sentiment_label"] for r in score_present_text(df, load=load).collect()] == ["positive", None, None]


def test_answerer_labels(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "n int, text string").coalesce(1)
    prompts = '[{"index": 0, "label": "positive"}, {"index": 9, "label": "negative"}, {"index": 1, "label": "odd"}]'
    rows = label_with_answerer(df, lambda p: f"ok {prompts}", batch=3).orderBy("n").collect()
    assert [r["sentiment_label"] for r in rows] == ["positive", "neutral", "neutral", "positive", "neutral"]
    empty = label_with_answerer(df.where("false"), lambda p: "[]")
    assert empty.count() == 0 and "sentiment_label" in empty.columns
    bad = label_with_answerer(df, lambda p: "[{broken]", flag_failures=True).collect()
    assert {(r["sentiment_label"], r["sentiment_score"], r["scored"]) for r in bad} == {("neutral", 1.0, False)}


def test_group_stance(spark):
    posts = spark.createDataFrame(
        [("p1", "text", "negative"), ("p2", "text", "neutral"), ("p3", " ", "positive"), ("p4", "text", None)],
        "post_id string, text string, sentiment_label string",
    )
    comments = flat_comments(
        spark, {"text": "exactly " + "w " * 60}, {"text": "wrong", "is_reply": True}, {"text": "bán 500tr"},
        {"post_id": "p2"}, {"post_id": "p3"}, {"post_id": "p4"}, {"page_name": "done"}, {"text": None},
    )
    done = spark.sql("SELECT date '2026-05-01' AS ingestion_date, 'done' AS page_name")
    rows = {r["comment_id"]: r for r in C.group_stance(comments, posts, done, min_hot_rows=2).collect()}
    assert {k: (r["stance"], r["comment_level"]) for k, r in rows.items()} == {
        "c0": ("agree", 1), "c1": ("disagree", 2), "c7": ("neutral", 1)}
    assert len(rows["c0"]["comment_text"].split()) == 50 and rows["c7"]["comment_text"] == ""
    late = flat_comments(spark, {"text": "w " * 60 + "exactly"})
    for tokens, stance in ((None, "agree"), (50, "neutral")):
        assert C.group_stance(late, posts, model_tokens=tokens).head()["stance"] == stance


def thread_input(spark, replies):
    ids = [f"r{i:03d}" for i in range(replies)]
    sentiment = spark.createDataFrame(
        [("v1", "c1", "root", "iPhone", "Neutral", "Ann", True)]
        + [("v1", i, "text", b, "Positive", "Bob", False) for i in ids for b in ("iPhone", "Android")],
        "video_id string, comment_id string, text string, brand_mentioned string, sentiment string,"
        " author_name string, is_root boolean",
    )
    stance = spark.createDataFrame([("v1", i, "c1", "neutral") for i in ids],
                                   "video_id string, comment_id string, parent_id string, stance_label string")
    return sentiment, stance


def test_threads_need_more_replies_than_the_limit(spark):
    assert TH.build_threads(*thread_input(spark, 50)).count() == 0
    document = TH.build_threads(*thread_input(spark, 51)).head()
    assert document["brand_comment_count"] == 103 and document["parts"] == 1
    assert document["comments"][0]["is_root"] and not document["comments"][1]["is_root"]


def test_large_threads_are_laid_out_in_parts(spark):
    docs = TH.build_threads(*thread_input(spark, 60), part_size=10, min_hot_rows=20).collect()
    ids = [(c["comment_id"], c["brand_mentioned"]) for d in docs for c in d["comments"]]
    assert len(docs) > 5 and len(ids) == len(set(ids)) == 121
    assert [d["part"] for d in docs if any(c["is_root"] for c in d["comments"])] == [0]


def test_prompts_of_parts_state_the_whole_thread(spark):
    docs = TH.build_threads(*thread_input(spark, 60), part_size=10)
    prompts = TH.with_prompt(docs, "n={n}", F.lit(""), total=F.col("brand_comment_count")).select("prompt").collect()
    assert len(prompts) > 5 and {r["prompt"] for r in prompts} == {"n=121"}


def test_analyzed_threads_are_skipped(spark):
    done = spark.createDataFrame([("v1", "c1")], "video_id string, thread_id string")
    assert TH.build_threads(*thread_input(spark, 51), analyzed=done).count() == 0


def test_prompt_lines(spark):
    sentiment, stance = thread_input(spark, 2)
    document = TH.build_threads(sentiment, stance, min_replies=1)
    lines = document.select(TH.format_thread(F.col("comments"), max_chars=2).alias("t")).head()["t"].split("\n")
    assert lines[0] == '[Root][iPhone] Ann: "ro"' and lines[1] == '[Reply][Android] Bob: "te"'
    prompt = TH.with_prompt(document, "n={n}\n{conversation_text}", TH.format_thread(F.col("comments"))).head()["prompt"]
    assert prompt.startswith('n=5\n[Root][iPhone] Ann: "root"')


def test_contexts_keep_posts_without_comments(spark):
    posts = spark.createDataFrame([("p1", "page", 5, "d"), ("p9", "page", 7, "d"), ("p3", "page", 4, "d")],
                                  "post_id string, page_name string, comment_count int, ingestion_date string")
    rows = {r["post_id"]: r for r in TH.build_post_contexts(
        posts, flat_comments(spark, {"is_reply": True}, {}, {"post_id": "p3"})).collect()}
    assert set(rows) == {"p1", "p9"}
    assert [c["is_reply"] for c in rows["p1"]["comments"]] == [False, True] and rows["p9"]["comments"] == []


def test_lexicon_of_substrings(spark):
    df = spark.createDataFrame([("Herende here",)], "text string")
    row = score_text(df, lexicon=Lexicon(("here",), ("xx",), whole_words=False)).head()
    assert row["sentiment_label"] == "positive"
