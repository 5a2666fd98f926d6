import json

import pytest
from pyspark.sql import functions as F

from tests.rows import insight_rows
from threadloom.catalogue import GROUP_VOCABULARY, VIDEO_VOCABULARY
from threadloom.operators import evaluation as E
from threadloom.operators import insights as I
from threadloom.operators import raw_pages as W
from threadloom.operators import reports as R
from threadloom.operators import runs as U

ITEM = {
    "model_entity": "VF8", "aspect": "pin", "sentiment": "negative", "intensity": "strong", "mention_count": 3,
    "evidence": "drains fast",
}


@pytest.mark.parametrize("change, expected", [
    ({}, ("negative", "strong", 3)),
    ({"model_entity": "VF99"}, None), ({"aspect": "unknown_aspect"}, None), ({"model_entity": None}, None),
    ({"sentiment": "dunno"}, ("neutral", "strong", 3)), ({"intensity": "extreme"}, ("negative", "mild", 3)),
    ({"sentiment": None, "intensity": None}, ("neutral", "mild", 3)),
    ({"mention_count": 0}, ("negative", "strong", 1)), ({"mention_count": None}, ("negative", "strong", 1)),
])
def test_validation(spark, change, expected):
    rows = I.validate_post_insights(insight_rows(spark, change)).collect()
    assert [(r["sentiment"], r["intensity"], r["mention_count"]) for r in rows] == ([expected] if expected else [])


def test_evidence_is_cut(spark):
    assert len(I.validate_post_insights(insight_rows(spark, {"evidence": "x" * 300})).head()["evidence"]) == 200


def parse(spark, raw, vocab=GROUP_VOCABULARY, **kw):
    df = spark.createDataFrame([("p1", raw)], "post_id string, raw string")
    return I.parse_answers(df, vocab, keep=["post_id"], **kw).orderBy("pos").collect()


@pytest.mark.parametrize("raw", [None, "", "no array here", "[{broken json}]", "[]", "[1, 2]"])
def test_unusable_answers_give_nothing(spark, raw):
    assert parse(spark, raw) == []


def test_answers_inside_prose(spark):
    mixed = [ITEM, {**ITEM, "model_entity": "VF99"}, {**ITEM, "aspect": "none"}]
    rows = parse(spark, "Here:\n```json\n" + json.dumps(mixed) + "\n```")
    assert [(r["model_entity"], r["mention_count"]) for r in rows] == [("VF8", 3)]


def test_missing_fields_get_defaults(spark):
    row = parse(spark, '[{"model_entity": " VF8 ", "aspect": "pin"}]')[0]
    assert (row["sentiment"], row["intensity"], row["mention_count"], row["evidence"]) == ("neutral", "mild", 1, "")


def test_bad_count_rejects_the_item_or_the_answer(spark):
    raw = json.dumps([ITEM, {**ITEM, "mention_count": "many"}])
    assert len(parse(spark, raw)) == 1
    assert parse(spark, raw, strict=True) == []


def test_video_vocabulary_folds_and_renames(spark):
    raw = json.dumps([{"entity": " iOS ", "aspect": "Battery"}, {"entity": "pixel", "aspect": "x"},
                      {"entity": "android", "aspect": " "}])
    rows = parse(spark, raw, VIDEO_VOCABULARY)
    assert [(r["entity"], r["aspect"]) for r in rows] == [("iphone", "battery")]


def merged(spark, *items):
    rows = [("t", e, "battery", s, i, n, v, p) for p, (e, s, i, n, v) in enumerate(items)]
    df = spark.createDataFrame(rows, "thread_id string, entity string, aspect string, sentiment string,"
                                     " intensity string, mention_count int, evidence string, pos int")
    return I.merge_thread_insights(df, ["thread_id"]).collect()


def test_merge_majority_and_best(spark):
    row, = merged(spark, ("iphone", "positive", "mild", 1, "a"), ("ios", "positive", "strong", 2, "b"),
                  ("iphone", "negative", "strong", 4, "c"))
    assert (row["entity"], row["sentiment"], row["intensity"], row["evidence"], row["mention_count"]) == (
        "iphone", "positive", "strong", "b", 7)


def test_merge_tie_is_mixed_and_unknown_intensity_is_least(spark):
    row, = merged(spark, ("android", "positive", "odd", 1, "a"), ("android", "negative", "mild", 1, "b"))
    assert (row["sentiment"], row["intensity"], row["evidence"]) == ("mixed", "mild", "b")


def test_failed_calls_give_no_raw(spark):
    def answer(prompt):
        if prompt == "bad":
            raise OSError
        return prompt.upper()

    df = spark.createDataFrame([("bad",), ("ok",)], "prompt string")
    assert {r["prompt"]: r["raw"] for r in I.ask(df, answer).collect()} == {"bad": None, "ok": "OK"}


THREADS_DDL = ("video_id string, thread_id string, entity string, aspect string, sentiment string,"
               " intensity string, mention_count int, evidence string, brand_comment_count int")


def insight_table(spark):
    rows = [("v1", f"t{t}", "iphone" if t % 2 else "android", f"asp_{a}", s, "mild", a + 1, "e", 10 * t)
            for t in range(8) for a, s in enumerate(["positive", "negative", "mixed", "neutral", "positive"])]
    return spark.createDataFrame(rows, THREADS_DDL)


def test_reports(spark):
    table = insight_table(spark)
    cards = R.entity_scorecard(table).collect()
    assert [c["entity"] for c in cards] == ["android", "iphone"]
    assert cards[0]["total_mentions"] == 60 and cards[0]["positive_pct"] == 40 and cards[0]["top_aspect"] == "asp 4"
    aspects = R.aspect_breakdown(table, "iphone", k=2).collect()
    assert [(a["aspect"], a["total"]) for a in aspects] == [("asp 4", 20), ("asp 3", 16)]
    threads = {t["thread_id"]: t for t in R.top_threads(table).collect()}
    assert set(threads) == {f"t{i}" for i in range(2, 8)}
    assert threads["t7"]["headline"]["aspect"] == "asp_4" and len(threads["t7"]["others"]) == 3
    assert R.insight_totals(R.for_video(table, "v2")).head()["total_mentions"] == 0
    assert R.for_video(table).count() == 40


def test_controversial_posts_with_and_without_permalink(spark):
    stance = spark.createDataFrame(
        [("p1", "agree", "1"), ("p1", "disagree", "2"), ("p1", "neutral", "3"), ("p2", "agree", "4"), ("p3", "agree", "5")],
        "post_id string, stance string, comment_id string")
    posts = spark.createDataFrame([(p, "t", "negative", "page", "link") for p in ("p1", "p2", "p9")],
                                  "post_id string, text_preview string, sentiment_label string, page_name string,"
                                  " permalink string")
    rows = R.controversial_posts(stance, posts).collect()
    assert [(r["total_comments"], r["agree_pct"]) for r in rows] == [(3, 33), (1, 100)]
    assert "permalink" not in R.controversial_posts(stance, posts.drop("permalink")).columns


def test_report_rows(spark):
    table = I.stamp_analysis(insight_table(spark), "2026-05-01 12:00:00")
    row = R.thread_insight_rows(table).head()
    assert row["analyzed_at"] == "2026-05-01T12:00:00Z" and "year" not in row.asDict()
    nan = spark.createDataFrame([(float("nan"), "x"), (1.0, "y")], "d double, s string")
    assert [r["d"] for r in R.nan_to_null(nan).collect()] == [None, 1.0]


def test_runs(spark):
    rows = spark.createDataFrame(
        [("1", "j", "success", "2026-05-01 00:00:00", None, "2026-05-01 00:02:05"),
         ("2", "j", "running", None, "2026-05-02 00:00:00", None)],
        "run_id string, job string, state string, start_date string, logical_date string, end_date string",
    )
    for c in ("start_date", "logical_date", "end_date"):
        rows = rows.withColumn(c, F.col(c).cast("timestamp"))
    got = {r["run_id"]: r for r in U.clean_runs(rows, "2026-05-02 00:00:30").collect()}
    assert got["1"]["duration_label"] == "2m 5s" and got["2"]["duration_seconds"] == 30.0
    assert [r["run_id"] for r in U.last_runs(U.clean_runs(rows), 1).collect()] == ["2"]
    expected = spark.createDataFrame([("1", "a"), ("1", "b")], "run_id string, task_id string")
    tasks = spark.createDataFrame([("1", "a", "success", 2)], "run_id string, task_id string, state string, try_number int")
    grid = {r["task_id"]: (r["state"], r["try_number"]) for r in U.task_grid(expected, tasks).collect()}
    assert grid == {"a": ("success", 2), "b": ("none", 0)}


def test_split_is_stable_and_about_right(spark):
    df = E.with_split(spark.range(5000), "id")
    assert 0.77 < df.where("split = 'train'").count() / 5000 < 0.83
    assert df.where("split = 'train'").exceptAll(E.with_split(spark.range(5000), "id").where("split = 'train'")).count() == 0


def test_evaluation(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, predicted string")
    assert E.accuracy(df).head()["accuracy"] == pytest.approx(2 / 3)
    assert {r["label"]: (r["a"], r["b"]) for r in E.confusion_matrix(df, ["a", "b"]).collect()} == {"a": (1, 1), "b": (0, 1)}
    codes = spark.createDataFrame([("LABEL_0",), ("LABEL_2",), ("x",)], "c string")
    assert [r[0] for r in codes.select(E.map_model_labels(F.col("c"))).collect()] == ["negative", "positive", None]


@pytest.mark.parametrize("page, text", [
    ('{"message":{"text":"A long \\"enough\\" text \\u00e9","ranges":[]}}', 'A long "enough" text é'),
    ('{"message":{"text":"short","ranges":[]},"message":{"text":"another long text"}}', "another long text"),
    ('"message":{"text":"x"},"message":{"text":"tail with slash \\\\"}', "tail with slash \\"),
    ('<meta property="og:description" content="Tom &amp; Ann &lt;3">', "Tom & Ann <3"),
    ('<meta property="og:description" content="abc">', ""), ("plain", ""), (None, ""),
])
def test_post_text(spark, page, text):
    df = spark.createDataFrame([(page,)], "html string")
    assert W.with_post_text(df).head()["post_text"] == text


def test_post_text_of_long_escaped_messages(spark):
    body = "\\u1ea3n " * 50_000
    df = spark.createDataFrame([('{"message":{"text":"' + body + '","ranges":[]}}',)], "html string")
    got = W.with_post_text(df).head()["post_text"]
    assert got == ("ản " * 50_000).strip()


@pytest.mark.parametrize("url, page, group, post", [
    ("https://x/groups/12/posts/34/", None, "12", "34"), ("https://x/groups/name/posts/34", None, None, "34"),
    ("https://x/?gid=5", None, "5", None), ("https://x/share/1", '"group_id":"77"', "77", None),
    ("https://x/share/1", '"storyID":"UzpfSTE6OTk="', None, "99"),
    ("https://x/share/1", '"storyID":"!!"<meta property="og:url" content="https://x/posts/slug/8">', None, "8"),
    ("https://x/share/1", '<meta property="og:url" content="https://x/?a=1&amp;story_fbid=6">', None, "6"),
])
def test_ids(spark, url, page, group, post):
    df = spark.createDataFrame([(url, page or "")], "u string, h string")
    row = df.select(W.group_id(F.col("u"), F.col("h")).alias("g"), W.post_id(F.col("u"), F.col("h")).alias("p")).head()
    assert (row["g"], row["p"]) == (group, post)


def test_feedback_id(spark):
    row = spark.createDataFrame([("123",)], "p string").select(W.feedback_id(F.col("p")).alias("f")).head()
    assert row["f"] == "ZmVlZGJhY2s6MTIz"


def test_search_pages(spark):
    pages = spark.createDataFrame([
        (1, '{"tweets": [{"id": "a", "text": "first"}, {"id": "b"}, {"id": null}]}'),
        (2, '{"tweets": [{"id": "a", "text": "again"}, {"id": "c"}, {"id": "d"}]}'), (3, '{"tweets": []}'),
    ], "page_no int, raw string")
    rows = W.normalize_search_pages(pages, "id string, text string", 3).orderBy("page_no", "id").collect()
    assert [(r["id"], r["text"]) for r in rows] == [("a", "first"), ("b", None), ("c", None)]


def test_one_comment_with_most_replies_does_not_fill_one_record(spark):
    person = "author_id string, author_name string, author_url string, text string, reaction_count string"
    feed = spark.createDataFrame([("p", "f", "m", 1, "g", "link")],
                                 "post_id string, feedback_id string, message string, comment_count int,"
                                 " group_name string, permalink string")
    comments = spark.createDataFrame([("f", 0, i, "u", "A", "", f"t{i}", "0", f"c{i}", "link") for i in range(3)],
                                     f"feedback_id string, page_no int, pos int, {person}, comment_feedback_id string,"
                                     " permalink string")
    replies = spark.createDataFrame([("c0", 0, i, "u", "A", "", f"r{i}", "0") for i in range(300)],
                                    f"comment_feedback_id string, page_no int, pos int, {person}")
    records = W.nest_post_comments(feed, comments, replies, part_size=20).collect()
    sizes = [sum(1 + len(c["replies"]) for c in r["comments"]) for r in records]
    texts = {x["text"] for r in records for c in r["comments"] for x in c["replies"]}
    assert len(texts) == 300 and max(sizes) < 120 and {r["comment_count"] for r in records} == {3}


def test_group_feed_names_apply_from_their_story_on(spark):
    def story(post, name=None, video=False):
        return {"__typename": "Story", "post_id": post, "feedback": {"id": "f" + post},
                "attachments": [{"media": {"__typename": "Video"}}] if video else [],
                "comet_sections": {"context_layout": {"story": {"comet_sections": {"title": {"story": {
                    "to": {"__typename": "Group", "name": name} if name else {"__typename": "User"}}}}}}}}

    blocks = [json.dumps({"node": story("1")}), json.dumps({"node": {"__typename": "Group", "group_feed": {"edges": [
        {"node": story("2", "G", video=True)}, {"node": story("3")}]}}}), "not json"]
    df = spark.createDataFrame([("g", i, b) for i, b in enumerate(blocks)], "group_id string, block_no int, raw string")
    rows = W.extract_group_feed(df).orderBy("post_id").collect()
    assert [(r["post_id"], r["group_name"], r["message"], r["comment_count"]) for r in rows] == [
        ("1", None, "", 0), ("3", "G", "", 0)]


def test_author_influence(spark):
    facts = spark.createDataFrame(
        [("a", "ann", 1.0, ["X", "Y"]), ("a", "ann", 3.0, ["Y"]), ("a", "ann", None, ["X", "Y"]), ("a", "old", 9.0, []),
         ("b", "bob", 5.0, None), ("c", "cy", 0.5, ["Z", "X"]), ("d", "dan", None, ["X"])],
        "author_id string, author_username string, engagement_score double, all_brands array<string>")
    rows = {r["author_username"]: r for r in R.author_influence(spark, facts).collect()}
    assert set(rows) == {"ann", "old", "cy"}
    assert (rows["ann"]["top_brand"], rows["ann"]["total_tweets"]) == ("Y", 2)
    assert rows["ann"]["log_engagement"] == pytest.approx(0.47712, abs=1e-5)
    assert (rows["old"]["top_brand"], rows["cy"]["top_brand"]) == ("Y", "X")
