import gzip
import json

import pytest
from pyspark.sql import functions as F

from tests.rows import POST, flat_comments, raw_groups, raw_posts, video_comments
from threadloom import contracts
from threadloom.operators import posts as P
from threadloom.operators import quality
from threadloom.operators.dedup import duplicate_keys, duplicate_summary, first_seen, latest_by
from threadloom.operators.skew import hot_keys, skew_join
from threadloom.plans import group, landing, short_posts, video
from threadloom.session import fresh_dir, shared_dir
from threadloom.sources import catalog, tables, writers
from threadloom.streaming import streams


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")


def test_array_per_file_json(spark, tmp_path):
    day = tmp_path / "year=2026" / "month=05" / "day=09"
    day.mkdir(parents=True)
    with gzip.open(day / "posts.json.gz", "wt") as f:
        f.write(json.dumps([{**POST, "unknown_field": 1}, {**POST, "id": "2"}]))
    raw = tables.read_bronze(spark, str(tmp_path), "posts")
    assert {r["id"] for r in raw.select("id").collect()} == {"1", "2"}
    assert "unknown_field" not in raw.columns


def test_newest_partition_is_numeric(spark, tmp_path):
    for day in ("2026-09-30", "2026-10-02", "2025-12-31"):
        writers.land_bronze(raw_posts(spark, {"id": day}), str(tmp_path), day)
    assert tables.latest_partition(spark, str(tmp_path)) == (2026, 10, 2)
    assert [r["id"] for r in tables.read_latest_bronze(spark, str(tmp_path), "posts").collect()] == ["2026-10-02"]


def test_no_partition_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no partition"):
        tables.latest_partition(spark, str(tmp_path))


def test_video_needs_an_id(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_bronze(spark, str(tmp_path), "video")


def test_landing_pads_and_bounds_files(spark, tmp_path):
    many = raw_posts(spark, *[{"id": str(i)} for i in range(10)]).coalesce(1)
    writers.land_bronze(many, str(tmp_path), "2026-05-09", max_records=4)
    assert len(list((tmp_path / "year=2026" / "month=05" / "day=09").glob("*.json.gz"))) == 3


def test_missing_tables(spark, tmp_path):
    missing = str(tmp_path / "none")
    assert tables.read_or_empty(spark, missing, "a string").count() == 0
    assert tables.read_if_present(spark, missing) is None


def test_partition_names_that_look_like_numbers_stay_text(spark, tmp_path):
    df = flat_comments(spark, {"page_name": "007"})
    writers.write_table(df, str(tmp_path), ["ingestion_date", "page_name"])
    rows = tables.read_table(spark, str(tmp_path), contracts.SILVER_GROUP_COMMENT)
    assert rows.head()["page_name"] == "007"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, day string, n int")


def test_merge_is_idempotent_and_keeps_untouched_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([("a", "1", 1), ("b", "1", 1), ("c", "2", 1)], [("a", "1", 5)], [("a", "1", 5)]):
        writers.merge_partitions(spark, batch(spark, *rows), path, ["id"], ["n"], ["day"])
    got = {(r["id"], str(r["day"]), r["n"]) for r in spark.read.parquet(path).collect()}
    assert got == {("a", "1", 5), ("b", "1", 1), ("c", "2", 1)}


def test_merge_reads_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(batch(spark, ("a", "1", 1), ("b", "2", 1)), path, ["day"])
    target = tables.read_table(spark, path, "id string, n int, day string")
    picked = tables.in_partitions(target, batch(spark, ("x", "2", 0)).select("day").distinct())
    assert [r["id"] for r in picked.collect()] == ["b"]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ">= 2" in filters and "<= 2" in filters and "day" in filters


def scan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(flat_comments(spark, {}, {"ingestion_date": "2026-05-02"}), path, ["ingestion_date"])
    day = tables.read_day(spark, path, "2026-05-02", schema=contracts.SILVER_GROUP_COMMENT)
    assert day.count() == 1 and "PartitionFilters: [isnotnull(ingestion_date" in scan(day)
    window = tables.read_window(tables.read_table(spark, path), "ingestion_date", 3, "2026-05-05")
    assert window.count() == 1 and "PartitionFilters: [isnotnull(ingestion_date" in scan(window)
    entity = tables.read_entity(spark, path, "p1", column="post_id")
    assert "PushedFilters: [IsNotNull(post_id), EqualTo(post_id,p1)]" in scan(entity)


def test_any_number_of_partitions_with_a_null_one(spark):
    rows = batch(spark, *[(f"r{i}", None if i == 0 else str(i), i) for i in range(1500)])
    picked = tables.in_partitions(rows, rows.where("n <> 7").select("day"))
    assert picked.count() == 1499 and picked.where("day IS NULL").count() == 1


def test_merge_is_unique_by_key_over_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([("a", "1", 1), ("b", None, 1), ("c", "2", 1)], [("a", "2", 5), ("b", None, 2)]):
        writers.merge_partitions(spark, batch(spark, *rows), path, ["id"], ["n"], ["day"])
    got = {(r["id"], r["day"], r["n"]) for r in spark.read.schema("id string, n int, day string").parquet(path).collect()}
    assert got == {("a", "2", 5), ("b", None, 2), ("c", "2", 1)}
    assert not (tmp_path / "t" / "day=1").exists()


def test_large_partitions_are_split_on_write(spark):
    plan = spark.range(10).withColumn("day", F.lit(1)).hint("rebalance", "day")
    assert "REBALANCE" in plan._jdf.queryExecution().executedPlan().toString()


def test_full_refresh_and_dynamic_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(batch(spark, ("a", "1", 1), ("b", "2", 1)), path, ["day"])
    writers.write_table(batch(spark, ("c", "2", 2)), path, ["day"])
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {"a", "c"}
    writers.replace_table(batch(spark, ("d", "3", 3)), path, ["day"])
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {"d"}


def test_partition_path(spark):
    df = spark.createDataFrame([("2026", "05", "09")], "year string, month string, day string")
    row = df.select(writers.partition_path(df, ["year", "month", "day"]).alias("p"), writers.partition_path(df, []).alias("e")).head()
    assert (row["p"], row["e"]) == ("year=2026/month=05/day=09/", "/")


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "t")
    df = batch(spark, ("a", "1", 1), ("b", "2", 1))
    writers.write_table(df, path, ["day"])
    catalog.ensure_database(spark, "unit_db", str(tmp_path / "db"))
    catalog.register_table(spark, "unit_db.t", df, path, ["day"])
    assert spark.table("unit_db.t").where("day = '2'").head()["id"] == "b"
    writers.write_table(batch(spark, ("c", "3", 1)), path, ["day"])
    catalog.refresh_partitions(spark, "unit_db.t")
    assert spark.table("unit_db.t").count() == 3
    catalog.replace_partitions(spark, "unit_db.t", [{"day": "1"}, {"day": "3"}])
    assert spark.table("unit_db.t").count() == 3
    wider = df.withColumn("extra", F.lit(1.5))
    catalog.register_table(spark, "unit_db.t", wider, path, ["day"])
    assert "extra" in spark.table("unit_db.t").columns


def test_json_lines_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"content": "one"}\n\nbroken {\n{"content": ""}\n{"other": 1}\n{"content": "two"}\n')
    assert {r["text"] for r in tables.read_json_text(spark, str(tmp_path / "a.json")).collect()} == {"one", "two"}
    rows = spark.createDataFrame([('line\n"quoted", x', "positive")], "text string, sentiment_label string")
    writers.write_text_csv(rows, str(tmp_path / "csv"))
    assert tables.read_labelled_csv(spark, str(tmp_path / "csv")).head()["text"] == 'line\n"quoted", x'


def test_raw_dedup_keeps_first_and_all_without_id(spark):
    df = spark.createDataFrame(
        [("a", "f1", 0, 1), ("a", "f2", 0, 2), (None, "f1", 1, 3), (None, "f2", 1, 4), ("b", "f2", 2, 5)],
        "id string, source_file string, source_pos bigint, n int",
    )
    assert {r["n"] for r in first_seen(df, "id", ["source_file", "source_pos"]).collect()} == {1, 3, 4, 5}


def test_newest_landing_loses_its_repeats(spark, tmp_path):
    path = str(tmp_path)
    writers.land_bronze(raw_posts(spark, {"id": "1"}), path, "2026-05-08")
    for rows in ([{"id": "1"}, {"id": "2"}, {"id": None}], [{"id": "2"}, {"id": None}]):
        writers.land_bronze(raw_posts(spark, *rows), path, "2026-05-09")
    landing.deduplicate_newest(spark, path)
    days = {str(d["day"]): d["n"] for d in tables.with_partitions(spark, path, "posts").groupBy("day").agg(
        F.count("*").alias("n")).collect()}
    assert days == {"8": 1, "9": 4}
    assert sorted(p.name for p in (tmp_path / "year=2026").iterdir()) == ["month=05"]


def test_landing_search_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, json.dumps({"tweets": [POST, {**POST, "id": "2"}, POST]}))], "page_no int, raw string")
    landing.land_search_posts(pages, str(tmp_path), "2026-05-28", limit=10)
    rows = tables.read_latest_bronze(spark, str(tmp_path), "posts").collect()
    assert {(r["id"], r["ingestion_date"], r["author"]["id"]) for r in rows} == {
        (i, "2026-05-28T00:00:00Z", "a1") for i in "12"}


def test_latest_by_is_decided_by_value(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", None, "z")], "k string, t int, v string")
    for rows in (df, df.repartition(3), df.orderBy("v")):
        assert latest_by(rows, ["k"], ["t"]).head()["v"] == "y"


def test_duplicate_reports(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert [(r["k"], r["rows"]) for r in duplicate_keys(df, "k").collect()] == [("a", 2)]
    assert tuple(duplicate_summary(df, "k").head()) == (3, 2, 1, 1)
    assert tuple(duplicate_summary(df.where("false"), "k").head()) == (0, 0, 0, 0)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, how):
    left = spark.range(3000).withColumn(
        "k", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 50).cast("string"))
    )
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("2", 3), ("none", 4), (None, 5)], "k string, v int")
    plain = left.join(right, ["k"], how)
    salted = skew_join(left, right, ["k"], how, spread=["id"], min_rows=100)
    assert salted.select(*plain.columns).exceptAll(plain).count() == 0 and salted.count() == plain.count()
    assert [r["k"] for r in hot_keys(left, ["k"], 100).collect()] == ["hot"]


def test_every_hot_key_is_split(spark):
    left = spark.range(20_000).withColumn("k", F.col("id") % 2_000)
    hot = hot_keys(left, ["k"], 4)
    assert hot.count() == 2_000 and hot.select(F.min("_salts"), F.max("_salts")).head() == (3, 3)
    right = spark.range(0, 3_000, 2).withColumnRenamed("id", "k").withColumn("v", F.col("k") + 1)
    joined = skew_join(left, right, ["k"], "left", spread=["id"], min_rows=4)
    plain = left.join(right, ["k"], "left").select(*joined.columns)
    assert joined.count() == 20_000 and joined.exceptAll(plain).count() == 0


def test_hot_rows_are_spread_over_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(4000).withColumn("k", F.lit("hot"))
        right = spark.createDataFrame([("hot", 1)], "k string, v int")
        joined = skew_join(left, right, ["k"], "inner", spread=["id"], min_rows=100)
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_incremental_silver_equals_full(spark, tmp_path):
    bronze, full, steps = (str(tmp_path / n) for n in ("bronze", "full", "steps"))
    days = {"2026-05-09": [{"id": "1"}, {"id": "2"}], "2026-05-10": [{"id": "1", "likeCount": 99, "ingestion_date": "2026-05-10"}]}
    for day, rows in days.items():
        writers.land_bronze(raw_posts(spark, *rows), bronze, day)
        for _ in range(2):
            short_posts.build_silver(spark, bronze, steps, incremental=True)
    short_posts.build_silver(spark, bronze, full)
    rows = [sorted((r["id"], r["likeCount"]) for r in spark.read.parquet(p).collect()) for p in (full, steps)]
    assert rows[0] == rows[1] == [("1", 99), ("2", 3)]


def test_gold_runs_twice_without_double_counting(spark, tmp_path):
    bronze, silver, gold = (str(tmp_path / n) for n in ("bronze", "silver", "gold"))
    writers.land_bronze(raw_posts(
        spark, {"id": "1", "text": "great tesla"}, {"id": "2", "text": "bad tesla"}, {"id": "3"}), bronze, "2026-05-09")
    short_posts.build_silver(spark, bronze, silver)
    for _ in range(2):
        short_posts.build_gold(spark, silver, gold, as_of="2026-05-20")
    daily = spark.read.parquet(f"{gold}/agg_brand_daily").collect()
    assert [(r["brand_name"], r["total_mentions"], r["positive_count"]) for r in daily] == [("Tesla", 2, 1)]
    assert spark.read.parquet(f"{gold}/fact_posts").count() == 3
    assert spark.read.parquet(f"{gold}/dim_brands").count() == 10
    assert spark.read.parquet(f"{gold}/agg_author_perf").head()["total_tweets"] == 3
    assert spark.read.parquet(f"{gold}/dim_authors").head()["top_brands"] == ["Tesla"]


def test_analytics_are_checked_while_facts_are_staged(spark, tmp_path, monkeypatch):
    silver, gold, read = str(tmp_path / "silver"), str(tmp_path / "gold"), []
    report, table = quality.report, P.silver_posts(raw_posts(spark, {"id": "1", "text": "great tesla"}))
    writers.write_table(contracts.conform(table, contracts.SILVER_POST), silver)
    monkeypatch.setattr(quality, "analytics_checks", lambda: [quality.Check("no_tesla", F.col("primary_brand") == "Tesla")])
    monkeypatch.setattr(quality, "report", lambda df, checks, unique=None: read.append([c.name for c in checks]) or report(df, checks, unique))
    with pytest.raises(quality.QualityError, match="no_tesla"):
        short_posts.build_gold(spark, silver, gold, as_of="2026-05-20")
    assert ["no_tesla"] not in read and not (tmp_path / "gold" / "fact_posts").exists()


def answer(prompt):
    return json.dumps([{"model_entity": "VF8", "aspect": "pin", "sentiment": "negative", "intensity": "strong",
                        "mention_count": prompt.count("[R"), "evidence": "x"}])


def test_group_jobs(spark, tmp_path):
    bronze, silver, gold = (str(tmp_path / n) for n in ("bronze", "silver", "gold"))
    comment = {"author_id": "u", "author_name": "A", "author_url": "", "reaction_count": "1", "parent_comment_id": None,
               "replies": []}
    comments = [{**comment, "text": t} for t in ("exactly", "wrong", "true", "hm", "ok")]
    writers.land_bronze(raw_groups(
        spark, {"text": "bad battery", "comment_count": 5, "comments": comments},
        {"post_id": "p2", "comment_count": 1, "comments": comments[:1]}), bronze, "2026-05-09")
    group.build_silver(spark, bronze, silver)
    for _ in range(2):
        group.build_gold(spark, silver, gold, day="2026-05-09")
        group.build_insights(spark, silver, gold, "2026-05-09", answer, "2026-05-10 00:00:00")
        group.build_stance(spark, silver, gold, "2026-05-09")
    assert spark.read.parquet(f"{gold}/fact_comments").count() == 6
    assert [r["total_comments"] for r in spark.read.parquet(f"{gold}/agg_page_daily").collect()] == [6]
    insight = spark.read.parquet(f"{gold}/post_insights").collect()
    assert [(r["post_id"], r["mention_count"]) for r in insight] == [("p1", 5)]
    assert spark.read.parquet(f"{gold}/agg_issue_weekly").head()["total_mentions"] == 5
    stances = spark.read.parquet(f"{gold}/comment_stance").groupBy("stance").count().collect()
    assert {r["stance"]: r["count"] for r in stances} == {"agree": 2, "disagree": 1, "neutral": 2}
    group.build_insights(spark, silver, gold, "2026-05-09", answer, "2026-05-11 00:00:00", force=True)
    assert [str(r["analyzed_at"]) for r in spark.read.parquet(f"{gold}/post_insights").collect()] == ["2026-05-11 00:00:00"]


def test_videos_do_not_replace_each_other(spark, tmp_path):
    bronze, root = str(tmp_path / "bronze"), str(tmp_path)
    for video_id in ("007", "v2"):
        rows = video_comments(spark, {"text": "love my iphone"}, {"comment_id": "r1", "parent_id": "c1", "text": "no android"})
        writers.land_video(rows.withColumn("video_id", F.lit(video_id)), bronze)
    for video_id in ("007", "v2"):
        video.build_silver(spark, bronze, f"{root}/silver", video_id)
        video.build_sentiment(spark, f"{root}/silver", f"{root}/sentiment", video_id)
        video.build_stance(spark, f"{root}/silver", f"{root}/stance", video_id)
    sentiment = tables.read_table(spark, f"{root}/sentiment", contracts.COMMENT_SENTIMENT)
    assert {(r["video_id"], r["brand_mentioned"], r["sentiment"]) for r in sentiment.collect()} == {
        (v, b, s) for v in ("007", "v2") for b, s in (("iPhone", "Positive"), ("Android", "Neutral"))}
    assert spark.read.parquet(f"{root}/stance").count() == 2


def test_stream_equals_batch_and_picks_up_new_files(spark, tmp_path):
    bronze, silver, checkpoint = (str(tmp_path / n) for n in ("bronze", "silver", "checkpoint"))
    for day, ids in (("2026-05-09", "12"), ("2026-05-10", "23")):
        writers.land_bronze(raw_posts(spark, *[{"id": i} for i in ids]), bronze, day)
        streams.silver_from_stream(spark, bronze, silver, checkpoint, max_files=1).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(silver).collect()) == ["1", "2", "3"]
    batch_ids = P.silver_posts(tables.read_bronze(spark, bronze, "posts")).select("id").collect()
    assert sorted(r["id"] for r in batch_ids) == ["1", "2", "3"]


def test_stream_drops_repeats_and_late_days(spark, tmp_path):
    source, ddl = str(tmp_path / "in"), "id string, ts timestamp, brand_name string, lang string, sentiment_label string"
    def put(*rows):
        df = spark.createDataFrame([(i, t, "Tesla", "en", "Positive") for i, t in rows],
                                   ddl.replace("timestamp", "string"))
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    def run(kind):
        stream = spark.readStream.schema(ddl).parquet(source)
        out = streams.unique_by_id(stream, "id", "ts", "10 days") if kind == "ids" else streams.daily_brand_counts(
            stream, "ts", "1 hour")
        streams.to_table(out, str(tmp_path / kind), str(tmp_path / f"{kind}-cp")).awaitTermination()

    put(("a", "2026-05-01 10:00:00"), ("a", "2026-05-01 11:00:00"), ("b", "2026-05-03 10:00:00"))
    run("ids"), run("days")
    put(("a", "2026-05-01 12:00:00"), ("c", "2026-05-05 10:00:00"))
    run("ids"), run("days")
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "ids")).collect()) == ["a", "b", "c"]
    days = {str(r["date"]): r["total_mentions"] for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    assert days == {"2026-05-01": 2, "2026-05-03": 1}
