"""The key index: merges open only partitions that hold a key, whoever wrote the table."""

import pytest
from pyspark.sql import functions as F

from threadloom.plans import group, video
from threadloom.sources import key_index, tables, writers

SCHEMA = "id string, n int, day string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id string, day string, n int")


def content(spark, path, schema=SCHEMA):
    return {(r["id"], r["day"], r["n"]) for r in spark.read.schema(schema).parquet(path).collect()}


def spoil(folder):
    """Makes a partition unreadable without changing the names and sizes of its files."""
    for file in folder.glob("*.parquet"):
        size = file.stat().st_size
        for side in (file, file.with_name(f".{file.name}.crc")):
            side.unlink(missing_ok=True)
        file.write_bytes(b"x" * size)


def test_merge_opens_only_partitions_that_hold_a_key(spark, tmp_path):
    path, folder = str(tmp_path / "t"), tmp_path / "t"
    first = [(f"k{d}{i}", str(d), 1) for d in range(9) for i in range(50)] + [("nothing", None, 1)]
    writers.merge_partitions(spark, rows(spark, *first), path, ["id"], ["n"], ["day"])
    writers.merge_partitions(spark, rows(spark, ("k00", "0", 2)), path, ["id"], ["n"], ["day"])
    for day in (1, 3, 5, 8):
        spoil(folder / f"day={day}")
    # Keys move from day 2 to 4, from day 7 to a new day, and from no day to day 6.
    moved = [("k20", "4", 9), ("k71", "99", 9), ("nothing", "6", 9), ("new", "4", 9)]
    writers.merge_partitions(spark, rows(spark, *moved), path, ["id"], ["n"], ["day"])
    kept = spark.read.schema(SCHEMA).parquet(path).where("day IN ('0', '2', '4', '6', '7', '99') OR day IS NULL")
    want = {(i, d, n) for i, d, n in first if d in ("0", "2", "4", "6", "7") and i not in ("k00", "k20", "k71", "nothing")}
    assert {tuple(r) for r in kept.select("id", "day", "n").collect()} == want | {("k00", "0", 2), *moved}
    assert not (folder / "day=__HIVE_DEFAULT_PARTITION__").exists()


def test_index_follows_any_writer(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.merge_partitions(spark, rows(spark, ("a", "1", 1), ("b", "2", 1)), path, ["id"], ["n"], ["day"])
    writers.merge_partitions(spark, rows(spark, ("a", "1", 2)), path, ["id"], ["n"], ["day"])
    rows(spark, ("c", "3", 1)).write.mode("append").partitionBy("day").parquet(path)
    rows(spark, ("d", "2", 1)).write.mode("append").partitionBy("day").parquet(path)
    writers.merge_partitions(spark, rows(spark, ("c", "1", 5), ("d", "1", 5)), path, ["id"], ["n"], ["day"])
    assert content(spark, path) == {("a", "1", 2), ("b", "2", 1), ("c", "1", 5), ("d", "1", 5)}
    writers.replace_table(rows(spark, ("e", "7", 1)), path, ["day"])
    writers.merge_partitions(spark, rows(spark, ("e", "8", 2)), path, ["id"], ["n"], ["day"])
    assert content(spark, path) == {("e", "8", 2)}


@pytest.mark.parametrize("broadcast", [8192, 0])
def test_every_key_is_found_and_few_others(spark, monkeypatch, broadcast):
    monkeypatch.setattr(key_index, "BLOCK_KEYS", 100)
    monkeypatch.setattr(key_index, "BROADCAST_BLOCKS", broadcast)
    table = spark.range(6000).select(
        F.concat(F.lit("id"), F.hash("id").cast("string")).alias("id"), F.lit(1).alias("n"),
        F.when(F.col("id") < 3000, "big").when(F.col("id") < 5990, F.concat(F.lit("d"), F.col("id") % 20)).alias("day"))
    blocks = key_index.build(table, ["id"], ["day"])
    assert blocks.where("day = 'big'").count() == 32 and blocks.where("day IS NULL").count() == 1
    for n in (1, 5, 40):
        wanted = table.where(F.col("n") == 1).orderBy("id").limit(n)
        homes = {r["day"] for r in wanted.select("day").collect()}
        assert homes <= {r["day"] for r in key_index.partitions_with(blocks, wanted, ["id"], ["day"]).collect()}
    strangers = spark.range(300).select(F.concat(F.lit("id"), F.lit("-"), F.col("id")).alias("id"))
    assert key_index.partitions_with(blocks, strangers, ["id"], ["day"]).count() <= 4
    assert key_index.partitions_with(blocks.limit(0), strangers, ["id"], ["day"]).count() == 0


def test_pruning_is_dynamic_and_exact(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(rows(spark, *[(f"r{d}", None if d == 3 else str(d), d) for d in range(20)]), path, ["day"])
    target = tables.read_table(spark, path, SCHEMA)
    for wanted in (["1", "18"], ["0", None]):
        picked = tables.in_partitions(target, rows(spark, *[("x", d, 0) for d in wanted]).select("day"))
        assert "dynamicpruning" in picked._jdf.queryExecution().executedPlan().toString()
        assert {r["day"] for r in picked.collect()} == set(wanted)
    for day in range(20):
        if day not in (1, 18):
            spoil(tmp_path / "t" / (f"day={day}" if day != 3 else "day=__HIVE_DEFAULT_PARTITION__"))
    picked = tables.in_partitions(target, rows(spark, ("x", "1", 0), ("x", "18", 0)).select("day"))
    assert {r["id"] for r in picked.collect()} == {"r1", "r18"}


def test_texts_of_partitions_are_unambiguous(spark):
    values = [("a", "b"), ("a", None), (None, "a"), ("-", "b"), ("1:a", "b"), ("", ""), (None, None)]
    df = spark.createDataFrame(values, "x string, y string")
    assert df.select(tables.partition_text(["x", "y"])).distinct().count() == len(values)


def test_groups_are_replaced_wherever_they_are(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [("a", "1", 1), ("a", "1", 2), ("a", "2", 3), ("b", "1", 4), ("c", "3", 5), ("d", "4", 6)]
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    writers.replace_groups(spark, rows(spark, *first), listed, path, ["id"], ["day"])
    assert content(spark, path) == set(first)
    for _ in range(2):
        # a has fewer rows on another day, c has none any more.
        writers.replace_groups(spark, rows(spark, ("a", "5", 7)), listed.where("id IN ('a', 'c')"), path, ["id"], ["day"])
        assert content(spark, path) == {("b", "1", 4), ("d", "4", 6), ("a", "5", 7)}
    assert not (tmp_path / "t" / "day=3").exists()


def answering(*names):
    return lambda prompt: '[' + ",".join(f'{{"entity": "{n}", "aspect": "price", "evidence": "x"}}' for n in names) + ']'


def threads_at(spark, path, *ids):
    comment = "array(named_struct('comment_id', 'c', 'text', 't', 'brand_mentioned', 'iPhone', 'sentiment', 's', 'author_name', 'a', 'is_root', true))"
    df = spark.createDataFrame([(v, i) for v, i in ids], "video_id string, thread_id string").selectExpr(
        "thread_id", "video_id", "0 AS part", "1 AS parts", "1L AS brand_comment_count", f"{comment} AS comments")
    writers.write_threads(df, path)


def test_thread_insights_are_replaced_as_a_set(spark, tmp_path):
    documents, target = str(tmp_path / "docs"), str(tmp_path / "insights")
    threads_at(spark, documents, ("v1", "t1"), ("v2", "t2"))
    video.build_insights(spark, documents, target, answering("iphone", "android"), "2026-04-30 00:00:00")
    threads_at(spark, documents, ("v1", "t1"))
    video.build_insights(spark, documents, target, answering("iphone"), "2026-05-02 00:00:00")
    found = spark.read.parquet(target).select("video_id", "thread_id", "entity", "month").collect()
    assert {tuple(r) for r in found} == {("v1", "t1", "iphone", 5), ("v2", "t2", "iphone", 4), ("v2", "t2", "android", 4)}

    def fails(prompt):
        raise TimeoutError

    video.build_insights(spark, documents, target, fails, "2026-05-03 00:00:00")
    assert spark.read.parquet(target).count() == 3
    video.build_insights(spark, documents, target, lambda p: "nothing", "2026-05-03 00:00:00")
    assert {r["thread_id"] for r in spark.read.parquet(target).collect()} == {"t2"}


@pytest.fixture
def group_silver(spark, tmp_path):
    silver = str(tmp_path / "silver")

    def put(day):
        posts = spark.createDataFrame([(p, "page", 6, day) for p in ("p1", "p2")], "post_id string, page_name string, comment_count int, ingestion_date string")
        posts = posts.selectExpr("post_id", "'group' AS source_type", "page_name", "'t' AS text", "'f' AS feedback_id", "comment_count", "'u' AS permalink",
                                 "CAST(ingestion_date AS date) AS ingestion_date")
        comments = posts.selectExpr("post_id", "page_name", "ingestion_date", "explode(sequence(1, 6)) AS i").selectExpr(
            "concat(post_id, '-', i) AS comment_id", "post_id", "page_name", "'a' AS author_id", "'Ann' AS author_name", "'' AS author_url",
            "concat('text ', i) AS text", "1 AS reaction_count", "CAST(NULL AS string) AS parent_comment_id", "false AS is_reply", "ingestion_date")
        writers.replace_table(posts, f"{silver}/posts", ["ingestion_date"])
        writers.replace_table(comments, f"{silver}/comments", ["ingestion_date"])

    put("2026-05-05")
    return silver, put


def test_forced_insights_leave_no_old_ones(spark, tmp_path, group_silver):
    silver, put = group_silver
    gold = str(tmp_path / "gold")

    def answer(*aspects):
        return lambda prompt: '[' + ",".join(f'{{"model_entity": "VF8", "aspect": "{a}", "mention_count": 2, "evidence": "x"}}' for a in aspects) + ']'

    def found():
        return {(r["post_id"], r["aspect"], r["mention_count"], str(r["ingestion_date"])) for r in spark.read.parquet(f"{gold}/post_insights").collect()}

    aspects = [a for a in group.GROUP_VOCABULARY.aspects[:2]]
    group.build_insights(spark, silver, gold, None, answer(*aspects), "2026-05-06 00:00:00")
    assert found() == {(p, a, 2, "2026-05-05") for p in ("p1", "p2") for a in aspects}
    group.build_insights(spark, silver, gold, None, answer(aspects[0]), "2026-05-07 00:00:00")
    assert len(found()) == 4
    put("2026-05-13")  # the posts move to another day
    group.build_insights(spark, silver, gold, None, answer(aspects[0]), "2026-05-14 00:00:00", force=True, part_size=2)
    got = found()
    assert {(p, a, d) for p, a, _, d in got} == {(p, aspects[0], "2026-05-13") for p in ("p1", "p2")}
    assert all(n % 2 == 0 and n >= 4 for _, _, n, _ in got)  # one row for all parts, two mentions from each
    weekly = spark.read.parquet(f"{gold}/agg_issue_weekly").select("week_start", "aspect", "total_mentions").collect()
    assert [(str(r["week_start"]), r["aspect"], r["total_mentions"]) for r in weekly] == [("2026-05-11", aspects[0], sum(n for _, _, n, _ in got))]


def test_prompts_of_post_parts_state_the_whole_post(spark, group_silver):
    from threadloom.operators import threads

    silver, _ = group_silver
    contexts = threads.build_post_contexts(group.read_posts(spark, silver), group.read_comments(spark, silver), part_size=2)
    asked = group.ask_posts(contexts, lambda p: "[]").select("prompt").collect()
    assert len(asked) > 2 and all("Thread (6 comments):" in r["prompt"] for r in asked)


def test_parts_carry_their_root(spark):
    from tests.test_comments import thread_input
    from threadloom.operators import threads

    docs = threads.build_threads(*thread_input(spark, 60), part_size=10)
    lines = docs.select("part", "root", threads.format_thread(F.col("comments"), root=F.col("root")).alias("t")).collect()
    assert len(lines) > 5
    for r in lines:
        assert (r["root"] is None) == (r["part"] == 0)
        assert r["t"].startswith('[Root]' if r["part"] == 0 else '[Context] Ann: "root"\n[Reply]')
        assert r["t"].count("root") == 1


def files(folder):
    return {file.name for file in folder.glob("*.parquet")}


def test_partitions_without_a_known_key_are_added_to(spark, tmp_path):
    path, folder = str(tmp_path / "t"), tmp_path / "t"
    first = [("a", "1", 1), ("b", "2", 1), ("c", "3", 1), ("none", None, 1)]
    writers.merge_partitions(spark, rows(spark, *first), path, ["id"], ["n"], ["day"])
    before = {day: files(folder / f"day={day}") for day in "123"}
    # d is new; b moves to day 1; c stays as it is, being later; e comes twice.
    batch = [("d", "1", 1), ("b", "1", 5), ("c", "1", 0), ("e", "4", 1), ("e", "1", 2)]
    for _ in range(2):
        writers.merge_partitions(spark, rows(spark, *batch), path, ["id"], ["n"], ["day"])
        want = {("a", "1", 1), ("b", "1", 5), ("c", "3", 1), ("d", "1", 1), ("e", "1", 2), ("none", None, 1)}
        found = [tuple(r) for r in spark.read.schema(SCHEMA).parquet(path).select("id", "day", "n").collect()]
        assert sorted(found, key=str) == sorted(want, key=str)
        assert not (folder / "day=2").exists() and not (folder / "day=4").exists()
        if before:
            assert before.pop("1") < files(folder / "day=1")
            before.clear()


@pytest.mark.parametrize("limit", [0, 1000])
def test_keys_meet_with_and_without_a_broadcast(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(writers, "BROADCAST_KEYS", limit)
    path = str(tmp_path / "t")
    writers.merge_partitions(spark, rows(spark, ("a", "1", 1), ("a", "2", 3), ("b", "1", 1), (None, "1", 1)), path, ["id"], ["n"], ["day"])
    assert content(spark, path) == {("a", "2", 3), ("b", "1", 1), (None, "1", 1)}
    writers.merge_partitions(spark, rows(spark, ("a", "1", 2), ("b", "2", 4), (None, "3", 2), ("c", "1", 1)), path, ["id"], ["n"], ["day"])
    assert content(spark, path) == {("a", "2", 3), ("b", "2", 4), (None, "3", 2), ("c", "1", 1)}
    assert spark.read.parquet(path).count() == 4


def test_many_small_files_are_written_as_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "MANY_FILES", 2)
    path, folder = str(tmp_path / "t"), tmp_path / "t" / "day=1"
    sizes = []
    for i in range(3):
        writers.merge_partitions(spark, rows(spark, (f"k{i}", "1", i)), path, ["id"], ["n"], ["day"])
        sizes.append(len(files(folder)))
    assert sizes == [1, 2, 1]
    assert content(spark, path) == {(f"k{i}", "1", i) for i in range(3)}
