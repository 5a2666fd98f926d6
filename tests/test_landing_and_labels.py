"""Files bounded in bytes, the newest partition, catalog entries in place, trained labels, samples of lost rows, state per partition."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tests.rows import raw_posts
from tests.test_key_index import spoil
from threadloom.catalogue import BRANDS
from threadloom.operators import evaluation, labelling
from threadloom.operators import posts as P
from threadloom.operators.scoring import score_text
from threadloom.plans import short_posts
from threadloom.sources import catalog, tables, writers


def landed(folder):
    out = {}
    for file in sorted(folder.rglob("*.json.gz")):
        out.setdefault(str(file.parent.relative_to(folder)), []).append(gzip.open(file, "rt").read().splitlines(keepends=True))
    return out


@pytest.mark.parametrize("ordered", [False, True])
def test_files_are_bounded_in_bytes_and_in_order(spark, tmp_path, ordered):
    sizes = [5, 900, 40, 40, 2500, 300, 1, 1, 700, 499] * 30
    df = spark.createDataFrame([(i, "é" * n, 9 + i % 2) for i, n in enumerate(sizes)], "i int, text string, d int")
    df = df.repartition(4, "text") if ordered else df.coalesce(3)
    at = F.to_timestamp(F.concat(F.lit("2026-05-"), F.lpad("d", 2, "0")))
    writers.land_in_files(df, str(tmp_path), at, max_bytes=3000, order=["i"] if ordered else [])
    days = landed(tmp_path)
    assert sorted(days) == ["year=2026/month=05/day=09", "year=2026/month=05/day=10"]
    found = [json.loads(line) for files in days.values() for file in files for line in file]
    assert sorted(r["i"] for r in found) == list(range(len(sizes)))
    for files in days.values():
        for file in files:
            assert sum(len(line.encode()) for line in file) <= 3000 or len(file) == 1
            ids = [json.loads(line)["i"] for line in file]
            assert ids == sorted(ids)
        # Not many more files than the bytes need.
        assert len(files) <= 2 * sum(len(line.encode()) for file in files for line in file) / 3000 + sum(len(f) == 1 for f in files) + 1
    writers.land_in_files(df.limit(0), str(tmp_path / "none"), at, max_bytes=3000)


def test_a_task_writes_files_of_many_days(spark, tmp_path):
    df = spark.range(600).selectExpr("id AS i", "repeat('x', 80) AS text", "cast(1 + id % 6 AS string) AS d").coalesce(2)
    writers.land_in_files(df, str(tmp_path), F.to_timestamp(F.concat(F.lit("2026-05-0"), "d")), max_bytes=1000)
    files = list(tmp_path.rglob("*.json.gz"))
    tasks = {f.name.split("-")[1] for f in files}
    assert len(files) > 60 and len(tasks) <= max(len(list(d.glob("*.json.gz"))) for d in tmp_path.glob("*/*/*"))


def test_newest_partition_has_a_file(spark, tmp_path):
    writers.land_bronze(raw_posts(spark, {}), str(tmp_path), "2026-05-09")
    for empty in ("year=2027", "year=2026/month=11/day=03", "year=2026/month=05/day=x", "year=2026/month=05/day=31/_tmp", "_year=2099/month=01/day=01"):
        (tmp_path / empty).mkdir(parents=True)
    assert tables.latest_partition(spark, str(tmp_path)) == (2026, 5, 9)
    with pytest.raises(ValueError):
        tables.latest_partition(spark, str(tmp_path / "none"))


def test_catalog_entries_change_in_place(spark, tmp_path):
    path = str(tmp_path / "a'b")
    df = spark.createDataFrame([(1, "x", "o'clock"), (2, "y", None)], "n int, s string, day string")
    writers.write_table(df, path, ["day"])
    catalog.ensure_database(spark, "place_db", str(tmp_path / "db"))
    catalog.register_table(spark, "place_db.t", df.select("n", "day"), path, ["day"])
    spark.sql("ALTER TABLE place_db.t SET TBLPROPERTIES ('kept' = 'yes')")
    catalog.register_table(spark, "place_db.t", df.select("n", "s", "day"), path, ["day"])
    catalog.replace_partitions(spark, "place_db.t", [{"day": "o'clock"}, {"day": None}], chunk=1)
    assert {tuple(r) for r in spark.table("place_db.t").select("n", "s", "day").collect()} == {(1, "x", "o'clock"), (2, "y", None)}
    assert spark.sql("SHOW TBLPROPERTIES place_db.t").where("key = 'kept'").count() == 1
    catalog.register_table(spark, "place_db.t", df.select(F.col("n").cast("string").alias("n"), "day"), path, ["day"])
    assert spark.sql("SHOW TBLPROPERTIES place_db.t").where("key = 'kept'").count() == 0
    spark.sql("DROP DATABASE place_db CASCADE")


def test_a_trained_labeller_beats_a_lexicon(spark, tmp_path):
    good, bad = ["fine", "lovely", "does work"], ["awful", "broken", "does not work"]
    rows = [(i, f"text {i % 7} {(good if i % 3 else bad)[i // 3 % 3]} and more {i % 5}", "positive" if i % 3 else "negative") for i in range(300)]
    df = evaluation.with_split(spark.createDataFrame(rows, "id long, text string, label string"), "id")
    model = labelling.train(df.where("split = 'train'"), features=1 << 12)
    test = df.where("split = 'test'")
    f1 = [evaluation.macro_f1(scored, predicted="sentiment_label").head()["macro_f1"] for scored in (score_text(test, labeller=model), score_text(test))]
    assert f1[0] > 0.95 > f1[1]
    model.save(str(tmp_path / "model"))
    again = labelling.load(str(tmp_path / "model"))
    assert again.labels == ["negative", "positive"]
    odd = spark.createDataFrame([(None, 1), ("", 2), ("12 %", 3), ("lovely", 4)], "text string, sentiment_score int")
    found = again.label(odd).collect()
    assert [r["text"] for r in found] == [None, "", "12 %", "lovely"] and found[3]["sentiment_label"] == "positive"
    assert all(0.5 <= r["sentiment_score"] <= 1 for r in found)
    with pytest.raises(ValueError):
        labelling.train(df.where("label = 'positive'"))


def test_training_cuts_each_text_once(spark):
    cut = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            cut.add(batch.num_rows)
            yield batch

    rows = [(f"good day {i}", "a") if i % 2 else (f"bad night {i}", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "text string, label string")
    model = labelling.train(df.mapInArrow(counted, df.schema), features=1 << 8, rounds=3)
    assert cut.value == 40 and model.labels == ["a", "b"]


def test_author_state_reads_changed_days_only(spark, tmp_path):
    from threadloom.operators.posts import silver_posts

    silver, state = str(tmp_path / "silver"), str(tmp_path / "state")
    days = ["Fri May 08 08:00:00 +0000 2026", "Sat May 09 08:00:00 +0000 2026", "Sun May 10 08:00:00 +0000 2026"]
    author = lambda n: {**P_AUTHOR, "followers": n}
    raw = raw_posts(spark, *[{"id": str(i), "createdAt": d, "author": author(10 + i), "text": f"words {BRANDS[i].keywords[0]}"} for i, d in enumerate(days)])
    writers.write_table(silver_posts(raw), silver)
    schema = silver_posts(raw).schema

    def authors():
        parts = short_posts.author_state(spark, tables.read_table(spark, silver, schema), silver, state)
        return P.merge_author_parts(parts).select("author_followers", "top_brands").collect()

    first = authors()
    assert [(r["author_followers"], len(r["top_brands"])) for r in first] == [(12, 3)]
    for folder in (tmp_path / "silver").glob("year=*/month=*/day=08"):
        spoil(folder)
    assert authors() == first
    changed = raw_posts(spark, {"id": "2", "createdAt": days[2], "author": author(99), "text": "no brand"})
    writers.write_table(silver_posts(changed), silver)
    assert [(r["author_followers"], len(r["top_brands"])) for r in authors()] == [(99, 2)]


P_AUTHOR = {
    "userName": "alice", "id": "a1", "isBlueVerified": False, "followers": 1, "following": 500,
    "statusesCount": 200, "createdAt": "Mon Jan 01 00:00:00 +0000 2024",
}
