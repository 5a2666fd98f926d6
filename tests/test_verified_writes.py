"""Checks that count while a table is written, in batch and stream."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.rows import raw_posts
from threadloom.operators import quality
from threadloom.sources import writers
from threadloom.streaming import streams

def checks():
    n = F.col("n")
    return [quality.Check("n_negative", n < 0), quality.Check("n_small", n < 5, warn=True), quality.Check("n_some", n == 7, max_share=0.5)]


def table(spark, *numbers):
    return spark.createDataFrame([(i, n, "d") for i, n in enumerate(numbers)], "id int, n int, day string").repartition(3)


def test_rows_are_computed_once_and_checked(spark, tmp_path):
    path, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(n):
        seen.add(1)
        return n

    df = table(spark, 1, 7, 9, 10).withColumn("n", counted.asNondeterministic()("n"))
    writers.publish(spark, df, path, ["day"], quality.enforcing(checks(), unique="id"))
    assert seen.value == 4 and spark.read.parquet(path).count() == 4


@pytest.mark.parametrize("numbers", [(1, -2, 9), (7, 7, 9)])
def test_failing_rows_stop_it(spark, tmp_path, numbers, caplog):
    path, verify = str(tmp_path / "t"), quality.enforcing(checks())
    writers.publish(spark, table(spark, 9), path, ["day"], verify)
    for write in (lambda: writers.publish(spark, table(spark, *numbers), path, ["day"], verify),
                  lambda: writers.merge_partitions(spark, table(spark, *numbers), path, ["id"], ["n"], ["day"], verify)):
        with pytest.raises(quality.QualityError, match="rows failed"):
            write()
        assert [r["n"] for r in spark.read.parquet(path).collect()] == [9]
    assert "'n': " in caplog.text


def test_repeated_keys_and_empty_tables(spark, tmp_path):
    path, verify = str(tmp_path / "t"), quality.enforcing(checks(), unique="id")
    with pytest.raises(quality.QualityError, match="duplicate_id"):
        writers.publish(spark, table(spark, 8, 9).withColumn("id", F.lit(1)), path, verify=verify)
    writers.publish(spark, table(spark, 8).limit(0), path, verify=verify)
    assert spark.read.schema("id int, n int, day string").parquet(path).count() == 0


def test_the_stream_checks_like_the_batch_job(spark, tmp_path):
    bronze, silver, checkpoint = (str(tmp_path / n) for n in ("bronze", "silver", "checkpoint"))
    writers.land_bronze(raw_posts(spark, {"id": "1"}), bronze, "2026-05-09")
    streams.silver_from_stream(spark, bronze, silver, checkpoint).awaitTermination()
    found = spark.read.parquet(silver)
    assert found.count() == 1
    writers.land_bronze(raw_posts(spark, {"id": "2", "createdAt": "Fri May 09 08:14:27 +0000 1999"}), bronze, "2026-05-10")
    query = streams.silver_from_stream(
        spark, bronze, silver, str(tmp_path / "other"), transform=lambda raw: streams.silver_posts(raw),
        verify=quality.enforcing([quality.Check("old", F.col("year") < "2000")]))
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    assert spark.read.parquet(silver).count() == 1


def test_the_stream_merges_once_a_run(spark, tmp_path, monkeypatch):
    """Many small batches are one merge, and copies of an id that land in different files are told apart as in the batch job."""
    bronze, silver, checkpoint = (str(tmp_path / n) for n in ("bronze", "silver", "checkpoint"))
    merges, merge = [], streams.merge_silver
    monkeypatch.setattr(streams, "merge_silver", lambda *args: (merges.append(1), merge(*args)))
    for day, rows in (("2026-05-09", ["1", "2"]), ("2026-05-10", ["3"]), ("2026-05-11", ["4"])):
        writers.land_bronze(raw_posts(spark, *[{"id": i, "ingestion_date": day} for i in rows]).coalesce(1), bronze, day)
    writers.land_bronze(raw_posts(spark, {"id": "1", "ingestion_date": "2026-05-12", "likeCount": -1}), bronze, "2026-05-12")
    for _ in range(2):
        streams.silver_from_stream(spark, bronze, silver, checkpoint, max_files=1).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(silver).collect()) == ["2", "3", "4"] and len(merges) == 1
    writers.land_bronze(raw_posts(spark, {"id": "5"}), bronze, "2026-05-13")
    streams.silver_from_stream(spark, bronze, silver, checkpoint, max_files=1).awaitTermination()
    assert spark.read.parquet(silver).count() == 4 and len(merges) == 2
