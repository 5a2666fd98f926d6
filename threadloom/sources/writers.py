"""Writing raw records and published tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.dedup import latest_by
from threadloom.sources import key_index
from threadloom.sources.staging import stage
from threadloom.sources.tables import in_partitions, outside_partitions, read_if_present

DAY_LEVELS = ("year", "month", "day")
FILE_RECORDS = 200_000
# Up to so many hashes of keys (some 50 bytes each) go to every task.
BROADCAST_KEYS = 500_000


def day_columns(at: Column) -> dict[str, Column]:
    """Zero-padded year, month and day of a moment, as partition values."""
    return {"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd")}


def partition_path(df: DataFrame, columns: Sequence[str]) -> Column:
    """"a=1/b=2/" for the given partition columns; "/" for none."""
    if not columns:
        return F.lit("/")
    return F.concat(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string"), F.lit("/")) for c in columns])


def land_bronze(df: DataFrame, path: str, at: Column | str, max_records: int = FILE_RECORDS) -> None:
    """Appends raw records as gzip JSON under the day of ``at``, in files of bounded size."""
    at = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    (
        df.withColumns(day_columns(at)).write.mode("append")
        .option("compression", "gzip").option("maxRecordsPerFile", max_records)
        .partitionBy(*DAY_LEVELS).json(path)
    )


def land_in_files(
    df: DataFrame, path: str, at: Column | str, max_bytes: int, order: Sequence[str] = (), levels: Sequence[str] = DAY_LEVELS
) -> None:
    """As ``land_bronze``, in files of at most ``max_bytes`` of JSON text before compression (a record above that has a file of its
    own), each with records in order: that of ``order``, or else as they come.

    Sizes are summed in two steps, within tasks and then over them, so each record knows how many bytes of its day lie before it; that tells
    its file, and each file is written by one task, which may write others, of other days. A file takes what starts in its span of bytes; the span is as
    much shorter than the bound as the longest record that shares files is long, so the last one fits in too."""
    at = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    spark, day = df.sparkSession, list(levels)
    rows = df.withColumns(day_columns(at))
    rows = rows.orderBy(*order) if order else rows
    record = F.to_json(F.struct(*[c for c in df.columns]))
    rows = stage(spark, rows.select(
        "*", (F.octet_length(record) + 1).cast("bigint").alias("_size"), F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at")))
    large = F.col("_size") > max_bytes // 2
    # Large records are numbered by themselves, one a file.
    rows = rows.withColumn("_large", large)
    longest = rows.where("NOT _large").agg(F.max("_size")).head()[0] or 0
    span = max(1, max_bytes - longest)
    weight = F.when(F.col("_large"), F.lit(span)).otherwise(F.col("_size"))
    rows = rows.withColumn("_weight", weight)
    group = [*day, "_large"]
    tasks = rows.groupBy(*group, "_task").agg(F.sum("_weight").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = tasks.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_sum")
    within = F.sum("_weight").over(Window.partitionBy(*group, "_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_within", F.coalesce(within, F.lit(0))).join(tasks, [*group, "_task"])
    rows = rows.withColumn("_nth", F.floor((F.col("_before") + F.col("_within")) / span))
    rows = stage(spark, rows)
    files = rows.select(*group, "_nth").distinct()
    number = F.row_number().over(Window.partitionBy(*day).orderBy("_large", "_nth")) - 1  # a row for each file
    files = stage(spark, files.withColumn("_file", number))
    count = files.agg(F.max("_file") + 1).head()[0]
    if count:
        # A task writes one file of each day: tasks are as many as the files of the largest day, not as all files.
        placed = rows.join(files, [*group, "_nth"]).repartitionById(count, F.col("_file").cast("int")).sortWithinPartitions(*day, "_at")
        placed.select(*df.columns, *day).write.mode("append").option("compression", "gzip").partitionBy(*day).json(path)


def land_video(df: DataFrame, path: str, max_records: int = FILE_RECORDS) -> None:
    """Video comments, one folder per video."""
    (
        df.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", max_records)
        .partitionBy("video_id").json(path)
    )


def write_table(
    df: DataFrame, path: str, partition_cols: Sequence[str] | None = None, mode: str = "overwrite",
    max_records: int = 5_000_000,
) -> None:
    """Snappy Parquet, partitioned by day columns unless told otherwise.

    Rows are rebalanced by partition value, which gives each small partition one
    file and splits a partition that holds much of the data over several tasks.
    In overwrite mode only the partitions present in ``df`` are replaced."""
    columns = list(DAY_LEVELS if partition_cols is None else partition_cols)
    df = df.hint("rebalance", *columns) if columns else df
    writer = df.write.mode(mode).option("compression", "snappy").option("maxRecordsPerFile", max_records)
    if columns:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*columns)
    writer.parquet(path)


def write_small_table(df: DataFrame, path: str) -> None:
    """One file, for dimensions of a size set by hand (brands and the like)."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def replace_table(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> None:
    """Full refresh: everything below ``path`` goes, then ``df`` is written."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)


def touched_partitions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def stage_verified(spark: SparkSession, df: DataFrame, verify: Callable[[DataFrame], None] | None) -> DataFrame:
    """Stages rows that must pass checks. Checks that can count while the rows are written do; others read what was staged."""
    if verify is None:
        return stage(spark, df)
    if not hasattr(verify, "observed"):
        staged = stage(spark, df)
        verify(staged)
        return staged
    watched, judge = verify.observed(df)
    staged = stage(spark, watched)
    judge(staged)
    return staged


def publish(
    spark: SparkSession, df: DataFrame, path: str, partition_cols: Sequence[str] = (),
    verify: Callable[[DataFrame], None] | None = None, replace: bool = True,
) -> DataFrame:
    """Computes a table once, verifies it, and only then replaces the published
    one, or its partitions present in ``df`` if ``replace`` is off."""
    staged = stage_verified(spark, df, verify)
    if replace:
        balanced = staged.hint("rebalance", *partition_cols) if partition_cols else staged
        replace_table(balanced, path, partition_cols)
    else:
        write_table(staged, path, partition_cols)
    return staged


def merge_partitions(
    spark: SparkSession, batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str],
    partition_cols: Sequence[str], verify: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Merges a batch into a table by key; repeating a batch changes nothing.
    Returns the staged batch.

    A key is unique in the whole table. Partitions that hold one of the batch's keys so far are read, the latest row per key stays,
    and just these partitions are replaced; other partitions get the batch's rows as files beside those that they have, and are rewritten only
    when small files have become many (``key_index.crowded``). Which partitions hold a key is told by the key index beside the table, and of the
    few it names the key columns alone are read; all others are not opened. A partition that has lost its last row is removed. Only rows whose
    key occurs more than once meet by key; all others pass as they are. What replaces partitions, and what was chosen among rows of a key, is
    staged first, so that a lost executor cannot make Spark re-read files that the overwrite has already replaced; it is removed once it is
    published. Rows are added before others are replaced: a merge that breaks off in between loses none, and when it is repeated its
    keys are found in all the places they have by then."""
    columns = list(partition_cols)
    batch = stage_verified(spark, batch, verify)
    target = read_if_present(spark, path, batch.schema)
    repeated = batch.groupBy(_key(keys)).count().where("count > 1").select("_key")
    if target is None:
        repeated = stage(spark, repeated)
        n = repeated.count()
        same, single = split_by_key(batch, repeated, n, keys)
        write_table(latest_by(same, keys, order).unionByName(single) if n else batch, path, columns)
        remove_staged(spark, repeated)
        return batch
    found = homes_of(spark, target, path, batch, keys, columns)
    touched = _rewritten(spark, target, found, batch, path, columns)
    kept, new = in_partitions(target, touched).select(*batch.columns), batch
    contested = stage(spark, found.select("_key").unionByName(repeated).distinct())
    used = [found, contested]
    if n := contested.count():
        (old_same, kept), (same, new) = (split_by_key(rows, contested, n, keys) for rows in (kept, batch))
        won = stage(spark, latest_by(same.unionByName(old_same), keys, order))
        new = new.unionByName(won)
        used.append(won)
    _put(spark, new, kept, touched, path, columns)
    for done in used:
        remove_staged(spark, done)
    return batch


def _key(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys).alias("_key")


def split_by_key(df: DataFrame, listed: DataFrame, n: int, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that may have one of ``n`` listed keys (their hashes), and rows that surely have none. Beyond ``BROADCAST_KEYS`` all rows may."""
    if n > BROADCAST_KEYS:
        return df, df.where(F.lit(False))
    hashed, listed = df.withColumn("_hash", F.xxhash64(*keys)), F.broadcast(listed)
    same, others = (hashed.join(listed, F.col("_hash") == F.col("_key"), how).drop("_hash") for how in ("left_semi", "left_anti"))
    return same, others


def replace_groups(
    spark: SparkSession, rows: DataFrame, groups: DataFrame, path: str, keys: Sequence[str], partition_cols: Sequence[str],
    verify: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Puts rows in the place of all that a table holds of some groups, wherever it holds them; repeating
    that changes nothing. Returns the staged rows.

    ``groups`` lists the keys of every group that is replaced, also of those that have no row any more: their old rows go. Only
    partitions that hold such a group are rewritten; the key index tells which do. Others get rows as in ``merge_partitions``."""
    columns = list(partition_cols)
    rows, groups = stage_verified(spark, rows, verify), stage(spark, groups.select(*keys).distinct())
    target = read_if_present(spark, path, rows.schema)
    if target is None:
        write_table(rows, path, columns)
        return rows
    # A row of a group that is not listed is added to it.
    found = homes_of(spark, target, path, groups, keys, columns)
    touched = _rewritten(spark, target, found, rows, path, columns)
    kept = in_partitions(target, touched).join(groups, list(keys), "left_anti")
    _put(spark, rows, kept.select(*rows.columns), touched, path, columns)
    for done in (found, groups):
        remove_staged(spark, done)
    return rows


def homes_of(
    spark: SparkSession, target: DataFrame, path: str, wanted: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Where the table holds the wanted keys: a hash of the key and the partition of each row that has one, staged."""
    listed = wanted.select(*keys).distinct()
    blocks = key_index.current(spark, target, path, keys, columns)
    maybe = stage(spark, key_index.partitions_with(blocks, listed, keys, columns))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_batch_{k}")) for k in keys])
    listed = listed.select(*[F.col(k).alias(f"_batch_{k}") for k in keys])
    homes = in_partitions(target.select(*dict.fromkeys([*keys, *columns])), maybe).join(listed, same, "left_semi")
    found = stage(spark, homes.select(_key(keys), *columns))
    remove_staged(spark, maybe)
    return found


def _rewritten(
    spark: SparkSession, target: DataFrame, found: DataFrame, rows: DataFrame, path: str, columns: Sequence[str]
) -> DataFrame:
    """Partitions to rewrite, staged: those where a key was found, and those of many small files that get a row."""
    crowded = key_index.crowded(spark, path, T.StructType([target.schema[c] for c in columns]))
    into = in_partitions(touched_partitions(rows, columns), crowded)
    return stage(spark, touched_partitions(found, columns).unionByName(into).distinct())


def _put(
    spark: SparkSession, new: DataFrame, kept: DataFrame, touched: DataFrame, path: str, columns: Sequence[str]
) -> None:
    """Adds rows to a table: in the touched partitions together with the kept rows, over all that is there; elsewhere as further
    files. Touched partitions without a row are removed, and so is their list."""
    if touched.isEmpty():
        write_table(new, path, columns, mode="append")
    else:
        merged = stage(spark, kept.unionByName(in_partitions(new, touched)))
        write_table(outside_partitions(new, touched), path, columns, mode="append")
        write_table(merged, path, columns)
        left = [F.col(c).eqNullSafe(F.col(f"_left_{c}")) for c in columns]
        filled = touched_partitions(merged, columns).select(*[F.col(c).alias(f"_left_{c}") for c in columns])
        for row in touched.join(filled, reduce(lambda a, b: a & b, left), "left_anti").toLocalIterator():
            remove_partition(spark, path, {c: row[c] for c in columns})
        remove_staged(spark, merged)
    remove_staged(spark, touched)


def remove_partition(spark: SparkSession, path: str, values: dict) -> None:
    """Deletes one partition's folder."""
    to_text = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    folder = "/".join(to_text(c, None if v is None else str(v)) for c, v in values.items())
    _delete(spark, f"{path.rstrip('/')}/{folder}")


def remove_staged(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    _delete(spark, df.staged_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def compact_duplicates(
    spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], partition_cols: Sequence[str],
    where: Column | None = None,
) -> None:
    """Rewrites partitions (all, or those selected) with one row per key."""
    rows = spark.read.parquet(path)
    rows = rows if where is None else rows.where(where)
    write_table(stage(spark, latest_by(rows, [*partition_cols, *keys], order)), path, partition_cols)


def write_threads(df: DataFrame, path: str) -> None:
    """Nested thread documents as gzip JSON."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_text_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

