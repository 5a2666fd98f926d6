"""Reading raw records and published tables. Paths may be any URI the session can reach."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.contracts import RAW, THREAD_DOCUMENT, struct_of

DAY_LEVELS = ("year", "month", "day")
# Lists of partitions up to this number (some 50 bytes each) are broadcast.
BROADCAST_PARTITIONS = 200_000


def read_bronze(spark: SparkSession, path: str, dataset: str, entity: str | None = None) -> DataFrame:
    """Raw JSON (gzip by extension, one array or one record per line) in the
    fixed schema of its dataset. Video comments are landed per video, whose id is required."""
    if dataset == "video":
        if not entity:
            raise ValueError("video comments are read per video: pass its id")
        return read_videos(spark, path, entity).drop("video_id")
    return spark.read.schema(struct_of(RAW[dataset])).json(path)


def read_videos(spark: SparkSession, path: str, video_id: str | None = None) -> DataFrame:
    """Raw video comments with their video: of one video, or of all."""
    rows = spark.read.schema(struct_of(RAW["video"] + ", video_id string")).json(path)
    return rows if video_id is None else rows.where(F.col("video_id") == video_id)


def with_partitions(spark: SparkSession, path: str, dataset: str, levels: Sequence[str] = DAY_LEVELS) -> DataFrame:
    """All raw records with their partition columns as integers."""
    fields = RAW[dataset] + "".join(f", {c} int" for c in levels)
    return spark.read.schema(struct_of(fields)).json(path)


def partition_values(spark: SparkSession, path: str, levels: Sequence[str] = DAY_LEVELS) -> DataFrame:
    """Partitions below a path. Lists files without opening any: the ``content``
    column of the listing is never asked for."""
    return spark.read.format("binaryFile").load(path).select(*levels).distinct()


def latest_partition(spark: SparkSession, path: str, levels: Sequence[str] = DAY_LEVELS) -> tuple[int, ...]:
    """The newest partition that has a file, compared as numbers level by level.

    Folders are listed from the top down, the greatest value first, so that calls grow with the levels, not with the files."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())

    def newest(folder, rest: Sequence[str]) -> tuple[int, ...] | None:
        inside = [s for s in files.listStatus(folder) if not s.getPath().getName().startswith(("_", "."))]
        if not rest:
            return () if any(s.isFile() for s in inside) else None
        named = [(s.getPath().getName().partition("="), s.getPath()) for s in inside if s.isDirectory()]
        below = [(int(value), place) for (name, _, value), place in named if name == rest[0] and value.isdecimal()]
        for value, place in sorted(below, key=lambda b: -b[0]):
            found = newest(place, rest[1:])
            if found is not None:
                return (value, *found)
        return None

    best = newest(top, list(levels)) if files.exists(top) else None
    if best is None:
        raise ValueError(f"no partition {'/'.join(levels)} below {path}")
    return best


def only_partition(df: DataFrame, values: Sequence[int], levels: Sequence[str] = DAY_LEVELS) -> DataFrame:
    """Rows of one partition; the filter on partition columns prunes the scan."""
    for name, value in zip(levels, values):
        df = df.where(F.col(name) == value)
    return df


def partition_text(columns: Sequence[str]) -> Column:
    """All partition values as one text that no other values have: the length of each before it, and a dash for NULL."""
    return F.concat(*[F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
                      for text in (F.col(c).cast("string") for c in columns)])


def in_partitions(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of a table in the partitions listed by ``wanted`` (one column per partition level), a NULL
    value being a partition like others. Partitions that are not listed are not opened.

    Rows and list meet by one equality on the text of all partition values, which Spark turns into dynamic
    partition pruning of the scan, exact also for NULL and over several levels, as long as the list is broadcast. The
    span of each level's values is a literal filter beside it, which alone bounds what is opened where a list
    beyond ``BROADCAST_PARTITIONS`` is joined by a shuffle."""
    columns = wanted.columns
    cast = [F.col(c).cast(df.schema[c].dataType).alias(c) for c in columns]
    wanted = wanted.select(*cast).distinct().select("*", partition_text(columns).alias("_wanted"))
    summary = wanted.agg(F.count(F.lit(1)).alias("n"), *[
        f(c).alias(f"{c}_{n}") for c in columns
        for n, f in (("low", F.min), ("high", F.max), ("null", lambda c: F.count_if(F.col(c).isNull())))
    ]).head()
    # Pruning wants a filter on the list's side; every text of values has a sign at least.
    listed = wanted.select("_wanted").where(F.col("_wanted") > "")
    listed = F.broadcast(listed) if summary["n"] <= BROADCAST_PARTITIONS else listed
    for c in columns:
        kind = wanted.schema[c].dataType
        low, high = (F.lit(summary[f"{c}_{n}"]).cast(kind) for n in ("low", "high"))
        inside = F.col(c).between(low, high)
        df = df.where(inside | F.col(c).isNull() if summary[f"{c}_null"] else inside)
    return df.join(listed, partition_text(columns) == F.col("_wanted"), "left_semi")


def outside_partitions(df: DataFrame, others: DataFrame) -> DataFrame:
    """Rows in partitions that ``others`` does not list."""
    columns = others.columns
    cast = [F.col(c).cast(df.schema[c].dataType).alias(c) for c in columns]
    listed = others.select(*cast).distinct().select(partition_text(columns).alias("_wanted"))
    listed = F.broadcast(listed) if listed.count() <= BROADCAST_PARTITIONS else listed
    return df.join(listed, partition_text(columns) == F.col("_wanted"), "left_anti")


def read_latest_bronze(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    newest = latest_partition(spark, path)
    return only_partition(with_partitions(spark, path, dataset), newest).drop(*DAY_LEVELS)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A Parquet table. With a schema, partition values keep its types: page or
    video names that look like numbers stay text."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(struct_of(schema) if isinstance(schema, str) else schema)
    return reader.parquet(path)


def read_latest(
    spark: SparkSession, path: str, levels: Sequence[str] = DAY_LEVELS, schema: str | None = None
) -> DataFrame:
    return only_partition(read_table(spark, path, schema), latest_partition(spark, path, levels), levels)


def read_window(df: DataFrame, column: str, days: int, as_of: date | str | Column | None = None) -> DataFrame:
    """Rows of the last ``days`` days up to ``as_of`` (today), both ends included as far as data goes."""
    end = F.current_date() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    return df.where(F.col(column) >= F.date_sub(end, days))


def read_day(
    spark: SparkSession, path: str, day: date | str, column: str = "ingestion_date", schema: str | None = None
) -> DataFrame:
    """One day's partition. Filtering the table root keeps the partition column."""
    return read_table(spark, path, schema).where(F.col(column) == F.lit(day).cast("date"))


def read_entity(
    spark: SparkSession, path: str, entity: str | None, column: str = "video_id", schema: str | None = None
) -> DataFrame:
    """Rows of one entity, or of all if none is named."""
    rows = read_table(spark, path, schema)
    return rows if entity is None else rows.where(F.col(column) == entity)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of that schema if nothing has been written yet."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], struct_of(schema))


def read_if_present(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame | None:
    """For reports: all files under a prefix, or None."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(struct_of(THREAD_DOCUMENT)).json(path)


def read_json_text(spark: SparkSession, path: str, field: str = "content") -> DataFrame:
    """Texts of a JSON-lines file; blank and malformed lines and empty texts are skipped."""
    rows = spark.read.schema(f"{field} string").option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.col(field).alias("text")).where(F.col("text") != "")


def read_labelled_csv(spark: SparkSession, path: str, schema: str = "text string, sentiment_label string") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_raw_with_origin(spark: SparkSession, path: str, dataset: str, levels: Sequence[str] = ()) -> DataFrame:
    """Raw records with the file they come from and their order within it."""
    rows = with_partitions(spark, path, dataset, levels)
    return rows.withColumns({
        "source_file": F.col("_metadata.file_path"), "source_pos": F.monotonically_increasing_id(),
    })
