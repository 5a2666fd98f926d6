"""Which partitions of a table may hold a key, without reading the table.

Beside a table, in a folder that readers skip, lies one row for each block of a partition's keys: a Bloom filter of
``BLOCK_BITS`` bits, and the span of the keys' first bytes as numbers. A partition has as many blocks, a power of two, as keep them
below ``BLOCK_KEYS`` keys; a key's hash names its block. Looking keys up is an equality join on block, then a test of span and
bits, and names every partition that holds a key and few others.

Each row also has a fingerprint of the partition's files (their names and sizes). What does not match the files that are there now, because
something else wrote the table, is out of date and is built anew from the key columns of just those partitions: no writer has to know of
the index, and a lost or foreign index costs time, not rows. Files are listed for that, as for every read, but none is opened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.sources.tables import in_partitions, partition_text

FOLDER = "_keys"
BLOCK_BITS = 1 << 15
BLOCK_KEYS = 3000
PROBES = 6
WORDS = BLOCK_BITS // 64
# Up to so many blocks (4 KB each) go to every task; more are joined by a shuffle, those of small partitions, which
# every key asks, in so many copies.
BROADCAST_BLOCKS = 8192
COPIES = 16
FEW_SLOTS = 6
# A partition is crowded when it has so many files more than it has times so many bytes.
MANY_FILES = 16
FILE_BYTES = 32 << 20


def fingerprints(spark: SparkSession, path: str, partitions: T.StructType) -> DataFrame:
    """A table's partitions, a fingerprint of the files of each, their number and bytes."""
    listing = T.StructType.fromDDL("path string, modificationTime timestamp, length bigint, content binary")
    schema = T.StructType([*listing.fields, *partitions.fields])
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "*.parquet").load(path)
    name = F.regexp_extract("path", "[^/]*$", 0)
    return files.groupBy(*partitions.names).agg(
        F.bit_xor(F.xxhash64(name, "length")).alias("fingerprint"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def crowded(spark: SparkSession, path: str, partitions: T.StructType) -> DataFrame:
    """Partitions of many small files, which the next merge into them writes as few."""
    many = F.col("files") >= F.lit(MANY_FILES) + F.floor(F.col("bytes") / FILE_BYTES)
    return fingerprints(spark, path, partitions).where(many).select(*partitions.names)


def _key_columns(keys: Sequence[str]) -> list[Column]:
    """Three hashes of a key, and its first seven bytes as a number that keeps their order."""
    head = F.rpad(F.hex(F.substring(F.coalesce(F.col(keys[0]).cast("string"), F.lit("")).cast("binary"), 1, 7)), 14, "0")
    hashes = [F.xxhash64(*[F.col(k) for k in keys], F.lit(n)).alias(f"_h{n}") for n in range(3)]
    return [*hashes, F.conv(head, 16, 10).cast("bigint").alias("_at")]


def _bits() -> Column:
    """Places of a key's bits in its block: fifteen bits of a hash for each."""
    return F.array(*[
        F.shiftrightunsigned(F.col(f"_h{1 + n // 3}"), 15 * (n % 3)).bitwiseAND(BLOCK_BITS - 1).cast("int") for n in range(PROBES)
    ])


def _slot(level: Column) -> Column:
    return F.pmod(F.col("_h0"), F.call_function("shiftleft", F.lit(1).cast("bigint"), level))


def build(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Blocks of the rows' partitions: partition columns, level, slot, low, high, words."""
    keyed = rows.select(*columns, *_key_columns(keys))
    part = keyed.withColumn("_part", partition_text(columns))
    level = F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / BLOCK_KEYS)), F.lit(0)).cast("int").alias("level")
    levels = part.groupBy("_part").agg(level)
    bits = part.join(levels, "_part").select(*columns, "level", _slot(F.col("level")).alias("slot"), "_at", F.explode(_bits()).alias("_bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit") % 64)
    words = bits.groupBy(*columns, "level", "slot", (F.col("_bit") / 64).cast("int").alias("_word")).agg(
        F.bit_or(one).alias("_set"), F.min("_at").alias("low"), F.max("_at").alias("high"))
    # A block has at most WORDS of them.
    blocks = words.groupBy(*columns, "level", "slot").agg(
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.map_from_entries(F.collect_list(F.struct("_word", "_set"))).alias("_words"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.col("_words")[w], F.lit(0).cast("bigint")))
    return blocks.select(*columns, "level", "slot", "low", "high", filled.alias("words"))


def read(spark: SparkSession, path: str, partitions: T.StructType) -> DataFrame:
    fields = T.StructType.fromDDL("fingerprint bigint, keys string, level int, slot bigint, low bigint, high bigint, words array<bigint>")
    schema = T.StructType([*fields.fields, *partitions.fields])
    try:
        return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{FOLDER}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current(spark: SparkSession, target: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The blocks of every partition of a table, after those that are out of date have been built anew."""
    columns = list(columns)
    partitions = T.StructType([target.schema[c] for c in columns])
    named = ",".join(keys)
    there = fingerprints(spark, path, partitions).withColumn("_part", partition_text(columns))

    def fresh() -> DataFrame:
        """Blocks whose partition still has the files they were built from."""
        held = read(spark, path, partitions).where(F.col("keys") == named).withColumn("_part", partition_text(columns))
        return held.join(there.select("_part", "fingerprint"), ["_part", "fingerprint"], "left_semi")

    missing = there.join(fresh().select("_part").distinct(), "_part", "left_anti")
    if not missing.isEmpty():
        rows = in_partitions(target.select(*dict.fromkeys([*keys, *columns])), missing.select(*columns))
        blocks = build(rows, keys, columns).withColumn("_part", partition_text(columns)).join(missing.select("_part", "fingerprint"), "_part").drop("_part")
        blocks = blocks.withColumn("keys", F.lit(named))
        writer = blocks.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*columns).parquet(f"{path.rstrip('/')}/{FOLDER}")
    return fresh().drop("_part")


def partitions_with(blocks: DataFrame, wanted: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Partitions that may hold one of the wanted keys: all that do, and few others."""
    counts = blocks.groupBy("level").count().collect()  # one row for each power of two
    if not counts:
        return blocks.select(*columns).limit(0)
    few = sum(r["count"] for r in counts) <= BROADCAST_BLOCKS
    probes = wanted.select(*_key_columns(keys)).select(
        "*", _bits().alias("_bits"), F.explode(F.array(*[F.lit(r["level"]) for r in counts])).alias("level"))
    probes = probes.select("level", _slot(F.col("level")).alias("slot"), "_at", "_bits", F.col("_h1"))
    shared = F.col("level") <= FEW_SLOTS
    if few:
        found = probes.join(F.broadcast(blocks), ["level", "slot"])
    else:
        copies = F.when(shared, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
        found = probes.withColumn("_copy", F.when(shared, F.pmod("_h1", F.lit(COPIES)).cast("int")).otherwise(0)).join(
            blocks.withColumn("_copy", F.explode(copies)), ["level", "slot", "_copy"])
    found = found.where(F.col("_at").between(F.col("low"), F.col("high")))
    inside = F.forall("_bits", lambda b: F.call_function("getbit", F.get("words", (b / 64).cast("int")), b % 64) == 1)
    return found.where(inside).select(*columns).distinct()
