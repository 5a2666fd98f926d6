"""Importance resampling of documents towards a target distribution, by hashed n-grams.

Words come from a 256-byte table that lower-cases A-Z and blanks separators, and ``bytes.split``. A word's
CRC-32 is the seed that is chained over a blank and the next word, so each longer run costs one more call. The
CRC modulo the number of buckets is a feature. Counts are summed in each task and then by bucket over all tasks;
from the counts of all documents and all target texts each bucket gets a gain, the log ratio of both in thousandths.

A document's weight is the floored mean of its features' gains, and its score adds Gumbel noise that is a hash of its id,
so the highest scores are a draw without replacement in proportion to exp(weight / 1000). The draw is exact at every size:
scores are sorted by range over all partitions, and a row's rank is its place plus the sizes of the partitions before it.

Texts are read twice, for the counts and for the weights; only a few numbers a document are shuffled. Memory is bounded by
a piece of a text and one counter a bucket.

Defined cases: null texts have no words; a text without a feature has weight 0 and is never drawn unless ``min_words`` is 0.
A null id is hashed as an empty one. Rows repeated with one id share its noise and are drawn each for itself; ties
between them are broken by a random number. Without target texts all t are 0. An empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.byte_words import DIGITS, LETTERS, PIECE, pieces, utf8, word_table
from threadloom.llm.common import pick, stage

BUCKETS = 10_000
ORDER = 2
MIN_WORDS = 20
SHARE = 25
SEED = 7
SCALE = 1000
TABLE = word_table(LETTERS + DIGITS)


class Hasher:
    """Buckets of the n-grams of a text."""

    def __init__(self, buckets: int, order: int, piece: int):
        self.buckets, self.order, self.piece = buckets, order, piece

    def buckets_of(self, text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
        """For each piece of a text its number of words and the buckets of the runs that end in it."""
        tails: list[list[int]] = [[] for _ in range(self.order - 1)]
        for words in pieces(text or b"", TABLE, self.piece):
            hashed = list(map(crc32, words))
            found = [np.fromiter(hashed, np.int64, len(hashed))]
            spaced = [b" " + w for w in words]
            for k in range(self.order - 1):
                # Runs of k + 1 words that end before each word; the first one's lie in the piece before.
                seeds = tails[k] + hashed[:-1]
                tails[k] = hashed[-1:]
                hashed = list(map(crc32, spaced[len(spaced) - len(seeds):], seeds))
                found.append(np.fromiter(hashed, np.int64, len(hashed)))
                if not hashed:
                    break
            yield len(words), np.concatenate(found) % self.buckets


def count_features(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, order: int = ORDER, piece: int = PIECE) -> np.ndarray:
    """Occurrences of each bucket over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets, order, piece), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in utf8(batch.column(0)):
                for _, found in hasher.buckets_of(text):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = pick(texts, text=text_col).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The floored log ratio of each bucket's smoothed shares, in parts of ``scale``."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(scale * math.log(r)) for r in ratio.tolist()], np.int64)


def weigh(
    docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, piece: int = PIECE,
) -> DataFrame:
    """Per row: id, n_words, n_features, weight (the floored mean gain)."""
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(gain), order, piece)
        for batch in batches:
            words, features, weights = [], [], []
            for text in utf8(batch.column(1)):
                n_words = n_features = total = 0
                for n, found in hasher.buckets_of(text):
                    n_words, n_features, total = n_words + n, n_features + len(found), total + int(gain[found].sum())
                words.append(n_words)
                features.append(n_features)
                weights.append(total // n_features if n_features else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (words, features, weights))],
                names=["id", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise in parts of ``scale`` from the first 32 bits of a SHA-256 of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-scale * F.log(-F.log(uniform)))


def with_place(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``place``, 1, 2, 3... in the given order over the whole table, without one task that sees all rows.
    Give a last key that tells any two rows apart, so that equal rows can be dealt to several tasks."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    ordered = stage(ordered, "ordered")
    sizes = sorted(tuple(r) for r in ordered.groupBy("_part").count().collect())  # a row for each task
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _before bigint")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return ordered.join(F.broadcast(offsets), "_part").withColumn("place", place).drop("_part", "_before", "_at")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, order: int = ORDER, min_words: int = MIN_WORDS, share: int = SHARE, seed: int = SEED, piece: int = PIECE,
) -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank (null if not drawn). Drawn are the floored ``share`` percent of the
    rows with at least ``min_words`` words that have the highest scores, ties to the smaller id."""
    gain = gains(count_features(docs, text_col, buckets, order, piece), count_features(target, target_text, buckets, order, piece))
    rows = weigh(docs, gain, id_col, text_col, order, piece)
    rows = rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("tie", F.rand())
    rows = stage(rows.withColumn("able", F.col("n_words") >= min_words), "scored")
    drawn = rows.where("able").count() * share // 100
    placed = with_place(rows, F.desc("able"), F.desc("score"), F.asc_nulls_last("id"), F.asc("tie"))
    rank = F.when(F.col("able") & (F.col("place") <= drawn), F.col("place"))
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
