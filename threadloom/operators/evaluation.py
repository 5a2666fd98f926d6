"""Preparation and evaluation of labelled text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Model output -> label.
MODEL_LABELS = {"LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive"}


def split_bucket(key: Column, seed: int = 42) -> Column:
    """0..99 by a hash of key and seed; the same for a key in every run and engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100


def with_split(df: DataFrame, key: str, train_percent: int = 80, seed: int = 42) -> DataFrame:
    """``split``: "train" for about ``train_percent`` of the keys, else "test"."""
    return df.withColumn("split", F.when(split_bucket(F.col(key), seed) < train_percent, "train").otherwise("test"))


def map_model_labels(col: Column, names: dict[str, str] = MODEL_LABELS) -> Column:
    pairs = [F.lit(v) for pair in names.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), col)


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == F.col(predicted)).alias("correct"),
        F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("accuracy"),
    )


def macro_f1(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: the mean over all labels that occur as either of 2 tp / (2 tp + fp + fn), and how many labels those are."""
    counts = df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    same = F.col(label) == F.col(predicted)
    sides = counts.select(F.col("n"), same.alias("hit"), F.explode(F.array_distinct(F.array(label, predicted))).alias("name"))
    each = sides.where("name IS NOT NULL").groupBy("name").agg(
        F.sum(F.when(F.col("hit"), 2 * F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("hit"), 2 * F.col("n")).otherwise(F.col("n"))).alias("all"))
    return each.agg(F.count("*").alias("labels"), F.avg(F.col("good") / F.col("all")).alias("macro_f1"))


def confusion_matrix(df: DataFrame, labels: Sequence[str], label: str = "label", predicted: str = "predicted"):
    """One row per true label, one column per predicted label."""
    return df.groupBy(label).pivot(predicted, list(labels)).count().na.fill(0, list(labels))
