"""Insight items: from model answers to validated, merged rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.catalogue import GROUP_VOCABULARY, INTENSITIES, SENTIMENTS, VIDEO_VOCABULARY, Vocabulary
from threadloom.functions.measures import intensity_rank

EVIDENCE_CHARS = 200


def ask(df: DataFrame, answer: Callable[[str], str], prompt_col: str = "prompt") -> DataFrame:
    """Adds ``raw``: the answer to each prompt, NULL where the call failed.

    Only the prompt crosses to Python; calls run in parallel over partitions and
    the callable brings its own pacing. Answers may differ between calls, so
    write the result before using it twice."""

    def safe(prompt):
        try:
            return answer(prompt)
        except Exception:  # foreign code; a failed call is an answer without items
            return None

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield prompts.map(safe, na_action="ignore")

    return df.withColumn("raw", call.asNondeterministic()(F.col(prompt_col)))


def answered(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose every part has an answer, be it one without items."""
    parts = answers.groupBy(*keys).agg(F.count_if(F.col("raw").isNull()).alias("_failed"))
    return parts.where("_failed = 0").select(*keys)


def normalise_entity(col: Column, vocab: Vocabulary) -> Column:
    col = F.regexp_replace(col, r"^\s+|\s+$", "")
    if vocab.fold_case:
        col = F.lower(col)
    for alias, name in vocab.aliases:
        col = F.when(col == alias, F.lit(name)).otherwise(col)
    return col


def parse_answers(
    df: DataFrame, vocab: Vocabulary, raw_col: str = "raw", keep: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Items of the JSON array inside each answer, one row per valid item, with its position.

    Answers without an array or with broken JSON give no rows. Items outside
    the vocabulary are skipped. An item whose ``mention_count`` is not a number is
    rejected; ``strict`` rejects every item of such an answer instead."""
    names = [vocab.entity_field, "aspect", "sentiment", "intensity", "mention_count", "evidence"]
    schema = "array<struct<" + ", ".join(f"{n} string" for n in names) + ">>"
    array = F.regexp_extract(F.col(raw_col), r"(?s)\[.*\]", 0)
    items = F.from_json(F.nullif(array, F.lit("")), schema)

    def count(i: Column) -> Column:
        return F.floor(F.coalesce(i["mention_count"], F.lit("1")).try_cast("double")).cast("int")

    if strict:
        items = F.when(F.forall(items, lambda i: i.isNull() | count(i).isNotNull()), items)
    rows = df.select(*keep, F.posexplode_outer(items).alias("pos", "i")).where(F.col("i").isNotNull())
    folded = (lambda c: F.lower(c)) if vocab.fold_case else (lambda c: c)
    aspect = folded(F.regexp_replace(F.coalesce("i.aspect", F.lit("")), r"^\s+|\s+$", ""))
    typed = rows.select(
        *keep, "pos",
        normalise_entity(F.coalesce(F.col("i")[vocab.entity_field], F.lit("")), vocab).alias(vocab.entity_field),
        aspect.alias("aspect"),
        F.coalesce("i.sentiment", F.lit("neutral")).alias("sentiment"),
        F.coalesce("i.intensity", F.lit("mild")).alias("intensity"),
        count(F.col("i")).alias("mention_count"),
        F.substring(F.coalesce("i.evidence", F.lit("")), 1, EVIDENCE_CHARS).alias("evidence"),
    )
    return in_vocabulary(typed.where(F.col("mention_count").isNotNull()), vocab)


def in_vocabulary(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Rows whose entity and aspect are allowed."""
    kept = df.where(F.col(vocab.entity_field).isin(*vocab.entities))
    if vocab.aspects is None:
        return kept.where(F.coalesce("aspect", F.lit("")) != "")
    return kept.where(F.col("aspect").isin(*vocab.aspects))


def default_fields(df: DataFrame) -> DataFrame:
    """Unknown sentiment -> neutral, unknown intensity -> mild, count at least 1, evidence cut."""
    def one_of(name: str, allowed, default: str) -> Column:
        return F.when(F.col(name).isin(*allowed), F.col(name)).otherwise(F.lit(default))

    return df.withColumns({
        "sentiment": one_of("sentiment", SENTIMENTS, "neutral"),
        "intensity": one_of("intensity", INTENSITIES, "mild"),
        "mention_count": F.greatest(F.coalesce("mention_count", F.lit(1)), F.lit(1)),
        "evidence": F.substring(F.coalesce("evidence", F.lit("")), 1, EVIDENCE_CHARS),
    })


def validate_post_insights(df: DataFrame, vocab: Vocabulary = GROUP_VOCABULARY) -> DataFrame:
    return default_fields(in_vocabulary(df, vocab))


def merge_thread_insights(
    items: DataFrame, keys: Sequence[str] = ("video_id", "thread_id"), vocab: Vocabulary = VIDEO_VOCABULARY
) -> DataFrame:
    """One row per thread, entity and aspect: majority sentiment ("mixed" on a tie),
    intensity and evidence of the most intense item (the first one on ties), summed mentions.

    Counts per sentiment come first, so no group's items are ever gathered."""
    entity = normalise_entity(F.col(vocab.entity_field), vocab)
    group = [*keys, vocab.entity_field, "aspect"]
    best = F.min(F.struct(
        (-intensity_rank(F.col("intensity"), otherwise=0)).alias("weakness"), "pos", "intensity", "evidence"
    ))
    per_sentiment = items.withColumn(vocab.entity_field, entity).groupBy(*group, "sentiment").agg(
        F.count("*").alias("n"), F.sum("mention_count").alias("mentions"), best.alias("best")
    )
    last_winner = F.max(F.struct("n", "sentiment"))["sentiment"]
    first_winner = F.min(F.struct((-F.col("n")).alias("n"), F.col("sentiment")))["sentiment"]
    merged = per_sentiment.groupBy(*group).agg(
        first_winner.alias("first"), last_winner.alias("last"), F.sum("mentions").alias("mention_count"),
        F.min("best").alias("best"),
    )
    return merged.select(
        *group, F.when(F.col("first") == F.col("last"), F.col("first")).otherwise("mixed").alias("sentiment"),
        "best.intensity", F.col("mention_count").cast("int").alias("mention_count"), "best.evidence",
    )


def merge_parts(items: DataFrame, keys: Sequence[str], vocab: Vocabulary = GROUP_VOCABULARY) -> DataFrame:
    """Items of conversations that were asked about in several parts (columns part, parts, pos), merged over the parts by entity and
    aspect as those of a thread are. The items of a conversation in one part stay as they are."""
    alone = F.when(F.col("parts") <= 1, F.col("pos"))
    numbered = items.withColumn("_alone", alone).withColumn("pos", F.struct("part", "pos"))
    return merge_thread_insights(numbered, [*keys, "_alone"], vocab).drop("_alone")


def stamp_analysis(df: DataFrame, at) -> DataFrame:
    """``analyzed_at`` with its year and month."""
    at = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    return df.withColumn("analyzed_at", at).withColumns({
        "year": F.year("analyzed_at").cast("bigint"), "month": F.month("analyzed_at").cast("bigint"),
    })
