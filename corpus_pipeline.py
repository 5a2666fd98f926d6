"""The training-data pipeline: language ID, line dedup, n-gram Jaccard join, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept, and returns a
DataFrame. All but the last return the columns of ``documents``. ``run`` writes each stage's result as
Parquet in the shared folder and removes what no later stage reads. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontamination, language_id, line_dedup, ngram_join, packing
from threadloom.llm.common import remove_staged, stage, staged, table
from threadloom.llm.queries import tokenizer_file
from threadloom.session import apply_settings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null or no letter) and fills in missing labels. The score decides nothing: a
    short text of a known language has too few n-grams for a high one."""
    prototypes = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.predict(docs.select(*COLUMNS), prototypes)
    kept = found.where(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat an earlier one; a document that has nothing else goes. Null texts stay; rows of one id with
    different texts are documents of their own, and rows without id lose nothing."""
    found = line_dedup.dedup_lines(docs)
    emptied = (F.col("lines_removed") > 0) & ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    return found.where(~emptied).select(*COLUMNS)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id stays; rows of one id are told apart by their texts, and
    of equal rows one stays. Null and empty texts are nobody's copy and stay."""
    return ngram_join.without_copies(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item, each judged by its own text. Null and empty texts stay."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, each row for itself; a null text is packed as an empty one."""
    return packing.digest(packing.pack(docs, tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("language ID", identify_language), ("line dedup", dedup_lines), ("n-gram Jaccard join", join_ngrams),
    ("benchmark decontamination", decontaminate), ("packing", pack),
]

# Language profiles, tokenizers and components are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_settings(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        before = list(staged(spark))
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-").lower())
        # What this stage staged on the way, and the result it read, are of no more use.
        mine = [p for p in staged(spark) if p not in before]
        remove_staged(spark, mine[:-1] + ([previous] if name != STAGES[0][0] else []))
        previous = mine[-1]
    return docs
