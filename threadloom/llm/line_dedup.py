"""Removes lines that are all but equal to an earlier line of the corpus.

An exact set-similarity join of lines. A line's tokens are its five-word shingles, ordered by rarity
over all lines; lines with a Jaccard similarity of 0.8 or more meet in an inverted index of the
rarest tokens (prefix filter), if their sizes (length filter) and the places of the tokens they share
(positional filter) allow it, and are then verified. A line goes if any earlier one is similar,
whether or not that one stays itself, so the result does not depend on the order of work. Earlier
means a smaller document id, or a smaller line number in the same document.

A line only needs one earlier match. Equal sets are one class, represented by its first line; a class
is verified against an early and a central class of its lists, and only what found no match is joined
with all earlier classes of its lists.

Defined cases: words are what lies between ASCII white space, A-Z lower-cased; a line without words
stays, a line of less than five has them all as its one token. A null text stays null. Rows
repeated with one id are documents of their own if their texts differ, in an order that does not depend on the work; rows
that are equal in id and text count as one, which loses the same lines in all of them. Lines of a row without
id are never removed. A document without a line left has an empty text. An empty table gives an
empty result; other columns come through as they are, except ``n_chars``, which is counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import row_key, stage
from threadloom.llm.ngram_join import largest_partner, sizes_fit
from threadloom.llm.token_sets import (
    BLOCK_BYTES, BUCKET_BYTES, Threshold, one_per_class, prefix_postings, shared_tokens, similar_pairs,
)


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Threshold = Threshold(),
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """The lines that go: id (the key of a row, see ``row_key``), line (from 0)."""
    known = docs.where(F.col(f"`{id_col}`").isNotNull()).select(row_key(id_col, text_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    records = shared_tokens(known, threshold, True, "id", "text", block_bytes, bucket_bytes)
    firsts = records.where("n > 0").groupBy("class").agg(
        F.min(F.struct("id", "line")).alias("first"), F.min("check").alias("a"), F.max("check").alias("b"))
    firsts = stage(firsts.select("class", "first", F.assert_true(F.col("a") == F.col("b")).alias("sound")), "firsts")
    candidates = stage(one_per_class(records), "candidates")
    postings = prefix_postings(candidates).withColumn("reach", largest_partner(threshold))
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    postings = postings.join(lists, "token", "left_semi").join(firsts.select("class", "first"), "class")
    postings = stage(postings, "postings")

    # Two chances before anything is joined in full: the earliest line of a list, and its most central one,
    # which has the fewest tokens of its own.
    head = F.struct("first", "class", "n", "reach")
    heads = postings.groupBy("token").agg(
        F.min(head).alias("earliest"), F.min_by(head, F.struct("alone", "first")).alias("central"))
    pairs = postings.join(heads, "token").select(
        "class", "n", "first", "reach", "alone", F.explode(F.array("earliest", "central")).alias("head"))
    pairs = pairs.select(F.col("class").alias("one"), F.col("n").alias("one_n"), F.col("reach").alias("one_reach"), *[
        F.col(f"head.{c}").alias(f"other{d}") for c, d in (("class", ""), ("n", "_n"), ("reach", "_reach"), ("first", "_first"))
    ], "first").where("other_first < first")
    pairs = pairs.where(sizes_fit("one_n", "other_n", threshold)).where("one_n <= other_reach AND other_n <= one_reach")
    pairs = pairs.groupBy("one").agg(F.min(F.struct("other_first", "other")).alias("a"), F.max(
        F.struct("other_first", "other")).alias("b")).select("one", F.explode(F.array("a.other", "b.other")).alias("other"))
    matched = similar_pairs(pairs.distinct(), candidates, threshold).select("one").distinct()
    matched = stage(matched, "matched")

    left = postings.join(matched.withColumnRenamed("one", "class"), "class", "left_anti")
    sides = [
        rows.select("token", *[F.col(c).alias(f"{name}_{c}") for c in ("class", "n", "first", "reach")])
        for name, rows in (("one", left), ("other", postings))
    ]
    pairs = sides[0].join(sides[1], "token").where("other_first < one_first").where(
        sizes_fit("one_n", "other_n", threshold)).where("one_n <= other_reach AND other_n <= one_reach")
    pairs = pairs.select(F.col("one_class").alias("one"), F.col("other_class").alias("other"))
    pairs = stage(pairs.distinct(), "pairs")
    matched = matched.unionByName(similar_pairs(pairs, candidates, threshold).select("one")).distinct()

    firsts = firsts.join(matched.select(F.col("one").alias("class"), F.lit(True).alias("goes")), "class", "left")
    firsts = stage(firsts.select("class", "first", "goes"), "decided")
    lines = records.where("n > 0").select("id", "line", "class").join(firsts, "class")
    return lines.where("goes OR (id, line) <> (first.id, first.line)").select("id", "line")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Threshold = Threshold(),
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All columns of the table, its texts without repeated lines; lines_removed is added (replaced, if
    the table has such a column)."""
    gone = repeated_lines(docs, id_col, text_col, threshold, block_bytes, bucket_bytes)
    gone = gone.groupBy("id").agg(F.collect_set("line").alias("_gone"))
    # Names that no column of the table has.
    mark, key = "_gone_" + "_".join(docs.columns), "_gone_key_" + "_".join(docs.columns)
    gone = stage(gone.select(F.col("id").alias(key), F.col("_gone").alias(mark)), "gone")
    docs = docs.drop("lines_removed").withColumn(key, row_key(id_col, text_col))
    # The list grows with the corpus, so it is never broadcast.
    out = docs.join(gone.hint("merge"), key, "left").drop(key)
    # A set of numbers as a map: looked up once a line.
    gone_map = F.map_from_arrays(F.col(mark), F.transform(mark, lambda _: F.lit(True)))
    rest = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda _, i: F.try_element_at(
        gone_map, i.cast("bigint")).isNull()), "\n")
    text = F.when(F.col(mark).isNull(), F.col(f"`{text_col}`")).otherwise(rest)
    changed = {text_col: text, "lines_removed": F.coalesce(F.size(mark), F.lit(0))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(mark).isNull(), F.col("n_chars")).otherwise(F.char_length(rest))
    return out.withColumns(changed).drop(mark)
