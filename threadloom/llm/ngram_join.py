"""Self-join of documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

A document of n shingles shares at least T = ceil(0.8 n) of them with any partner. As in DivideSkip, its
T - 1 most frequent shingles' inverted lists are long ones, which are never merged: a partner must turn
up in a list of the others, the short ones. Occurrences in the short lists are not counted to drop pairs:
this is a prefix filter with size and positional filters. What is left is verified on the two token arrays.

Groups of copies do not cost the square of their size. Equal sets become one class before anything
is joined. Then each class is verified against one partner, the first class of the lists it is in;
only classes of different components so far are joined after that, each pair of components once a
list and then their members. Whatever is left out joins classes that are connected already.

Links are counted afterwards. All similar classes are in one component, so each component is cut into
blocks of similar size, and the overlaps of two blocks are one matrix product. Links are counted, not
listed: the rows that are made grow with the blocks, the work with the pairs of a component whose sizes fit.

Defined cases: words are what lies between ASCII white space, A-Z lower-cased. A null text, or one
without words, has no shingle, is linked with nothing and is a component of its own. A text of less
than five words has all of them as its one shingle. Repeated rows are each a document. A null id is
a document like others, but never names a component, unless nothing else can. An empty table gives
an empty result; other columns are never looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import row_key, stage
from threadloom.llm.components import components
from threadloom.llm.token_sets import (
    BLOCK_BYTES, BUCKET_BYTES, Threshold, one_per_class, prefix_postings, shared_tokens, similar_pairs,
)

# A block has up to about so many classes and tokens; block pairs of about so many tokens are counted at once.
BLOCK_CLASSES = 512
BLOCK_TOKENS = 128 << 10
CELL_TOKENS = 512 << 10
# Columns of a matrix at once.
TOKENS = 4096


def sizes_fit(one: str, other: str, threshold: Threshold) -> str:
    """Whether two sizes allow the similarity at all."""
    p, w = threshold.part, threshold.whole
    return f"{one} * {w} >= {other} * {p} AND {other} * {w} >= {one} * {p}"


def largest_partner(threshold: Threshold) -> Column:
    """The size of the largest set that a posting's set can be similar to if this token is the first they
    share: all that can be shared is this token and what follows it (positional filter)."""
    p, w = threshold.part, threshold.whole
    return F.floor((F.col("n") - F.col("place")) * (p + w) / p).cast("bigint") - F.col("n")


def first_links(postings: DataFrame, candidates: DataFrame, threshold: Threshold) -> DataFrame:
    """Similar pairs of each class and one partner: of the heads of its lists the most central one. A list's
    head is its class with the fewest tokens of its own, which near copies differ from least."""
    rank = F.struct("alone", "class")
    heads = postings.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "n", "reach")).alias("head"))
    pairs = postings.join(heads, "token").where(rank > F.col("head.rank")).select(
        F.col("class").alias("other"), F.col("n").alias("other_n"), F.col("reach").alias("other_reach"),
        F.col("head.rank").alias("rank"), F.col("head.n").alias("one_n"), F.col("head.reach").alias("one_reach"))
    pairs = pairs.where(sizes_fit("one_n", "other_n", threshold)).where("one_n <= other_reach AND other_n <= one_reach")
    pairs = pairs.groupBy("other").agg(F.min("rank").alias("rank"))
    return similar_pairs(pairs.select("other", F.col("rank.class").alias("one")), candidates, threshold)


def further_links(
    postings: DataFrame, found: DataFrame, candidates: DataFrame, threshold: Threshold
) -> DataFrame:
    """Similar pairs of classes that are not in one component yet."""
    known = found.withColumnRenamed("node", "class")
    rows = postings.join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))
    several = rows.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    rows = stage(rows.join(several.where("a <> b").select("token"), "token", "left_semi"), "mixed")
    parts = rows.groupBy("token", "component").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("reach"))
    parts = stage(parts, "parts")
    a, b = (
        parts.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("component", "low", "high", "reach")]) for s in "ab")
    p, w = threshold.part, threshold.whole
    meet = a.join(b, "token").where("a_component < b_component").where(
        f"a_high * {w} >= b_low * {p} AND b_high * {w} >= a_low * {p} AND a_low <= b_reach AND b_low <= a_reach"
    ).select("token", "a_component", "b_component")
    for side, name in (("a", "one"), ("b", "other")):
        meet = meet.join(rows.select(
            "token", F.col("component").alias(f"{side}_component"), F.col("class").alias(name),
            F.col("n").alias(f"{name}_n"), F.col("reach").alias(f"{name}_reach")), ["token", f"{side}_component"])
    pairs = meet.where(sizes_fit("one_n", "other_n", threshold)).where("one_n <= other_reach AND other_n <= one_reach")
    pairs = stage(pairs.select("one", "other").distinct(), "pairs")
    return similar_pairs(pairs, candidates, threshold)


def overlaps(tokens: np.ndarray, rows: np.ndarray, first: int, count: int) -> np.ndarray:
    """Overlaps of the first rows with the others, or with themselves if there are no others."""
    unique, at, held = np.unique(tokens, return_inverse=True, return_counts=True)
    column = (np.cumsum(held > 1) - 1)[at]
    rows, column = rows[held[at] > 1], column[held[at] > 1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((first, count - first or first))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, TOKENS):
        part = slice(*np.searchsorted(column, (low, low + TOKENS)))
        matrix = np.zeros((count, TOKENS), np.float32)
        matrix[rows[part], column[part] - low] = 1
        out += matrix[:first] @ (matrix[first:] if count > first else matrix).T
    return out


def count_links(candidates: DataFrame, found: DataFrame, threshold: Threshold) -> DataFrame:
    """Of each class that has links their number: class, n_links."""
    band = F.floor(F.log(F.col("n")) / math.log(threshold.whole / threshold.part)) if threshold.part < threshold.whole else F.col("n")
    places = candidates.select("class", "n", F.size("tokens").alias("weight")).join(
        found.withColumnRenamed("node", "class"), "class").withColumn("band", band)
    blocks = places.groupBy("component", "band").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("weight") / BLOCK_TOKENS)).alias("blocks"))
    places = stage(places.join(blocks, ["component", "band"]).withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks"))).drop("blocks"), "places")
    key = F.struct("band", "block").alias("key")
    blocks = places.groupBy("component", key).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.sum("weight").alias("weight"))
    blocks = stage(blocks, "blocks")
    a, b = (blocks.select("component", *[F.col(c).alias(f"{s}_{c}") for c in ("key", "low", "high", "weight")]) for s in "ab")
    p, w = threshold.part, threshold.whole
    meet = a.join(b, "component").where("a_key <= b_key").where(f"a_high * {w} >= b_low * {p} AND b_high * {w} >= a_low * {p}")
    meet = stage(meet.select(
        F.monotonically_increasing_id().alias("pair"), "component", "a_key", "b_key",
        (F.col("a_weight") + F.col("b_weight")).alias("weight")), "meet")
    cells = max(1, -(-(meet.agg(F.sum("weight")).head()[0] or 0) // CELL_TOKENS))
    sides = meet.select("pair", "component", F.inline(F.when(
        F.col("a_key") == F.col("b_key"), F.array(F.struct(F.lit(0).alias("side"), F.col("a_key").alias("key")))).otherwise(
        F.array(*[F.struct(F.lit(i).alias("side"), F.col(k).alias("key")) for i, k in enumerate(("a_key", "b_key"))])))
        .alias("side", "key"))
    rows = sides.select("pair", "side", "component", "key.band", "key.block").join(
        places.select("component", "band", "block", "class"), ["component", "band", "block"])
    rows = rows.join(candidates.select("class", "n", "tokens"), "class").select(
        F.pmod(F.xxhash64("pair"), F.lit(cells)).alias("cell"), "pair", "side", "class", "n", "tokens")

    def count(group: pa.Table) -> pa.Table:
        group = group.sort_by([("pair", "ascending"), ("side", "ascending")]).combine_chunks()
        pair, side, name, n = (group.column(c).to_numpy() for c in ("pair", "side", "class", "n"))
        lists = group.column("tokens").combine_chunks()
        edges = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        flat = lists.flatten().to_numpy()
        links = np.zeros(len(pair), np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True])))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first, size = int((side[low:high] == 0).sum()), n[low:high]
            owners = np.repeat(np.arange(high - low), np.diff(edges[low:high + 1]))
            shared = overlaps(flat[edges[low]:edges[high]], owners, first, high - low)
            itself = first == high - low
            good = threshold.similar(shared, size[:first, None], (size if itself else size[first:])[None, :])
            if itself:
                np.fill_diagonal(good, False)
            links[low:low + first] += good.sum(axis=1)
            if not itself:
                links[low + first:high] += good.sum(axis=0)
        some = links > 0
        return pa.table([pa.array(name[some]), pa.array(links[some])], names=["class", "links"])

    counted = rows.groupBy("cell").applyInArrow(count, "class bigint, links bigint")
    return counted.groupBy("class").agg(F.sum("links").alias("n_links"))


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Threshold = Threshold(),
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, with_links: bool = True,
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach), class_id (equal sets
    have equal ones), n_links (other classes that are similar to its own; null unless ``with_links``)."""
    records = shared_tokens(docs, threshold, False, id_col, text_col, block_bytes, bucket_bytes)
    candidates = stage(one_per_class(records), "candidates")
    postings = prefix_postings(candidates).withColumn("reach", largest_partner(threshold))
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    postings = stage(postings.join(lists, "token", "left_semi"), "postings")

    links = stage(first_links(postings, candidates, threshold), "links")
    found = components(links)
    more = stage(further_links(postings, found, candidates, threshold), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    degree = count_links(candidates, stage(found, "found"), threshold) if with_links else None

    classes = records.where("n > 0").groupBy("class").agg(
        F.min("id").alias("least"), F.min("check").alias("a"), F.max("check").alias("b"))
    # Two different sets of one class would be merged; this has odds of one to 10^9 at 10^5 documents squared.
    classes = classes.select("class", "least", F.assert_true(F.col("a") == F.col("b")).alias("sound"))
    classes = classes.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    classes = classes.join(degree, "class", "left") if with_links else classes.withColumn("n_links", F.lit(None).cast("bigint"))
    classes = stage(classes, "classes")
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(classes.join(names, "component").select("class", "component_id", "n_links"), "named")
    plain = records.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class"))
    out = plain.join(named, "class", "left")
    return out.select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        F.col("class").alias("class_id"), (F.coalesce("n_links", F.lit(0)) if with_links else F.col("n_links")).alias("n_links"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The table with one row of each component: the one with the smallest id, of equal ids the one whose text has the smallest hash.
    Rows are told apart by id and text, so a row never goes for its id alone, and of rows equal in both one stays. Texts without
    a word stay all."""
    key = "_row_" + "_".join(docs.columns)
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    texts = keyed.select(F.col(key).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = similar_documents(texts, "row", "text", with_links=False, **options)
    found = stage(found.where("n_shingles > 0").groupBy("row", "component_id").agg(F.count(F.lit(1)).alias("rows")), "rows")
    copies = found.where("row <> component_id").select(F.col("row").alias(key))
    kept = keyed.join(copies.hint("merge"), key, "left_anti")
    # Equal rows whose component they name are more than one row that stays.
    equal = stage(found.where("row = component_id AND rows > 1").select(F.col("row").alias(key)), "equal")
    if not equal.isEmpty():
        kept = kept.join(equal, key, "left_anti").unionByName(kept.join(equal, key, "left_semi").dropDuplicates([key]))
    return kept.select(docs.columns)
