"""How far the sources of each language lie apart in their terms, and which terms tell a source from its language.

Terms are runs of letters (all non-ASCII signs count as such), A-Z lower-cased; each language keeps the terms of at least
``min_docs`` of its documents. A group is a language and a source. A group's and a language's share of a term is the
smoothed integer p = 1 + floor(10^9 (count + a) / (N + a V)), with N the count of kept terms and V their number.

Terms that stand out: a group's terms fall into cells by (count in the group, count in the language), and all terms of a cell have one
value f = p - q. So f is evaluated per cell, cells of equal value are merged into classes, and a class's first rank is one more
than the number of terms in the classes above. Only the classes that begin within the wanted ranks are expanded, each by its terms
in UTF-8 order. Sources that differ: f summed over all kept terms for each pair of sources. A kept term is one row with its counts by
source; it is dealt to blocks of source pairs, and tasks add up a matrix for each block from dense arrays of terms, so rows for
pairs of each term never exist. A pair's sum is exact in 64 bits for up to nine thousand million terms a language.

Counting sums in each task first, so that a hot source or term costs a task one row at a time when its counter is full; every shuffle
is of such sums. No window sees more than a task's share of a group's classes or terms before its first ranks are taken.

Defined cases: null text, language and source are ''. A language without a kept term has V = 0: its pairs have value 0 and rank by name, it has
no terms. A source that is alone in its language has no pairs. Repeated rows count each. An empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.byte_words import LETTERS, PIECE, pieces, utf8, word_table
from threadloom.llm.common import pick, stage

MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
SMOOTHING = 5
TABLE = word_table(LETTERS)
# Terms and their bytes that a task counts before it hands them on.
HELD_TERMS = 700_000
HELD_BYTES = 32 << 20
# Sources in a block of pairs; cells of a dense array of terms; tasks that share a block.
BLOCK = 256
DENSE = 1 << 20
SHARES = 32
# Up to so many groups their figures are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 50_000
# A group's classes and terms are dealt to so many parts, whose first ranks are taken apart.
PARTS = 16


def count_terms(docs: DataFrame, piece: int = PIECE, held_terms: int = HELD_TERMS) -> DataFrame:
    """Partial sums: lang, source, term, docs, n. Each group also has rows with a null term, also if it has no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            for (lang, source), (n, docs) in groups.items():
                terms = [None, *n]
                for low in range(0, len(terms), 20_000):
                    part = terms[low:low + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(lang), len(part)), pa.repeat(pa.scalar(source), len(part)),
                         pa.array(part, pa.binary()).cast(pa.string()), pa.array(list(map(docs.__getitem__, part)), pa.int64()),
                         pa.array(list(map(n.__getitem__, part)), pa.int64())], names=["lang", "source", "term", "docs", "n"])
            groups.clear()
            held = size = 0

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, utf8(batch.column(2)), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                own, before = set(), len(n)
                for words in pieces(text or b"", TABLE, piece):
                    n.update(words)
                    own.update(words)
                docs.update(own)
                if len(n) > before:
                    held += len(n) - before
                    # New words are taken to be as long as the text's others; none is longer than them all.
                    size += sum(map(len, own)) * (len(n) - before) // len(own)
                if held > held_terms or size > HELD_BYTES or len(groups) > held_terms // 8:
                    yield from hand_on()
        yield from hand_on()

    return docs.mapInArrow(run, "lang string, source string, term string, docs bigint, n bigint")


def share(n: Column | str, total: str, v: str, scale: int, smoothing: int) -> Column:
    """The smoothed share of a count, in exact integers at every size."""
    wide = F.col(n).cast("decimal(20,0)") if isinstance(n, str) else n.cast("decimal(20,0)")
    above = (wide + F.lit(smoothing).cast("decimal(20,0)")) * F.lit(scale).cast("decimal(12,0)")
    below = (F.col(total) + F.lit(smoothing) * F.col(v)).cast("decimal(20,0)")
    return F.when(below > 0, F.call_function("div", above, below) + 1).otherwise(F.lit(1)).cast("bigint")


def first_ranks(rows: DataFrame, keys: list[str], order: list[Column], top: int) -> DataFrame:
    """Each group's first rows in an order, with ``nth``. Parts of a group give their first rows before the group does."""
    part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(PARTS))
    apart = rows.withColumn("_part", part)
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    apart = apart.withColumn("_nth", nth).where(F.col("_nth") <= top).drop("_nth", "_part")
    return apart.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= top)


def standing_out(kept: DataFrame, groups: DataFrame, top: int, scale: int, smoothing: int) -> DataFrame:
    """lang, source, item, value, rank of the terms whose share in the group is above the language's."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("m"))
    cells = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "n", "lang_n", "m",
        (share("n", "group_total", "v", scale, smoothing) - share("lang_n", "lang_total", "v", scale, smoothing)).alias("f"))
    cells = stage(cells.where("f > 0"), "cells")
    classes = cells.groupBy("lang", "source", "f").agg(F.sum("m").alias("m"))
    classes = first_ranks(classes, ["lang", "source"], [F.desc("f")], top)
    above = F.sum("m").over(Window.partitionBy("lang", "source").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1))
    classes = classes.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < top)
    # The cells of those classes lead back to their terms.
    wanted = cells.join(classes.select("lang", "source", "f", "above"), ["lang", "source", "f"]).drop("m")
    terms = kept.join(wanted, ["lang", "source", "n", "lang_n"]).select("lang", "source", "f", "above", "term")
    terms = first_ranks(terms, ["lang", "source", "f"], [F.asc("term")], top)
    rank = F.col("above") + F.col("nth")
    return terms.where(rank <= top).select("lang", "source", F.col("term").alias("item"), F.col("f").alias("value"), rank.alias("rank"))


def pair_sums(kept: DataFrame, groups: DataFrame, scale: int, smoothing: int, block: int = BLOCK, dense: int = DENSE) -> DataFrame:
    """lang, a, b (numbers of sources, both ways), value."""
    own = groups.select("lang", "source", "place", "last", "group_total", "v")
    shares = kept.join(own, ["lang", "source"]).select(
        "lang", "term", "place", "last", share("n", "group_total", "v", scale, smoothing).alias("p"))
    # A term's list has at most an entry for each source of its language.
    vectors = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "p")).alias("entries"), F.max("last").alias("last"))

    def blocks(rows: DataFrame) -> DataFrame:
        """A row for each pair of blocks i <= j of the row's language."""
        end = F.floor(F.col("last") / block).cast("int")
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), end)).alias("i"))
        return rows.select("*", F.explode(F.sequence("i", end)).alias("j"))

    def within(which: str) -> Column:
        low = F.col(which) * block
        return F.filter("entries", lambda e: (e["place"] >= low) & (e["place"] < low + block))

    terms = blocks(vectors).select("lang", "i", "j", within("i").alias("e_i"), within("j").alias("e_j"), F.lit(1).alias("terms"),
                                   F.pmod(F.xxhash64("term"), F.lit(SHARES)).cast("int").alias("share"))
    # Each share of a block starts with a row without a term: it has the shares of terms that a source lacks, and makes
    # a block's pairs come up in any case.
    absent = groups.select("lang", F.floor(F.col("place") / block).cast("int").alias("at"), "place", "last",
                           share(F.lit(0), "group_total", "v", scale, smoothing).alias("p"))
    absent = absent.groupBy("lang", "at", "last").agg(F.array_sort(F.collect_list(F.struct("place", "p"))).alias("e"))
    starts = blocks(absent.select("lang", "last").distinct())
    for which in ("i", "j"):
        starts = starts.join(absent.select("lang", F.col("at").alias(which), F.col("e").alias(f"e_{which}")), ["lang", which])
    starts = starts.select("lang", "i", "j", "e_i", "e_j", F.lit(0).alias("terms"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    rows = terms.unionByName(starts)
    rows = rows.repartition("lang", "i", "j", "share").sortWithinPartitions("lang", "i", "j", "terms")
    rows = rows.select("lang", "i", "j", "terms", *[F.col(f"e_{w}.{c}").alias(f"{c}_{w}") for w in "ij" for c in ("place", "p")])

    def filled(absent: np.ndarray, places: pa.Array, p: pa.Array, low: int) -> np.ndarray:
        """A row for each term, a column for each source of the block."""
        lens = np.diff(places.offsets.to_numpy())
        out = np.tile(absent, (len(lens), 1))
        out[np.repeat(np.arange(len(lens)), lens), places.flatten().to_numpy() - low] = p.flatten().to_numpy()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, absent = None, np.zeros((0, 0), np.int64), []

        def hand_on() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            a, b = np.triu_indices(len(total), 1) if key[1] == key[2] else map(np.ravel, np.indices(total.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(a), pa.string()), pa.array(key[1] * block + a, pa.int64()), pa.array(key[2] * block + b, pa.int64()),
                 pa.array(total[a, b])], names=["lang", "a", "b", "value"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            starting = batch.column(3).to_numpy() == 0
            low = 0
            while low < len(keys):
                high = low + 1
                while high < len(keys) and keys[high] == keys[low] and starting[high] == starting[low]:
                    high += 1
                if keys[low] != key:
                    yield from hand_on()
                    key, absent = keys[low], [np.array(batch.column(c)[low].as_py(), np.int64) for c in (5, 7)]
                    total = np.zeros([len(z) for z in absent], np.int64)
                step = max(1, dense // sum(total.shape))
                for start in range(low, low if starting[low] else high, step):
                    part = batch.slice(start, min(step, high - start))
                    p = filled(absent[0], part.column(4), part.column(5), key[1] * block)
                    same = key[1] == key[2]
                    q = p if same else filled(absent[1], part.column(6), part.column(7), key[2] * block)
                    for row in range(len(total)):
                        first = row + 1 if same else 0
                        total[row, first:] += np.abs(q[:, first:] - p[:, row:row + 1]).sum(axis=0)
                low = high
        yield from hand_on()

    sums = rows.mapInArrow(run, "lang string, a bigint, b bigint, value bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return sums.select("lang", F.inline(both), "value")


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS,
    top: int = TOP, scale: int = SCALE, smoothing: int = SMOOTHING, block: int = BLOCK, piece: int = PIECE,
) -> DataFrame:
    """lang, source, part ("pair" or "term"), item (the other source, or a term), value, rank: all other sources of the group's language by
    the summed difference of shares, and the group's ``top`` terms above the language's share; greatest value first, ties by item."""
    rows = pick(docs, lang=lang_col, source=source_col, text=text_col)
    rows = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    counts = count_terms(rows, piece).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    counts = stage(counts, "counts")
    found = counts.where("term IS NOT NULL")
    totals = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    totals = stage(totals.where(F.col("docs") >= min_docs).select("lang", "term", "lang_n"), "terms")
    kept = stage(found.select("lang", "source", "term", "n").join(totals, ["lang", "term"]), "kept")

    langs = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = counts.where("term IS NULL").select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.fillna(0, ["v", "lang_total", "group_total"]).withColumn("place", place)
    groups = groups.withColumn("last", F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1)
    groups = stage(groups, "groups")
    few = groups.count() <= BROADCAST_GROUPS
    light = F.broadcast(groups) if few else groups

    names = groups.select("lang", "source", "place")
    names = F.broadcast(names) if few else names
    pairs = pair_sums(kept, light, scale, smoothing, block)
    pairs = pairs.join(names.withColumnRenamed("place", "a"), ["lang", "a"])
    pairs = pairs.join(names.withColumnsRenamed({"place": "b", "source": "item"}), ["lang", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = standing_out(kept, light, top, scale, smoothing).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")))
