"""Finds benchmark items in documents, verbatim or with other numbers, names and units.

DataFrame functions only. Texts are cut into words; numbers, names and units become typed placeholders
that keep their value beside them. Windows of thirteen words of the canonical form are hashed and
joined with the windows of the benchmark. Where windows meet, the slots are checked: over all windows of
an item that lie at one offset in a document, each value of the item must stand for one value of the
document and the other way round, else the match is a chance one of much the same shape. A window that is the same
word for word counts by itself, whatever the slots elsewhere hold.

What is a name depends on upper and lower case, so windows of the plain lower-cased words are hashed and
joined too. Both forms have their words at the same places.

A name is a capitalised word that follows a lower-case word, a number or a comma; a unit is one of a
list of words right after a number. So the form of a window's first word depends on what stands before the window. It is left out of
the hash and checked afterwards: it must be the same word, a placeholder of one type, or a name where the other
text has a word of no type (both being the first of their texts will do as well).
Windows of an item with less than seven words that are no placeholders
meet in the plain form only, so verbatim. An item of five to twelve words is one window; a shorter one is no
evidence of anything and is never found.

Defined cases: null texts are empty and match nothing. Rows repeated with one id are one document, which matches if one of them does. Rows
without id cannot be named and are never reported. Repeated or null benchmark ids are items like others.
An empty table on either side gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import pick, row_key, stage

WINDOW = 13
SHORTEST = 5
LITERALS = 7
# Up to so many benchmark windows are broadcast (some 40 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
MARK = "\x01"

# Units that become placeholders after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres "
    "gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees mph kmh watt watts volt volts joule joules"
).split()


def tokens(text: Column) -> Column:
    """Words in lower case; a placeholder is the mark, its type (n, a, u) and its value."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, " ")).otherwise(text)
    text = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;]\s)(\p{Lu}\p{L}*)", MARK + "a$1")
    numbers = F.regexp_replace(text, r"(?<![\p{L}\p{N}\x01])(\p{N}+(?:[.,]\p{N}+)*)", MARK + "n$1")
    # A unit written onto its number is parted from it in upper case too, so that case moves no word.
    number, unit = r"\x01n[\p{N}.,]{1,40}", "|".join(UNITS)
    units = F.regexp_replace(
        numbers, rf"(?<=[\p{{N}}., ])(?:(?<={number})(?i:{unit})|(?<={number} )(?:{unit}))(?![\p{{L}}\p{{N}}])", f" {MARK}u$0")
    text = F.when(F.rlike(text, F.lit(r"\p{N}")), units).otherwise(text)
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\x01.,]+|[.,]+(?!\p{N})"), lambda t: t != "")


def canonical(words: Column) -> Column:
    """Placeholders without their values."""
    return F.transform(words, lambda t: F.when(t.startswith(MARK), F.substring(t, 1, 2)).otherwise(t))


def plain(words: Column) -> Column:
    """Words alone: values instead of placeholders."""
    return F.transform(words, value)


def hashed(words: Column) -> list[Column]:
    """Hashes of the words in both forms; the second is null where there is no placeholder."""
    def hashes(form: Column) -> Column:
        return F.transform(form, lambda t: F.xxhash64(t))

    placed = F.exists(words, lambda t: t.startswith(MARK))
    return [hashes(canonical(words)).alias("shapes"), F.when(placed, hashes(plain(words))).alias("plains")]


def windows(length: int) -> Column:
    """Length, place and the word hashes, but for the first word, of each window of the columns shapes and plains (null
    where the text has no placeholder, so that both are the same); none if there are fewer words."""
    last = F.size("shapes") - length
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.lit(length).alias("length"), i.alias("at"), *[
        F.slice(c, i + 2, F.lit(length - 1)).alias(c) for c in ("shapes", "plains")]))


def all_windows(lengths: list[int]) -> Column:
    each = [windows(n) for n in lengths]
    return F.concat(*each) if each else F.array().cast("array<struct<length:int,at:int,shapes:array<bigint>,plains:array<bigint>>>")


def with_hashes(rows: DataFrame) -> DataFrame:
    """Adds the hashes of a window w in both forms. They are columns of their own, which Spark compiles."""
    shape = F.xxhash64("w.shapes")
    return rows.select("*", shape.alias("shape"), F.when(F.col("w.plains").isNull(), shape).otherwise(F.xxhash64("w.plains")).alias("plain"))


def forms(loose: Column) -> Column:
    """The hashes of a window to look it up by, without the first form if it is not ``loose``; one if both are equal."""
    both = [F.struct(F.col(c).alias("hash"), F.lit(c == "shape").alias("shaped")) for c in ("shape", "plain")]
    return F.when(~loose, F.array(both[1])).when(F.col("shape") == F.col("plain"), F.array(both[0])).otherwise(F.array(*both))


def value(word: Column) -> Column:
    return F.when(word.startswith(MARK), F.substring(word, 3, 1 << 30)).otherwise(word)


def first_fits(item: Column, doc: Column, starts: Column) -> Column:
    """Whether the first words of two windows may stand for each other; ``starts``: whether both start their texts."""
    same_type = item.startswith(MARK) & (F.substring(item, 1, 2) == F.substring(doc, 1, 2))
    name = (item.startswith(MARK + "a") & ~doc.startswith(MARK)) | (doc.startswith(MARK + "a") & ~item.startswith(MARK))
    return (value(item) == value(doc)) | same_type | name | (starts & ~item.startswith(MARK) & ~doc.startswith(MARK))


def literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda t: ~t.startswith(MARK)))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW, min_literals: int = LITERALS,
) -> DataFrame:
    """One row for each document, item and offset that match: id, item_id, offset (of the item's first
    word in the document, in words; negative if the item's start is missing), n_windows, n_slots, verbatim."""
    items = pick(benchmark, item=item_col, text=item_text)
    # Items are numbered by their place in a total order, so that repeated or null ids stay apart.
    items = stage(items.select("item", tokens(F.col("text")).alias("words"), F.expr("uuid()").alias("key")), "items")
    items = items.withColumn("length", F.least(F.size("words"), F.lit(window))).where(f"length >= {SHORTEST}")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most nine
    parts = F.filter(all_windows(lengths), lambda w: w["length"] == F.col("length"))
    wanted = items.select("key", "length", "words", *hashed(F.col("words"))).select(
        "key", "length", "words", F.explode(parts).alias("w"))
    loose = literals(F.slice("words", F.col("w.at") + 1, F.col("length"))) >= F.least(F.lit(min_literals), F.col("length"))
    wanted = with_hashes(wanted).select("key", "length", F.col("w.at").alias("item_at"), F.inline(forms(loose)).alias("hash", "item_shaped"))
    wanted = stage(wanted, "wanted")
    few = wanted.count() <= BROADCAST_WINDOWS

    rows = pick(docs, id=id_col, text=text_col).where("id IS NOT NULL")
    words = rows.select("id", tokens(F.col("text")).alias("words")).select("id", *hashed(F.col("words")))
    found = with_hashes(words.select("id", F.explode(all_windows(lengths)).alias("w")))
    found = found.select("id", "w.length", "w.at", F.inline(forms(F.lit(True))).alias("hash", "shaped"))
    hits = found.join(F.broadcast(wanted) if few else wanted, ["hash", "length"])
    by_shape = F.col("shaped") & F.col("item_shaped")
    hits = hits.groupBy("id", "key", "length", (F.col("at") - F.col("item_at")).alias("offset")).agg(
        F.collect_set(F.when(by_shape, F.col("item_at"))).alias("starts"), F.collect_set("item_at").alias("all"))
    hits = stage(hits, "hits")

    # The few texts that match at all are cut into words once more, now with the values in the slots.
    texts = rows.join(hits.select("id").distinct(), "id", "left_semi")
    texts = texts.select("id", tokens(F.col("text")).alias("doc_words"))
    both = hits.join(texts, "id").join(items.select("key", "item", "words"), "key")
    both = both.select("*", plain(F.col("words")).alias("values"), plain(F.col("doc_words")).alias("doc_values"))

    def in_doc(p: Column) -> Column:
        return F.get("doc_words", p + F.col("offset"))

    def slots(starts: Column) -> Column:
        covered = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + F.col("length") - 1)))
        return F.filter(F.array_distinct(covered), lambda p: F.get("words", p).startswith(MARK) | in_doc(p).startswith(MARK))

    both = both.withColumn("same", F.filter("all", lambda s: F.slice("values", s + 1, F.col("length")) == F.slice(
        "doc_values", s + F.col("offset") + 1, F.col("length"))))
    both = both.withColumn("starts", F.filter("starts", lambda s: first_fits(
        F.get("words", s), in_doc(s), (s == 0) & (F.col("offset") == 0))))
    filled = F.array_distinct(F.transform(slots(F.col("starts")), lambda p: F.struct(
        F.get("values", p).alias("a"), F.get("doc_values", p + F.col("offset")).alias("b"))))
    both = both.withColumn("slots", filled)
    one_to_one = (F.size("starts") > 0) & (F.size(F.array_distinct("slots.a")) == F.size("slots")) & (
        F.size(F.array_distinct("slots.b")) == F.size("slots"))
    both = both.withColumn("one_to_one", one_to_one).where("one_to_one OR size(same) > 0")
    both = both.withColumn("kept", F.when(F.col("one_to_one"), F.array_union("starts", "same")).otherwise(F.col("same")))
    return both.select(
        F.col("id").alias(id_col), F.col("item").alias("item_id"), F.col("offset").cast("bigint").alias("offset"),
        F.size("kept").cast("bigint").alias("n_windows"), F.size(slots(F.col("kept"))).cast("bigint").alias("n_slots"),
        (F.size("kept") == F.size("same")).alias("verbatim")).distinct()


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The table without the rows that hold a benchmark item. Each row is judged by its own text, whatever its id."""
    key = "_row_" + "_".join(docs.columns)
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    texts = keyed.select(F.col(key).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = contaminated(texts, benchmark, "row", "text", **options)
    found = stage(found.select(F.col("row").alias(key)).distinct(), "contaminated")
    return keyed.join(found, key, "left_anti").select(docs.columns)
