"""Toxicity of documents by maximum-scoring segments over token log-odds.

Learning: each labelled text says once which words it has and with which three to six letters they begin (their stems). A term's log-odds
between toxic and clean texts have a Dirichlet prior in proportion to the term's share of all labelled texts, so rare terms shrink towards 0, and a
term's score is the log-odds less ``Z`` standard deviations, if that is at least ``LEAST``: the more texts there are, the weaker the
leanings that stand out from chance, and these say nothing about a text. A word scores as its best term; words without one cost ``DRIFT``.

Scanning: all maximal segments of a text's scores are found in one pass from left to right, in time linear in the words with a positive score.
A word that occurred within the last ``NEAR`` words costs like any other, so that repeats in a row are one finding.

Calibration: a clean text of n words has a segment of score S or more with a probability of 1 - exp(-K n exp(-lambda S)), the
extreme-value law of such segments; K and lambda come from the clean labelled texts. A document's evidence is -ln of the probability of its best
segment and the sum of this over all its segments; a logistic curve through both, fitted to the labels, gives the score. While it
is fitted, a text's own label is taken out of the counts of its terms.

Exact copies with one label count once in learning. Learning takes at most about ``SAMPLE`` labelled ids, chosen by a hash, so the model
stays small; the terms go to tasks as one dictionary up to ``BROADCAST_TERMS``, and are joined to the words beyond.

Defined cases: null texts are empty. A text without a word that scores has no segment and no evidence and gets the least score. An id with labels 0 and 1
teaches both; null labels and ids teach nothing. Without labels of both kinds every score is 0. Rows repeated
with one id are scored each. An empty table gives an empty result. Columns named as those that are added are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.byte_words import LETTERS, pieces, word_table
from threadloom.llm.common import pick, stage

SAMPLE = 400_000
PRIOR = 0.2
Z = 3.0
LEAST = 0.2
DRIFT = 0.3
NEAR = 64
SHORT, LONG = 3, 6
LEAST_TOXIC = 3
THRESHOLD = 0.3
BROADCAST_TERMS = 300_000
# Distinct terms a learning task holds, words whose scores a task keeps, and the longest word it keeps.
HELD_TERMS = 500_000
HELD_WORDS = 500_000
LONGEST = 64
# A segment is reported as significant up to this probability.
SIGNIFICANT = 0.01
# Evidence beyond this decides nothing more; it is counted in cells of a half.
MOST_BEST, MOST_SUM, CELL = 100.0, 300.0, 0.5

TABLE = word_table(LETTERS)
SIGN_BYTES = frozenset((0xC2, 0xE2, 0xE3, 0xEF))
LETTER_RUN = re.compile(r"[^\W\d_]+")
# The same words in a text as the table leaves in its bytes, to find out where they are.
IN_TEXT = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Model:
    """Scores of terms, the constants of the extreme-value law, and the logistic curve."""

    terms: dict[str, float] = field(default_factory=dict)
    table: DataFrame | None = None
    decay: float = 1.0
    rate: float = 1.0
    curve: tuple[float, float, float] | None = None


def terms_of(word: bytes) -> tuple[str, ...]:
    """The whole word, marked by a blank, and its stems. What else than letters non-ASCII signs have put into it is left out."""
    letters = "".join(LETTER_RUN.findall(word.decode()))
    return (f"{letters} ", *(letters[:k] for k in range(SHORT, min(LONG, len(letters) - 1) + 1)))


class Kept(dict):
    """What a function tells of words, kept while there are not too many and they are not too long."""

    def __init__(self, tell):
        self.tell = tell

    def __missing__(self, word: bytes):
        value = self.tell(word)
        if len(word) <= LONGEST:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = value
        return value


def scorer(terms: dict[str, float]) -> Callable[[list[bytes]], list[float]]:
    """Scores of words. Most words begin like no term and are told by that alone."""
    kept = Kept(lambda word: max(0.0, *(terms.get(t, 0.0) for t in terms_of(word))))
    begun = {t.rstrip(" ").encode()[:SHORT] for t in terms}

    def scores(words: list[bytes]) -> list[float]:
        # A sign that is no letter may stand before a word's letters; such signs begin with these bytes.
        return [kept[w] if w[:SHORT] in begun or w[0] in SIGN_BYTES else 0.0 for w in words]

    return scores


def hits(text: str, scores: Callable[[list[bytes]], list[float]]) -> tuple[int, list[tuple[int, float]]]:
    """The number of words, and number and score of those that score."""
    found: list[tuple[int, float]] = []
    seen: dict[bytes, int] = {}
    n = 0
    for words in pieces(text.lower().encode("utf-8", "replace"), TABLE):
        values = scores(words)
        if any(values):
            for at in np.flatnonzero(values).tolist():
                if n + at - seen.get(words[at], -NEAR - 1) > NEAR:
                    found.append((n + at, values[at]))
                seen[words[at]] = n + at
        n += len(words)
    return n, found


def spans(text: str, found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Segments by places in the text instead of numbers of words."""
    if not found:
        return []
    wanted, places = {n for _, *ends in found for n in ends}, {}
    for n, match in enumerate(IN_TEXT.finditer(text)):
        if n in wanted:
            places[n] = match.span()
            if len(places) == len(wanted):
                break
    return [(score, places[a][0], places[b][1]) for score, a, b in found]


def segments(found: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments: score, and the numbers of their first and last word."""
    held: list[tuple[float, float, int, int]] = []
    total, last = 0.0, -1
    for place, value in found:
        total -= drift * (place - last - 1)
        low, total, last, start = total, total + value, place, place
        while True:
            # The nearest earlier segment that starts lower; those after it lie within any that joins it.
            at = len(held) - 1
            while at >= 0 and held[at][0] >= low:
                at -= 1
            if at < 0 or held[at][1] >= total:
                held.append((low, total, start, place))
                break
            low, start = held[at][0], held[at][2]
            del held[at:]
    return [(high - low, start, end) for low, high, start, end in held]


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, sample: int) -> DataFrame:
    """Distinct pairs of text and label of a bounded choice of labelled ids."""
    marks = pick(labels, id=label_id, toxic=label_col).where("id IS NOT NULL AND toxic IN (0, 1)").select("id", F.col("toxic").cast("int")).distinct()
    marks = stage(marks, "labels")
    portion = min(1.0, sample / max(marks.count(), 1))
    chosen = marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(portion * 1_000_000))
    rows = pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id")
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), "toxic").withColumn("hash", F.md5("text"))
    return stage(rows.dropDuplicates(["hash", "toxic"]).select("text", "toxic"), "labelled")


def count_terms(rows: DataFrame) -> DataFrame:
    """term, toxic, clean: the numbers of texts of either label that have a term; the empty term counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        known = Kept(terms_of)

        def hand_on() -> Iterator[pa.RecordBatch]:
            terms = list(counts[0].keys() | counts[1].keys())
            for low in range(0, len(terms), 50_000):
                part = terms[low:low + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), *(pa.array([counts[k][t] for t in part], pa.int64()) for k in (1, 0))],
                    names=["term", "toxic", "clean"])
            counts[0].clear()
            counts[1].clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                distinct = {word for words in pieces(text.lower().encode("utf-8", "replace"), TABLE) for word in words}
                counts[toxic].update(set(chain.from_iterable(map(known.__getitem__, distinct))))
                counts[toxic][""] += 1
                if len(counts[0]) + len(counts[1]) > HELD_TERMS:
                    yield from hand_on()
        yield from hand_on()

    found = rows.mapInArrow(run, "term string, toxic bigint, clean bigint")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(toxic: Column, clean: Column, both: Column, n_toxic: int, n_clean: int) -> Column:
    """Log-odds with a Dirichlet prior, less some standard deviations; 0 without a toxic text."""
    mass = PRIOR * (n_toxic + n_clean)
    prior = both * PRIOR
    odds = F.log((toxic + prior) / (n_toxic + mass - toxic - prior)) - F.log((clean + prior) / (n_clean + mass - clean - prior))
    sure = odds - Z * F.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return F.when((toxic > 0) & (sure >= LEAST), sure).otherwise(0.0)


def scan(rows: DataFrame, text_at: int, scorers) -> DataFrame:
    """Adds the number of words and all maximal segments. ``scorers`` makes, once a task, the scorer of a row by its other columns."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = scorers()
        for batch in batches:
            n_words, found = [], []
            for at, text in enumerate(batch.column(text_at).to_pylist()):
                n, own = hits(text or "", choose(batch, at))
                n_words.append(n)
                found.append([{"score": s, "start": a, "end": b} for s, a, b in spans(text, segments(own))])
            kind = pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(found, kind)], names=[*names, "n_words", "segments"])

    added = T.StructType.fromDDL("n_words bigint, segments array<struct<score: double, start: bigint, end: bigint>>")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


def fit_curve(cells: list[tuple[float, float, int, int]]) -> tuple[float, float, float]:
    """Logistic regression of labels on both evidences, by Newton steps over counted cells."""
    best, total, toxic, n = (np.array(c, float) for c in zip(*cells, strict=True))
    x = np.stack([np.ones(len(best)), best, total], axis=1)
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - n * p) - 1e-3 * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic",
    sample: int = SAMPLE, broadcast_terms: int = BROADCAST_TERMS,
) -> Model:
    """A model from the labelled ones of these documents."""
    rows = labelled_texts(docs, labels, id_col, text_col, label_id, label_col, sample)
    counts = stage(count_terms(rows).where(f"toxic >= {LEAST_TOXIC} OR term = ''"), "terms")
    texts = counts.where("term = ''").head()
    if texts is None or not texts["toxic"] or not texts["clean"]:
        return Model()
    n = (int(texts["toxic"]), int(texts["clean"]))
    both = (F.col("toxic") + F.col("clean")).cast("double")
    known = counts.where("term <> ''").select("term", *[
        log_odds(F.greatest(F.col("toxic") - a, F.lit(0)).cast("double"), F.greatest(F.col("clean") - b, F.lit(0)).cast("double"), both, *n).alias(name)
        for name, a, b in (("score", 0, 0), ("less_clean", 0, 1), ("less_toxic", 1, 0))])
    known = stage(known.where("greatest(score, less_clean, less_toxic) > 0"), "known")

    if known.count() <= broadcast_terms:
        ways = {name: {r["term"]: r["s"] for r in known.where(F.col(name) > 0).select("term", F.col(name).alias("s")).collect()}
                for name in ("score", "less_clean", "less_toxic")}
        model = Model(ways["score"])

        def scorers():
            own = [scorer(ways["less_clean"]), scorer(ways["less_toxic"])]
            return lambda batch, at: own[batch.column(1)[at].as_py()]

        found = scan(rows, 0, scorers)
    else:
        model = Model(table=known)
        parts = [scan_joined(rows.where(F.col("toxic") == k), 0, known.select("term", F.col(c).alias("score"))) for k, c in ((0, "less_clean"), (1, "less_toxic"))]
        found = parts[0].unionByName(parts[1])
    found = stage(found.select("toxic", "n_words", F.col("segments.score").alias("scores")), "segments")

    clean = found.where("toxic = 0")
    of_clean = clean.agg(
        F.sum(F.size("scores")).alias("k"), F.sum(F.aggregate("scores", F.lit(0.0), lambda a, s: a + s)).alias("s"), F.sum("n_words").alias("n")).head()
    decay = ((of_clean["k"] or 0) + 1) / ((of_clean["s"] or 0) + 1)
    rate = ((of_clean["k"] or 0) + 1) / ((of_clean["n"] or 0) + 1)
    seen = weighed(found, decay, rate)
    cells = seen.groupBy(*[(F.round(F.least(c, F.lit(most)) / CELL) * CELL).alias(c) for c, most in (("best", MOST_BEST), ("total", MOST_SUM))]).agg(
        F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    curve = fit_curve([tuple(r) for r in cells.collect()])  # at most 201 x 601 cells
    return Model(model.terms, model.table, decay, rate, curve)


def weighed(found: DataFrame, decay: float, rate: float) -> DataFrame:
    """Adds the evidence of the best segment and of all, from the columns n_words and scores, and of each."""
    def one(score: Column) -> Column:
        expected = rate * F.greatest("n_words", F.lit(1)) * F.exp(-decay * score)
        return -F.log(F.greatest(-F.expm1(-expected), F.lit(1e-300)))

    found = found.withColumn("each", F.transform("scores", one))
    return found.withColumn("best", F.coalesce(F.array_max("each"), F.lit(0.0))).withColumn(
        "total", F.aggregate("each", F.lit(0.0), lambda a, e: a + e))


def scan_joined(rows: DataFrame, text_at: int, terms: DataFrame) -> DataFrame:
    """As ``scan``, where the terms are too many for one dictionary: words and terms are joined by a shuffle, and each row
    gets the scores of its own words."""
    rows = stage(rows.withColumn("_row", F.expr("uuid()")), "rows")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                distinct = {word for some in pieces((text or "").lower().encode("utf-8", "replace"), TABLE) for word in some}
                pairs = [(w, t) for w in distinct for t in terms_of(w)]
                for low in range(0, len(pairs), 20_000):
                    part = pairs[low:low + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(part)), pa.array([p[0].decode() for p in part], pa.string()), pa.array([p[1] for p in part], pa.string())],
                        names=["_row", "word", "term"])

    found = rows.select(rows.columns[text_at], "_row").mapInArrow(words, "_row string, word string, term string")
    found = found.join(terms.where("score > 0").hint("merge"), "term").groupBy("_row", "word").agg(F.max("score").alias("score"))
    found = found.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "score"))).alias("_scores"))
    rows = rows.join(found, "_row", "left").drop("_row")

    def scorers():
        def of_row(batch: pa.RecordBatch, at: int) -> Callable[[list[bytes]], list[float]]:
            known = {w.encode(): s for w, s in batch.column(batch.num_columns - 1)[at].as_py() or ()}
            return lambda words: [known.get(w, 0.0) for w in words]

        return of_row

    return scan(rows, text_at, scorers).drop("_scores")


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, significant: float = SIGNIFICANT) -> DataFrame:
    """All columns of the table, and score, predicted, and segments: the significant passages with their score, evidence, and start and end in
    the text (in characters)."""
    kept = docs.drop("score", "predicted", "segments", "n_words", "scores", "each", "best", "total", "_row", "_scores")
    names, at = kept.columns, kept.columns.index(text_col)
    if model.table is None:
        terms = model.terms

        def scorers():
            own = scorer(terms)
            return lambda batch, row: own

        found = scan(kept, at, scorers)
    else:
        found = scan_joined(kept, at, model.table.select("term", "score"))
    found = weighed(found.withColumn("scores", F.col("segments.score")), model.decay, model.rate)
    passages = F.filter(
        F.zip_with("segments", "each", lambda s, e: F.struct(s["score"].alias("score"), e.alias("evidence"), s["start"].alias("start"), s["end"].alias("end"))),
        lambda s: s["evidence"] >= -math.log(significant))
    toxic = F.lit(0.0)
    if model.curve is not None:
        w = model.curve
        x = w[0] + w[1] * F.least("best", F.lit(MOST_BEST)) + w[2] * F.least("total", F.lit(MOST_SUM))
        toxic = 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(50.0)), F.lit(-50.0))))
    found = found.select(*names, toxic.alias("score"), passages.alias("segments"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select(*names, "score", "predicted", "segments")
