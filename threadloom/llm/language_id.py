"""Language identification with hyperdimensional profiles.

Each letter has a random vector of -1 and 1, drawn from its code point alone. An n-gram binds its
letters: their vectors, each rolled by its place, are multiplied. A text bundles its n-grams: their
vectors are added, as often as they occur. A language's prototype bundles the texts known to be of
it, each brought to about unit length, and a text gets the language whose prototype has the greatest cosine.

Learning keeps, per task, one vector a language and merges them on the cluster by language and
place; what reaches the driver is languages x dimensions numbers. Languages are a closed set:
beyond ``MAX_LANGUAGES`` the labels are taken to be something else and an error is raised.

Defined cases: a null text, or one without a letter, is "und" with score 0; so is every text if
nothing was learned. Ties go to the language that comes first by name. Repeated rows are predicted
each; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import once_per_worker, pick

DIMENSIONS = 1024
ORDER = 3
MAX_LANGUAGES = 1000
UNKNOWN = "und"
# N-gram vectors kept by a worker (32 MB), and used at once (16 MB).
KEPT_GRAMS = 32_768
GRAMS = 4096
# Letters go 21 bits each into one 64-bit integer, so an n-gram has at most three.
BITS = 21
# Texts bundled together.
TEXTS = 128


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """Random signs of a code point; 0 stands for everything that is no letter."""
    return np.random.default_rng([code, dimensions]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


class Profiler:
    """Bundles of texts."""

    def __init__(self, dimensions: int, order: int):
        if not 1 <= order <= 3:
            raise ValueError("n-grams have one to three letters")
        self.dimensions, self.order = dimensions, order
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((0, dimensions), np.int8)
        self.is_letter = np.zeros(0, np.int8)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a text and their counts. Runs of other signs count as one gap."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        codes = np.where(self._letter_mask(codes), codes, 0)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        if not codes.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.concatenate((np.zeros(int(codes[0] != 0), np.int64), codes, np.zeros(int(codes[-1] != 0), np.int64)))
        alphabet, small = np.unique(codes, return_inverse=True)
        size, places = len(alphabet), len(codes) - self.order + 1
        if places <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.zeros(places, np.int64)
        for i in range(self.order):
            key = key * size + small[i:i + places]
        if size ** self.order <= 8 * places + 4096:
            counts = np.bincount(key)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(key, return_counts=True)
        gram = np.zeros(len(found), np.int64)
        for i in range(self.order):
            gram |= alphabet[found // size ** (self.order - 1 - i) % size] << (BITS * i)
        return gram, counts

    def _letter_mask(self, codes: np.ndarray) -> np.ndarray:
        top = int(codes.max(initial=0)) + 1
        if top > len(self.is_letter):
            more = [chr(c).isalpha() for c in range(len(self.is_letter), top)]
            self.is_letter = np.concatenate((self.is_letter, np.array(more, np.int8)))
        return self.is_letter[codes] > 0

    def counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of some texts; and of each count its text, its n-gram, itself."""
        found = [self.grams(t) for t in texts]
        grams, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, _ in found)]), return_inverse=True)
        text = np.repeat(np.arange(len(texts)), [len(g) for g, _ in found])
        return grams, text, at, np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)]).astype(np.float32)

    def weighted(self, grams: np.ndarray, row: np.ndarray, at: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """For each row the sum of its n-grams' vectors, times their weights."""
        out = np.zeros((rows, self.dimensions), np.float32)
        for low in range(0, len(grams), GRAMS):
            mine = (at >= low) & (at < low + GRAMS)
            part = grams[low:low + GRAMS]
            matrix = np.zeros((rows, len(part)), np.float32)
            np.add.at(matrix, (row[mine], at[mine] - low), weight[mine])
            held = self._rows(part)
            out += matrix @ self.table[held].astype(np.float32)
        return out

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of sums for each text, and whether it has a letter at all."""
        grams, text, at, count = self.counted(texts)
        known = np.zeros(len(texts), bool)
        known[text] = True
        return self.weighted(grams, text, at, count, len(texts)), known

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the table that hold the vectors of these n-grams."""
        grams = grams.tolist()
        new = [g for g in grams if g not in self.rows]
        if len(self.rows) + len(new) > KEPT_GRAMS:
            self.rows, self.table, new = {}, self.table[:0], grams
        if new:
            made = np.stack([self._bind(g) for g in new]).astype(np.int8)
            self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate((self.table, made))
        return np.fromiter((self.rows[g] for g in grams), np.int64, len(grams))

    def _bind(self, gram: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for i in range(self.order):
            code = (gram >> (BITS * i)) & ((1 << BITS) - 1)
            if code not in self.letters:
                self.letters[code] = letter_vector(code, self.dimensions)
            out = out * np.roll(self.letters[code], i)
        return out


def profiler(dimensions: int, order: int) -> Profiler:
    return once_per_worker(f"profiler {dimensions} {order}", lambda: Profiler(dimensions, order), alone=True)


def learn(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, order: int = ORDER
) -> dict[str, np.ndarray]:
    """Unit prototypes by language from all rows whose text and language are not null."""
    rows = pick(labelled, text=text_col, lang=lang_col).where("text IS NOT NULL AND lang IS NOT NULL")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = profiler(dimensions, order), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for low in range(0, len(langs), TEXTS):
                names, lang = np.unique(np.array(langs[low:low + TEXTS], object).astype(str), return_inverse=True)
                grams, text, at, count = own.counted(batch.column(0).slice(low, TEXTS).to_pylist())
                # N-gram vectors are all but orthogonal, so counts tell the length of a bundle.
                length = np.sqrt(np.bincount(text, count ** 2, minlength=len(lang)) * dimensions)
                sizes = own.weighted(grams, lang[text], at, (count / length[text]).astype(np.float32), len(names))
                for name, total in zip(names.tolist(), sizes.astype(np.float64), strict=True):
                    sums[name] = sums.get(name, 0) + total
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))],
            names=["lang", "sums"])

    parts = rows.mapInArrow(bundle, "lang string, sums array<double>")
    totals = parts.select("lang", F.posexplode("sums").alias("place", "part")).groupBy("lang", "place").agg(
        F.sum("part").alias("total"))
    vectors = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("v"))
    found = vectors.select("lang", F.col("v.total").alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for row in found:
        vector = np.array(row["v"])
        if (size := np.linalg.norm(vector)) > 0:
            out[row["lang"]] = (vector / size).astype(np.float32)
    return out


def predict(
    docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
    dimensions: int = DIMENSIONS, order: int = ORDER,
) -> DataFrame:
    """All columns of the table, with lang_pred and score (the cosine, 0 if negative) added. Columns
    of these names that the table has already are replaced."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, dimensions), np.float32)
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = profiler(dimensions, order)
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                vectors, known = own.bundles([t or "" for t in part.column(at).to_pylist()])
                best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                if names:
                    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
                    cosines = vectors @ matrix.T
                    best = cosines.argmax(axis=1)
                    score = np.clip(cosines[np.arange(len(best)), best].astype(float), 0, 1)
                sure = known & bool(names)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([names[b] if s else UNKNOWN for b, s in zip(best, sure, strict=True)], pa.string()),
                     pa.array(np.where(sure, score, 0.0))],
                    names=[*part.schema.names, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return kept.mapInArrow(label, T.StructType([*kept.schema.fields, *added]))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a row is kept from learning: a fold by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(False))
