"""A text labeller trained on the cluster: hashed words and word pairs into a multinomial logistic regression.

Everything runs in Spark ML: counting, fitting (one pass over the hashed terms for each step, sums combined as a tree) and
labelling. Rare labels weigh more, so that each label counts alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.sources.writers import remove_staged, stage

FEATURES = 1 << 18
MAX_LABELS = 1000


def words_and_pairs(text: Column) -> Column:
    """Runs of letters in lower case, and each two in a row."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


@dataclass(frozen=True)
class Labeller:
    """A fitted model. Without words a text gets the label that is most likely without any."""

    model: PipelineModel

    @property
    def labels(self) -> list[str]:
        return list(self.model.stages[0].labels)

    def label(self, df: DataFrame, text_col: str = "text", label: str = "sentiment_label", score: str = "sentiment_score") -> DataFrame:
        """Adds the likeliest label and its probability."""
        kept = [c for c in df.columns if c not in (label, score)]
        rows = df.select(F.struct(*kept).alias("_row"), words_and_pairs(F.col(text_col)).alias("_terms"))
        found = self.model.transform(rows).select("_row.*", vector_to_array("_chances").alias("_p"))
        best = F.array_position("_p", F.array_max("_p"))
        names = F.array(*[F.lit(n) for n in self.labels])
        return found.withColumns({
            label: F.element_at(names, best.cast("int")), score: F.array_max("_p").cast("float")}).drop("_p")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def load(path: str) -> Labeller:
    return Labeller(PipelineModel.load(path))


def train(
    df: DataFrame, text_col: str = "text", label_col: str = "label", features: int = FEATURES, least_texts: int = 2,
    regularisation: float = 0.01, rounds: int = 60,
) -> Labeller:
    """Fits a labeller on all rows that have a label. Terms of fewer than ``least_texts`` texts count for nothing.

    Texts are cut into words and hashed once; each step of the fit reads the hashed terms, staged in the shared folder."""
    hashing = HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=features, binary=True)
    terms = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("_label"), words_and_pairs(F.col(text_col)).alias("_terms"))
    staged = stage(df.sparkSession, hashing.transform(terms).select("_label", "_counts"))
    try:
        return Labeller(_fit(staged, hashing, least_texts, regularisation, rounds))
    finally:
        remove_staged(df.sparkSession, staged)


def _fit(rows: DataFrame, hashing: HashingTF, least_texts: int, regularisation: float, rounds: int) -> PipelineModel:
    sizes = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().limit(MAX_LABELS + 1).collect()}
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if len(sizes) < 2:
        raise ValueError("a labeller needs texts of two labels at least")
    total = sum(sizes.values())
    weights = F.create_map(*[F.lit(v) for name, n in sizes.items() for v in (name, total / (len(sizes) * n))])
    rows = rows.withColumn("_weight", F.element_at(weights, F.col("_label")))
    indexer, idf, regression = Pipeline(stages=[
        StringIndexer(inputCol="_label", outputCol="_target", stringOrderType="alphabetAsc"),
        IDF(inputCol="_counts", outputCol="_features", minDocFreq=least_texts),
        LogisticRegression(
            featuresCol="_features", labelCol="_target", weightCol="_weight", probabilityCol="_chances", predictionCol="_best",
            rawPredictionCol="_raw", family="multinomial", maxIter=rounds, regParam=regularisation, standardization=False, aggregationDepth=3),
    ]).fit(rows).stages
    return PipelineModel(stages=[indexer, hashing, idf, regression])
