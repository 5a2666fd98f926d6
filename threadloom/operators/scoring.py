"""Labels for texts: a native lexicon model, and pluggable Python models on Arrow batches.

A text model is a callable ``list[str] -> list[tuple[label, score]]``; a pair
model is ``(list[str], list[str]) -> list[dict[label, score]]``. Factories are
called once per Python worker task, so that a model is loaded once and then
sees every batch of the task."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.labelling import Labeller
from threadloom.catalogue import SENTIMENT_LEXICON, STANCE_LEXICON, Lexicon

LABELS = ("positive", "negative", "neutral")
STANCES = ("agreement", "disagreement", "neutral")
SCORED = "struct<label string, score float>"


def lexicon_pattern(words: Sequence[str], whole_words: bool) -> str:
    alternatives = "|".join(map(re.escape, words))
    if not whole_words:
        return alternatives
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{alternatives})(?![\p{{L}}\p{{N}}_])"


def _hits(folded: Column, words: Sequence[str], whole_words: bool) -> Column:
    count = F.regexp_count(folded, F.lit(lexicon_pattern(words, whole_words)))
    if not whole_words:
        return count
    # Whole words are rare: a substring test spares most texts the pattern.
    present = reduce(lambda a, b: a | b, [F.contains(folded, F.lit(w)) for w in words])
    return F.when(present, count).otherwise(F.lit(0))


def _count_hits(df: DataFrame, text_col: str, lexicon: Lexicon) -> DataFrame:
    """Adds ``_pos`` and ``_neg``. Columns of their own, so that each pattern runs
    once per text however often the counts are used."""
    folded = df.withColumn("_folded", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    return folded.withColumns({
        "_pos": _hits(F.col("_folded"), lexicon.positive, lexicon.whole_words),
        "_neg": _hits(F.col("_folded"), lexicon.negative, lexicon.whole_words),
    }).drop("_folded")


def with_lexicon_sentiment(df: DataFrame, text_col: str, lexicon: Lexicon = SENTIMENT_LEXICON) -> DataFrame:
    """Adds ``sentiment_label`` and ``sentiment_score``: the side with more hits,
    and its share of all hits (1 without hits)."""
    pos, neg = F.col("_pos"), F.col("_neg")
    label = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
    score = F.when(pos + neg > 0, F.greatest(pos, neg) / (pos + neg)).otherwise(F.lit(1.0))
    return _count_hits(df, text_col, lexicon).withColumns(
        {"sentiment_label": label, "sentiment_score": score.cast("float")}
    ).drop("_pos", "_neg")


def lexicon_text_model(lexicon: Lexicon = SENTIMENT_LEXICON) -> Callable[[], Callable]:
    """The lexicon as a Python text model; agrees with ``with_lexicon_sentiment``."""

    def load():
        edge = r"[^\W]"
        wrap = rf"(?<!{edge})(?:%s)(?!{edge})" if lexicon.whole_words else "(?:%s)"
        pos = re.compile(wrap % "|".join(map(re.escape, lexicon.positive)))
        neg = re.compile(wrap % "|".join(map(re.escape, lexicon.negative)))

        def predict(texts: list[str]) -> list[tuple[str, float]]:
            out = []
            for t in texts:
                t = (t or "").lower()
                p, n = len(pos.findall(t)), len(neg.findall(t))
                label = "positive" if p > n else "negative" if n > p else "neutral"
                out.append((label, max(p, n) / (p + n) if p + n else 1.0))
            return out

        return predict

    return load


def text_model_udf(load: Callable[[], Callable]):
    @F.pandas_udf(SCORED)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load()
        for texts in batches:
            yield pd.DataFrame(predict(texts.tolist()), columns=["label", "score"])

    return score


def score_text(
    df: DataFrame, text_col: str = "text", load: Callable[[], Callable] | None = None,
    lexicon: Lexicon = SENTIMENT_LEXICON, labeller: Labeller | None = None,
) -> DataFrame:
    """Adds ``sentiment_label`` and ``sentiment_score``; the model runs once per row. A trained ``labeller`` goes before
    a plugged-in model, and that before the lexicon."""
    if labeller is not None:
        return labeller.label(df, text_col)
    if load is None:
        return with_lexicon_sentiment(df, text_col, lexicon)
    return df.withColumn("_s", text_model_udf(load)(F.col(text_col))).withColumns(
        {"sentiment_label": F.col("_s.label"), "sentiment_score": F.col("_s.score")}
    ).drop("_s")


def score_present_text(df: DataFrame, text_col: str = "text", **model) -> DataFrame:
    """As ``score_text``, but blank texts get NULL label and score and never reach the model."""
    present = F.when(F.trim(F.col(text_col)) != "", F.col(text_col))
    scored = score_text(df.withColumn("_present", present), "_present", **model)
    keep = F.col("_present").isNotNull()
    return scored.withColumns({
        c: F.when(keep, F.col(c)) for c in ("sentiment_label", "sentiment_score")
    }).drop("_present")


def _number(texts: Sequence[str], max_chars: int | None) -> str:
    return "\n".join(f"{i}. {(t or '')[:max_chars]}" for i, t in enumerate(texts))


def _read_labels(answer: str, n: int) -> list[str]:
    """Labels by index from the JSON array inside an answer; anything unusable stays neutral."""
    labels = ["neutral"] * n
    found = re.search(r"\[.*\]", answer, re.DOTALL)
    for item in json.loads(found.group()) if found else []:
        index, label = item.get("index"), item.get("label", "neutral")
        if isinstance(index, int) and 0 <= index < n and label in LABELS:
            labels[index] = label
    return labels


def label_with_answerer(
    df: DataFrame, answer: Callable[[str], str], text_col: str = "text", batch: int = 64,
    max_chars: int | None = None, flag_failures: bool = False,
) -> DataFrame:
    """Labels from an external answerer that gets numbered texts and returns
    ``[{"index", "label"}]``. Texts go out in batches of ``batch``, in parallel
    over partitions; a failed call leaves its batch neutral with score 1.0
    (``flag_failures`` adds ``scored`` = false for them). Texts are sent whole
    unless ``max_chars`` is given. Only the text column crosses to Python."""

    def ask(texts: list[str]) -> list[tuple[str, float, bool]]:
        try:
            return [(label, 1.0, True) for label in _read_labels(answer(_number(texts, max_chars)), len(texts))]
        except Exception:  # the answerer is foreign code; its failures are data here
            return [("neutral", 1.0, False)] * len(texts)

    @F.pandas_udf("struct<label string, score float, scored boolean>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = series.fillna("").tolist()
            rows = [r for i in range(0, len(texts), batch) for r in ask(texts[i:i + batch])]
            yield pd.DataFrame(rows, columns=["label", "score", "scored"])

    labelled = df.withColumn("_s", label.asNondeterministic()(F.col(text_col))).withColumns(
        {"sentiment_label": F.col("_s.label"), "sentiment_score": F.col("_s.score")}
    )
    if flag_failures:
        labelled = labelled.withColumn("scored", F.col("_s.scored"))
    return labelled.drop("_s")


def with_lexicon_stance(
    df: DataFrame, reply: str, parent: str, name: str = "stance_label", lexicon: Lexicon = STANCE_LEXICON
) -> DataFrame:
    """Stance of a reply towards its parent: the first best of agreement,
    disagreement and neutral (which scores half a hit). Without a parent text: neutral."""
    agree, disagree = F.col("_pos"), F.col("_neg")
    has_parent = F.trim(F.coalesce(F.col(parent), F.lit(""))) != ""
    label = (
        F.when(has_parent & (agree > 0) & (agree >= disagree), "agreement")
        .when(has_parent & (disagree > 0), "disagreement")
        .otherwise("neutral")
    )
    return _count_hits(df, reply, lexicon).withColumn(name, label).drop("_pos", "_neg")


def pair_model_udf(load: Callable[[], Callable]):
    """Label with the highest score; the first of ``STANCES`` on ties."""

    @F.pandas_udf("string")
    def label(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for replies, parents in batches:
            scores = predict(replies.fillna("").tolist(), parents.fillna("").tolist())
            yield pd.Series([max(STANCES, key=lambda s, row=row: row.get(s, 0.0)) for row in scores])

    return label


def lexicon_pair_model(lexicon: Lexicon = STANCE_LEXICON) -> Callable[[], Callable]:
    """The stance lexicon as a Python pair model; agrees with ``with_lexicon_stance``."""

    def load():
        edge = r"[^\W]"
        wrap = rf"(?<!{edge})(?:%s)(?!{edge})" if lexicon.whole_words else "(?:%s)"
        yes = re.compile(wrap % "|".join(map(re.escape, lexicon.positive)))
        no = re.compile(wrap % "|".join(map(re.escape, lexicon.negative)))

        def predict(replies: list[str], parents: list[str]) -> list[dict[str, float]]:
            out = []
            for reply, parent in zip(replies, parents):
                known = 1.0 if parent.strip() else 0.0
                out.append({
                    "agreement": known * len(yes.findall(reply.lower())),
                    "disagreement": known * len(no.findall(reply.lower())),
                    "neutral": 0.5,
                })
            return out

        return predict

    return load


def score_stance(
    df: DataFrame, reply: str, parent: str, name: str = "stance_label", load: Callable[[], Callable] | None = None,
    lexicon: Lexicon = STANCE_LEXICON,
) -> DataFrame:
    """Adds the stance of one text column towards another."""
    if load is None:
        return with_lexicon_stance(df, reply, parent, name, lexicon)
    return df.withColumn(name, pair_model_udf(load)(F.col(reply), F.col(parent)))
