"""URL verdicts: written rules first, mined association rules for the rest.

Rules name a host and a path; a rule fits its host and all subdomains if the url's path starts with
the rule's, and the longest fitting rule wins. Urls that no rule fits are judged by combinations of
url tokens: FP-growth mines frequent token sets of labelled urls, and sets whose block confidence
is high enough become mined rules. An inverted index holds each mined rule under its rarest token,
so a url meets only the rules one of its own tokens points to.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule, has no
token and is allowed. Repeated rows are judged each; no labelled url means no mined rule, hence
allow. An empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fold_ascii, pick, stage, union

BLOCKED = "label:block"
# A mined index of at most this many rules is broadcast (some 200 bytes a rule); a larger one is joined.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """``where``: host and path as one string, such as "example.org/es/"."""

    verdict: str
    where: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.where.partition("/")[2]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (up to / ? # or the end, A-Z lower-cased) and path (up to ? # or the end)."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return fold_ascii(host), path


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens that say where they come from: host labels, path pieces, query keys."""
    def tagged(tag: str, pieces: Column) -> Column:
        return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.concat(F.lit(tag), p))

    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    return F.array_distinct(F.concat(
        tagged("host:", F.split(host, r"\.")), tagged("path:", F.split(fold_ascii(path), "[/.]")),
        tagged("query:", F.when(host != "", keys).otherwise(F.array().cast("array<string>"))),
    ))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls if none fits. Rules are written by hand and few."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.where), r.where)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.where).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Mined block rules: rule_id, need (sorted tokens, however many), confidence, first (the rarest token).

    ``labelled``: tokens, blocked. Labelled urls are grouped by equal token sets nowhere: FP-growth
    counts conditional trees on the cluster. Rules are pruned by support, by confidence, and where a
    subset of their tokens blocks with at least the same confidence."""
    items = labelled.select(F.when(
        F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    frequent = stage(model.freqItemsets, "itemsets")
    block = frequent.where(F.array_contains("items", BLOCKED)).select(
        F.array_sort(F.array_remove("items", BLOCKED)).alias("need"), F.col("freq").alias("bad"))
    every = frequent.where(~F.array_contains("items", BLOCKED)).select(F.array_sort("items").alias("need"), "freq")
    rules = block.where(F.size("need") >= 1).join(every, "need")
    rules = rules.withColumn("confidence", F.col("bad") / F.col("freq")).withColumn("rule_id", F.array_join("need", "\n"))
    rules = stage(rules.withColumn("size", F.size("need")), "rules")
    # All subsets of a frequent set are frequent. So the best confidence among a set's subsets is known from the sets with one token
    # less, size by size; there are no more sizes than a url has tokens.
    best = rules.where("size = 1").select("rule_id", F.col("confidence").alias("best"), F.lit(None).cast("double").alias("below"))
    levels = [best]
    for size in range(2, (rules.agg(F.max("size")).head()[0] or 0) + 1):
        less = rules.where(F.col("size") == size).select("rule_id", "confidence", F.posexplode("need").alias("at", "token"), "need")
        less = less.withColumn("sub", F.array_join(F.filter("need", lambda t, i: i != F.col("at")), "\n"))
        below = less.join(best.select(F.col("rule_id").alias("sub"), "best"), "sub").groupBy("rule_id", "confidence").agg(F.max("best").alias("below"))
        best = stage(below.select("rule_id", F.greatest("confidence", "below").alias("best"), "below"), "level")
        levels.append(best)
    rules = rules.where(F.col("confidence") >= min_confidence).join(union(levels), "rule_id")
    rules = rules.where("below IS NULL OR below < confidence").drop("best", "below", "size")
    single = every.where(F.size("need") == 1).select(F.col("need")[0].alias("token"), F.col("freq").alias("uses"))
    rarest = (
        rules.select("rule_id", F.explode("need").alias("token")).join(single, "token")
        .groupBy("rule_id").agg(F.min_by("token", F.struct("uses", "token")).alias("first"))
    )
    return stage(rules.join(rarest, "rule_id").select("rule_id", "need", "confidence", "first"), "index")


def judge_urls(
    pages: DataFrame, labels: DataFrame | None, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
    label_id: str = "page_id", label_blocked: str = "blocked", min_support: float = 0.002,
    min_confidence: float = 0.6,
) -> DataFrame:
    """Per url: id, host, path, rule, verdict, confidence (of the mined rule that blocked it).

    ``labels``: ids of urls with a boolean whether they should be blocked; null labels are left out."""
    rows = pick(pages, id=id_col, url=url_col)
    host, path = url_parts(F.col("url"))
    rows = rows.select("id", "url", host.alias("host"), path.alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(
        "id", "host", "path", name.alias("rule"), verdict.alias("ruled"),
        tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"), F.expr("uuid()").alias("row_id"),
    )
    rows = stage(rows, "urls")
    if labels is None:
        found = None
    else:
        known = pick(labels, id=label_id, blocked=label_blocked).where("blocked IS NOT NULL")
        index = mine(rows.join(known, "id").select("tokens", "blocked"), min_support, min_confidence)
        few = index.count() <= BROADCAST_RULES
        open_urls = rows.where("ruled IS NULL").select("row_id", "tokens", F.explode("tokens").alias("first"))
        met = open_urls.join(F.broadcast(index) if few else index, "first")
        met = met.where(F.size(F.array_except("need", "tokens")) == 0)
        found = met.groupBy("row_id").agg(F.max("confidence").alias("confidence"))
    rows = rows.drop("tokens")
    out = rows.withColumn("confidence", F.lit(None).cast("double")) if found is None else rows.join(
        found, "row_id", "left")
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("confidence").isNull(), "allow").otherwise("block")).alias("verdict"),
        "confidence",
    )
