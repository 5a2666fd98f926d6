"""Named checks over a table in one pass, reports, and the drop funnel."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threadloom.functions.moments import parse_legacy_timestamp
from threadloom.operators.posts import COUNTS, CRITICAL

log = logging.getLogger(__name__)
SAMPLE_ROWS = 5


class QualityError(ValueError):
    """A check failed; the message names it."""


@dataclass(frozen=True)
class Check:
    """``failing`` marks bad rows. ``max_share`` is the tolerated share; ``warn`` never raises."""

    name: str
    failing: Column
    warn: bool = False
    max_share: float = 0.0


def any_null(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])


def any_negative(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n) < 0 for n in names])


def outside(name: str, low: int, high: int | None = None) -> Column:
    bad = F.col(name).isNull() | (F.col(name) < low)
    return bad if high is None else bad | (F.col(name) > high)


def _counters(checks: Sequence[Check]) -> list[Column]:
    """All rows, and the failing rows of each check."""
    return [F.count(F.lit(1)).alias("total"), *[
        F.count_if(F.coalesce(c.failing, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks)]]


def report(df: DataFrame, checks: Sequence[Check], unique: str | None = None) -> DataFrame:
    """One row per check: failing rows, rows, and status (ok, warn, fail). All
    checks share one pass; ``unique`` adds a duplicate-key check to it."""
    total, *counters = _counters(checks)
    if unique is not None:
        counters.append((F.count("*") - F.count_distinct(unique) - F.count_if(F.col(unique).isNull())).alias("dup"))
    counts = df.agg(total, *counters)
    rows = [
        F.struct(
            F.lit(c.name).alias("check"), F.col(f"c{i}").alias("failing"), F.col("total").alias("rows"),
            F.when(F.col(f"c{i}") <= F.col("total") * F.lit(c.max_share), "ok")
            .otherwise("warn" if c.warn else "fail").alias("status"),
        )
        for i, c in enumerate(checks)
    ]
    if unique is not None:
        rows.append(F.struct(
            F.lit(f"duplicate_{unique}").alias("check"), F.col("dup").alias("failing"), F.col("total").alias("rows"),
            F.when(F.col("dup") == 0, "ok").otherwise("fail").alias("status"),
        ))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def failing_sample(df: DataFrame, check: Check, n: int = SAMPLE_ROWS) -> DataFrame:
    return df.where(check.failing).limit(n)


def enforce(df: DataFrame, checks: Sequence[Check], unique: str | None = None) -> None:
    """Raises on the first failed check after logging a few of its rows. The
    report has one row per check, so only those reach the driver."""
    _judge(df, checks, report(df, checks, unique).collect())


def _judge(df: DataFrame, checks: Sequence[Check], rows: Sequence) -> None:
    by_name = {c.name: c for c in checks}
    for row in rows:
        if row["status"] == "ok":
            continue
        message = f"[{row['check']}] {row['failing']} of {row['rows']} rows failed"
        if row["status"] == "warn":
            log.warning(message)
            continue
        if row["check"] in by_name:
            for sample in failing_sample(df, by_name[row["check"]]).collect():
                log.error("%s: %s", row["check"], sample.asDict())
        raise QualityError(message)


@dataclass(frozen=True)
class Enforced:
    """Checks that a table must pass. Called with a table it reads and judges it; ``observed`` counts while the table is
    being written, so that it need not be read again."""

    checks: tuple[Check, ...]
    unique: str | None = None
    earlier: Callable[[], None] | None = None  # judges what the same write has counted further up in its plan

    def __call__(self, df: DataFrame) -> None:
        if self.earlier is not None:
            self.earlier()
        enforce(df, self.checks, self.unique)

    def observed(self, df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], None]]:
        """The table with its counters attached, and what judges them once it has been written. Only the key column of
        what was written is read for a check of repeated keys, and rows only to show some that failed."""
        seen = Observation()
        watched = df.observe(seen, *_counters(self.checks))

        def judge(written: DataFrame) -> None:
            if self.earlier is not None:
                self.earlier()
            counts = seen.get
            total = counts["total"] or 0
            rows = []
            for i, c in enumerate(self.checks):
                failing = counts[f"c{i}"] or 0
                status = "ok" if failing <= total * c.max_share else "warn" if c.warn else "fail"
                rows.append({"check": c.name, "failing": failing, "rows": total, "status": status})
            _judge(written, self.checks, rows)
            if self.unique is not None:
                enforce(written.select(self.unique), (), self.unique)

        return watched, judge


def enforcing(checks: Sequence[Check], unique: str | None = None, earlier: Callable[[], None] | None = None) -> Enforced:
    return Enforced(tuple(checks), unique, earlier)


def post_checks() -> list[Check]:
    return [
        Check("null_critical_fields", any_null(*CRITICAL)),
        Check("negative_engagement", any_negative(*COUNTS)),
        Check("invalid_numeric_features",
              any_negative("hashtag_count", "mention_count") | outside("tweet_hour", 0)
              | outside("tweet_day_of_week", 1) | outside("year", 1) | outside("month", 1) | outside("day", 1)),
    ]


def video_comment_checks() -> list[Check]:
    return [
        Check("null_critical_fields", any_null("comment_id", "text", "published_at")),
        Check("negative_likes", F.col("likes") < 0),
        Check("invalid_temporal_features",
              outside("comment_hour", 0, 23) | outside("comment_day_of_week", 1, 7) | outside("year", 1)
              | outside("month", 1, 12) | outside("day", 1, 31)),
    ]


def analytics_checks() -> list[Check]:
    return [
        Check("invalid_engagement_score", outside("engagement_score", 0)),
        Check("null_is_bot", F.col("is_bot").isNull()),
        Check("brand_coverage", F.col("primary_brand") == "Unknown", warn=True, max_share=0.5),
    ]


def fact_post_checks() -> list[Check]:
    return [
        Check("fact_tweets_null_keys", any_null("tweet_id", "author_id", "created_at_ts")),
        Check("fact_tweets_null_sentiment", F.col("sentiment_label").isNull()),
    ]


def dim_author_checks() -> list[Check]:
    return [Check("dim_authors_null_keys", F.col("author_id").isNull())]


def brand_daily_checks() -> list[Check]:
    return [
        Check("agg_brand_daily_null_keys", any_null("date", "brand_name", "lang")),
        Check("agg_brand_daily_invalid_mentions", outside("total_mentions", 1)),
        Check("agg_brand_daily_invalid_sov", (F.col("share_of_voice") < 0) | (F.col("share_of_voice") > 1)),
    ]


def author_perf_checks() -> list[Check]:
    return [Check("agg_author_perf_null_keys", F.col("author_id").isNull())]


def silver_group_post_checks() -> list[Check]:
    return [Check("silver_posts", F.col("post_id").isNull())]


def silver_group_comment_checks() -> list[Check]:
    return [
        Check("silver_comments_null_comment_id", F.col("comment_id").isNull()),
        Check("silver_comments_null_post_id", F.col("post_id").isNull()),
    ]


def fact_comment_checks() -> list[Check]:
    return [
        Check("fact_comments_null_keys", F.col("comment_id").isNull()),
        Check("fact_comments_null_sentiment", F.col("sentiment_label").isNull()),
    ]


def page_daily_checks() -> list[Check]:
    return [
        Check("agg_page_daily_null_keys", any_null("date", "page_name")),
        Check("agg_page_daily_invalid_ratio", F.col("positive_ratio") > 1, warn=True),
    ]


def drop_funnel(flat: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows left and lost per cleaning step: dedup, critical fields, counts, timestamp.

    Unlike the cleaner, an empty critical field counts as missing and an
    unknown count as 0, as in the diagnosis this report serves."""
    complete = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in CRITICAL])
    valid = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(0)) >= 0 for c in COUNTS])
    dated = parse_legacy_timestamp(F.col("createdAt")).isNotNull()
    columns = [c for c in dict.fromkeys([*order, *CRITICAL, *COUNTS]) if c != "id"]
    per_id = flat.groupBy("id").agg(
        F.max(F.struct(*columns)).alias("row"), F.count("*").alias("copies")
    ).select("id", "row.*", "copies")
    has_id = F.coalesce("id", F.lit("")) != ""
    steps = {
        "after_dedup": has_id,
        "after_critical": has_id & complete,
        "after_engagement": has_id & complete & valid,
        "after_timestamp": has_id & complete & valid & dated,
    }
    counts = per_id.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total"), *[F.count_if(c).alias(n) for n, c in steps.items()]
    )
    names = ["total", *steps]
    lines = [
        F.struct(
            F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(n).alias("rows_left"),
            (F.col(names[max(i - 1, 0)]) - F.col(n)).alias("rows_lost"),
        )
        for i, n in enumerate(names)
    ]
    return counts.select(F.explode(F.array(*lines)).alias("s")).select("s.*")
