"""Scores, flags and ratios as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.moments import moment

# Weights of the post engagement score.
LIKE_WEIGHT, REPOST_WEIGHT, REPLY_WEIGHT, QUOTE_WEIGHT = 1.0, 2.0, 1.5, 2.0
ACTIVITY_SHARE, REACH_SHARE, VERIFIED_BOOST = 0.5, 0.3, 1.2
VIRAL_THRESHOLD = 1000
BOT_STATUSES, BOT_FOLLOWERS = 50_000, 500
BURST_COMMENTS = 20


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def post_engagement(as_of=None) -> Column:
    """Log-scaled activity and reach, divided by the logarithm of the post's age."""
    activity = (
        _or_zero("likeCount") * F.lit(LIKE_WEIGHT)
        + _or_zero("retweetCount") * F.lit(REPOST_WEIGHT)
        + _or_zero("replyCount") * F.lit(REPLY_WEIGHT)
        + _or_zero("quoteCount") * F.lit(QUOTE_WEIGHT)
    )
    boost = F.when(F.col("author_is_blue_verified"), F.lit(VERIFIED_BOOST)).otherwise(F.lit(1.0))
    reach = F.log10(_or_zero("author_followers") + F.lit(1)) * boost
    seconds = F.unix_timestamp(moment(as_of)) - F.unix_timestamp(F.col("created_at_ts"))
    age = F.greatest(seconds / F.lit(3600.0), F.lit(0.0))
    return (F.log(activity + F.lit(1.0)) * ACTIVITY_SHARE + reach * REACH_SHARE) / F.log(age + F.lit(math.e))


def comment_engagement() -> Column:
    """Reactions times ln 2 for a root, ln 3 for a reply."""
    depth = F.when(F.col("is_reply"), F.lit(3.0)).otherwise(F.lit(2.0))
    return _or_zero("reaction_count").cast("float") * F.log(depth)


def influence_ratio() -> Column:
    return F.when(F.col("author_following") > 0, F.col("author_followers") / F.col("author_following"))


def looks_automated() -> Column:
    """Very active account with hardly any followers; NULL when either number is unknown."""
    return (F.col("author_statuses_count") > BOT_STATUSES) & (F.col("author_followers") < BOT_FOLLOWERS)


def ratio(part: Column, total: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(part, total), digits)


def percent(part: Column, total: Column) -> Column:
    """Whole percent for display, 0 when there is no total. Ties round up."""
    share = F.try_divide(part * F.lit(100.0), total)
    return F.coalesce(F.floor(share + F.lit(0.5)), F.lit(0)).cast("long")


def intensity_rank(col: Column, otherwise: int = 1) -> Column:
    return (
        F.when(col == "strong", F.lit(3))
        .when(col == "moderate", F.lit(2))
        .when(col == "mild", F.lit(1))
        .otherwise(F.lit(otherwise))
    )
