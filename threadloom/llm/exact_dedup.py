"""Exact deduplication by content hash, DataFrame functions only.

Rows are grouped by a 128-bit hash of the normalised text; of each group one row stays. Hashes
move, texts do not, except that rows of groups with several members are grouped once more by
their bytes, so that a collision can never merge different texts.

Defined cases: a null text counts as empty, and all empty texts are equal. A null id counts as a
row but never as the one that stays, unless its group has no other (then ``keep_id`` is null).
Rows repeated with one id are each a member of their group; if theirs is the id that stays, all of
them are marked kept. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fold_ascii, pick, stage, union


HOT_SHARE = 1000


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = fold_ascii, digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep``: whether the row with the "smallest" or the "largest" id of a group stays."""
    chosen = {"smallest": F.min, "largest": F.max}[keep]("id").alias("keep_id")
    size = F.count(F.lit(1)).alias("group_size")
    rows = pick(docs, id=id_col, text=text_col)
    rows = rows.select("id", normalise(F.coalesce("text", F.lit(""))).alias("body"))
    rows = rows.select("id", "body", digest(F.col("body")).alias("hash"))
    keys = stage(rows.select("id", "hash", F.sha2("body", 256).alias("text_sha256")), "hashes")

    # Counts combine before the shuffle: a hot hash costs each task one row.
    several = stage(keys.groupBy("hash").agg(size, chosen).where("group_size > 1"), "groups")
    # Hashes of more than a thousandth of all rows are fewer than a thousand, so their list can be
    # broadcast: their rows are grouped right where they are read.
    hot = several.where(F.col("group_size") * HOT_SHARE > keys.count()).select("hash")
    members = rows.join(F.broadcast(hot), "hash", "left_semi")
    # The list of the other hashes grows with the corpus, so it is never broadcast, whatever its size.
    cold = rows.join(F.broadcast(hot), "hash", "left_anti")
    cold = cold.join(several.join(F.broadcast(hot), "hash", "left_anti").select("hash").hint("merge"), "hash", "left_semi")
    bodies = stage(
        union([members, cold]).groupBy("hash", "body").agg(size, chosen)
        .select("hash", F.sha2("body", 256).alias("text_sha256"), "group_size", "keep_id"), "bodies",
    )
    distinct = bodies.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    collided = not distinct.isEmpty()
    single = bodies.join(distinct, "hash", "left_anti") if collided else bodies
    # Grouped hashes join as plain exchanges of staged tables, so a hot hash is split at run time.
    out = keys.join(single.select("hash", "group_size", "keep_id").hint("merge"), "hash", "left")
    if collided:
        apart = rows.join(distinct, "hash", "left_semi")
        split = apart.groupBy("hash", "body").agg(size, chosen)
        apart = apart.join(split, ["hash", "body"]).withColumn("text_sha256", F.sha2("body", 256))
        out = union([out.join(distinct, "hash", "left_anti"), apart.select(out.columns)])
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
