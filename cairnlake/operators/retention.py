"""Retention: grandfather-father-son tiers, and the precedence of lifecycle over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (policy field, date_trunc unit, reason); a later tier's reason wins over an earlier one's.
TIERS = (
    ("daily", "day", "GFS: Daily (Son)"),
    ("weekly", "week", "GFS: Weekly (Father)"),
    ("monthly", "month", "GFS: Monthly (Grandfather)"),
    ("yearly", "year", "GFS: Yearly (Archive)"),
)
#: Reasons of the lifecycle, in order of precedence.
TRASH_KEPT, TRASH_EXPIRED, PINNED, RETAIN_UNTIL = "Recoverable trash", "Trash recovery window expired", "Pinned", "Retain-until override"
MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Policy:
    """How many of the newest periods with snapshots each tier keeps; 0 or less disables a tier."""

    daily: int = 7
    weekly: int = 4
    monthly: int = 12
    yearly: int = 3


def gfs(snapshots: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """snapshots (snapshot_id, ts, ...) with keep and reason.

    Each tier keeps the newest snapshot of each of its N newest periods that have any; ties go to the
    smallest id; unkept snapshots have an empty reason. One partial aggregation finds the newest snapshot of every
    day; weeks, months and years come from these, and a tier is a top-N of its periods, so no window gathers the
    catalogue in one task. The kept ids are at most the policy's sum, which decides whether they are broadcast.
    """
    newest = F.min(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("back"), "snapshot_id")).alias("first")
    days = snapshots.filter(F.col("ts").isNotNull()).groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(newest)
    wanted = None
    for order, (name, unit, reason) in enumerate(TIERS):
        n = getattr(policy, name)
        if n <= 0:
            continue
        periods = days.groupBy(F.date_trunc(unit, "day").alias("period")).agg(F.min("first").alias("first"))
        tier = periods.orderBy(F.col("period").desc()).limit(n).select("first.snapshot_id", F.lit(order).alias("tier"), F.lit(reason).alias("reason"))
        wanted = tier if wanted is None else wanted.unionByName(tier)
    if wanted is None:
        return snapshots.withColumns({"keep": F.lit(False), "reason": F.lit("")})
    best = wanted.groupBy("snapshot_id").agg(F.max_by("reason", "tier").alias("reason"))
    joined = snapshots.join(_small(best, policy), "snapshot_id", "left")
    return joined.withColumn("keep", F.col("reason").isNotNull()).withColumn("reason", F.coalesce("reason", F.lit("")))


def _small(rows: DataFrame, policy: Policy) -> DataFrame:
    return F.broadcast(rows) if sum(max(0, getattr(policy, t[0])) for t in TIERS) <= MOST_BROADCAST else rows


def with_lifecycle(snapshots: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Snapshots with their lifecycle; one without a record is active, unpinned and unlabelled."""
    joined = snapshots.join(lifecycle, "snapshot_id", "left")
    return joined.withColumns({"state": F.coalesce("state", F.lit("active")), "pinned": F.coalesce("pinned", F.lit(False))})


def decisions(classified: DataFrame, now: Column) -> DataFrame:
    """Final keep and reason of rows that have GFS's (keep, reason) and the lifecycle (state, pinned, retain_until, purge_after).

    Trash first: kept until purge_after (for ever, if null); then pins; then retain_until after now; then GFS.
    """
    trashed, held = F.col("state") == "trashed", F.col("purge_after").isNull() | (F.col("purge_after") > now)
    until = F.col("retain_until").isNotNull() & (F.col("retain_until") > now)
    reason = F.when(trashed & held, TRASH_KEPT).when(trashed, TRASH_EXPIRED).when(F.col("pinned"), PINNED).when(until, RETAIN_UNTIL).otherwise(F.col("reason"))
    keep = F.when(trashed, held).otherwise(F.col("pinned") | until | F.col("keep"))
    return classified.withColumn("final_reason", reason).withColumn("final_keep", keep).drop("keep", "reason").withColumnsRenamed({"final_keep": "keep", "final_reason": "reason"})
