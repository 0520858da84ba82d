"""The snapshot catalogue: listing, details and lifecycle edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_error, label_normalise, trash_times
from .retention import with_lifecycle


def details(snapshots: DataFrame, lifecycle: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Snapshots with lifecycle and status (ok, auth-failed, decode-error). An unreadable one has no time and zero totals, and default lifecycle."""
    rows = with_lifecycle(snapshots, lifecycle)
    if statuses is None:
        return rows.withColumn("status", F.lit("ok"))
    rows = rows.join(statuses.select("snapshot_id", "status"), "snapshot_id", "left").withColumn("status", F.coalesce("status", F.lit("ok")))
    ok = F.col("status") == "ok"
    return rows.withColumns({"ts": F.when(ok, F.col("ts")), "total_files": F.when(ok, F.col("total_files")).otherwise(0), "total_bytes": F.when(ok, F.col("total_bytes")).otherwise(0)})


def listing(rows: DataFrame, include_trashed: bool = False) -> DataFrame:
    """Readable snapshots first, newest first, then by id; trashed ones only on request."""
    shown = rows if include_trashed else rows.filter("state <> 'trashed'")
    return shown.orderBy(*_order())


def positions(rows: DataFrame) -> DataFrame:
    """Each series of the catalogue (series) in the listing's order, numbered from 1: snapshot_id, series, position."""
    return rows.select("snapshot_id", "series", F.row_number().over(Window.partitionBy("series").orderBy(*_order())).alias("position"))


def _order() -> list[Column]:
    return [F.col("ts").isNull(), F.col("ts").desc(), F.col("snapshot_id")]


def trash(lifecycle: DataFrame, ids: DataFrame, now: Column, seconds: int = 0) -> DataFrame:
    """Lifecycle after trashing ids for so many seconds (0: the default); those already in trash stay as they are."""
    if seconds < 0:
        raise ValueError("a recovery time can't be negative")
    at, purge = trash_times(F.col("state"), now, F.lit(seconds))
    hit = _hit(lifecycle, ids)
    fresh = F.col("hit") & at.isNotNull()
    return hit.withColumns({"trashed_at": F.when(fresh, at).otherwise(F.col("trashed_at")), "purge_after": F.when(fresh, purge).otherwise(F.col("purge_after")), "state": F.when(F.col("hit"), "trashed").otherwise(F.col("state"))}).drop("hit")


def untrash(lifecycle: DataFrame, ids: DataFrame) -> DataFrame:
    """Both trash times go; pins, labels and retain_until stay."""
    hit, none = _hit(lifecycle, ids), F.lit(None).cast("timestamp")
    return hit.withColumns({"trashed_at": F.when(~F.col("hit"), F.col("trashed_at")).otherwise(none), "purge_after": F.when(~F.col("hit"), F.col("purge_after")).otherwise(none), "state": F.when(F.col("hit"), "active").otherwise(F.col("state"))}).drop("hit")


def pin(lifecycle: DataFrame, ids: DataFrame, pinned: bool = True) -> DataFrame:
    hit = _hit(lifecycle, ids)
    return hit.withColumn("pinned", F.when(F.col("hit"), F.lit(pinned)).otherwise(F.col("pinned"))).drop("hit")


def retain_until(lifecycle: DataFrame, ids: DataFrame, until: Column) -> DataFrame:
    hit = _hit(lifecycle, ids)
    return hit.withColumn("retain_until", F.when(F.col("hit"), until).otherwise(F.col("retain_until"))).drop("hit")


def describe(lifecycle: DataFrame, edits: DataFrame) -> DataFrame:
    """Lifecycle after edits (snapshot_id, labels, note): normalised; an edit over a limit is an error."""
    error = label_error(F.col("new_labels"), F.col("new_note"))
    new = edits.select("snapshot_id", F.col("labels").alias("new_labels"), F.col("note").alias("new_note"), F.lit(True).alias("hit"))
    joined = _complete(lifecycle, new).join(new, "snapshot_id", "left")
    checked = F.when(error.isNotNull(), F.raise_error(error).cast("array<string>")).otherwise(label_normalise(F.col("new_labels")))
    return joined.withColumns({"labels": F.when(F.col("hit"), checked).otherwise(F.col("labels")), "note": F.when(F.col("hit"), F.trim("new_note")).otherwise(F.col("note"))}).drop("hit", "new_labels", "new_note")


def _complete(lifecycle: DataFrame, ids: DataFrame) -> DataFrame:
    """Lifecycle with default rows for ids that have none."""
    return lifecycle.join(ids.select("snapshot_id").distinct(), "snapshot_id", "full").withColumns({"state": F.coalesce("state", F.lit("active")), "pinned": F.coalesce("pinned", F.lit(False))})


def _hit(lifecycle: DataFrame, ids: DataFrame) -> DataFrame:
    marked = ids.select("snapshot_id").distinct().withColumn("hit", F.lit(True))
    return _complete(lifecycle, ids).join(marked, "snapshot_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
