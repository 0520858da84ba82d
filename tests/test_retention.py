"""Retention and reclaim against literal loops and the published scenarios."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import reclaim, retention
from cairnlake.operators.retention import Policy

NOON = dt.datetime(2026, 9, 20, 12)


def loop(snapshots, policy):
    """Newest first; each tier admits the first snapshot of a new period while it has room; the last matching tier names the reason."""
    keys = {"daily": lambda t: t.date(), "weekly": lambda t: t.isocalendar()[:2], "monthly": lambda t: (t.year, t.month), "yearly": lambda t: t.year}
    seen, out = {k: set() for k in keys}, {}
    for i, t in sorted(snapshots, key=lambda x: (-x[1].timestamp(), x[0])):
        out[i] = (False, "")
        for name, _, reason in retention.TIERS:
            period = keys[name](t)
            if len(seen[name]) < getattr(policy, name) and period not in seen[name]:
                seen[name].add(period)
                out[i] = (True, reason)
    return out


def gfs(spark, rows, policy):
    df = spark.createDataFrame(rows, "snapshot_id long, ts timestamp")
    return {r["snapshot_id"]: (r["keep"], r["reason"]) for r in retention.gfs(df, policy).collect()}


def test_newest_days(spark):
    rows = [(i, NOON - dt.timedelta(days=i)) for i in range(5)]
    got = gfs(spark, rows, Policy(2, 0, 0, 0))
    assert got == {0: (True, "GFS: Daily (Son)"), 1: (True, "GFS: Daily (Son)"), 2: (False, ""), 3: (False, ""), 4: (False, "")}


@pytest.mark.parametrize("policy", [Policy(), Policy(0, 0, 0, 0), Policy(2, 0, 0, 0), Policy(30, 10, 5, 2), Policy(0, 3, 0, 1)])
def test_against_the_loop(spark, policy):
    rng = random.Random(3)
    rows = [(i, dt.datetime(2024, 12, 20) + dt.timedelta(hours=6 * rng.randrange(3000))) for i in range(400)]
    rows += [(1000, dt.datetime(2027, 1, 1)), (1001, dt.datetime(2026, 12, 31)), (1002, dt.datetime(2026, 12, 31))]
    assert gfs(spark, rows, policy) == loop(rows, policy)


def test_precedence(spark):
    now, later, before = NOON, NOON + dt.timedelta(hours=1), NOON - dt.timedelta(hours=1)
    rows = [
        (1, False, "", "trashed", False, None, later), (2, True, "x", "trashed", True, later, before), (3, False, "", "trashed", False, None, None),
        (4, False, "", "active", True, None, None), (5, False, "", "active", False, later, None), (6, False, "", "active", False, before, None), (7, True, "x", "active", False, now, None),
    ]
    df = spark.createDataFrame(rows, "snapshot_id int, keep boolean, reason string, state string, pinned boolean, retain_until timestamp, purge_after timestamp")
    got = {r[0]: (r[1], r[2]) for r in retention.decisions(df, F.lit(now)).select("snapshot_id", "keep", "reason").collect()}
    assert got == {1: (True, "Recoverable trash"), 2: (False, "Trash recovery window expired"), 3: (True, "Recoverable trash"), 4: (True, "Pinned"), 5: (True, "Retain-until override"), 6: (False, ""), 7: (True, "x")}


def chunks(spark, rows):
    return spark.createDataFrame(rows, "storage_id string, pack_id string, length long, upload_time timestamp")


def test_grace(spark):
    old, fresh = NOON - dt.timedelta(hours=48), NOON - dt.timedelta(hours=6)
    c = chunks(spark, [("live", "p", 10, old), ("dead", "p", 10, old), ("young", "p", 10, fresh)])
    live = spark.createDataFrame([("live",)], "storage_id string")
    rows = reclaim.classify_chunks(c, live, F.lit(NOON - dt.timedelta(hours=24)))
    assert {r[0]: r["status"] for r in rows.collect()} == {"live": "live", "dead": "dead", "young": "grace"}
    assert [tuple(r) for r in reclaim.pack_dead_space(rows).select("dead_bytes", "repack").collect()] == [(10, False)]


def test_repack_threshold_and_survivors(spark):
    rows = [("a", "p", 60, "live"), ("b", "p", 40, "dead"), ("c", "q", 59, "live"), ("d", "q", 41, "dead"), ("e", "q", 5, "grace"), ("f", "q", 3, "dead")]
    df = spark.createDataFrame(rows, "storage_id string, pack_id string, length long, status string")
    packs = reclaim.pack_dead_space(df)
    assert {r["pack_id"]: r["repack"] for r in packs.collect()} == {"p": False, "q": True}
    names = lambda d: sorted(r[0] for r in d.select("storage_id").collect())
    assert names(reclaim.survivors(df, packs)) == ["c", "e"] and names(reclaim.survivors(df, packs, compat=True)) == ["c"]
    assert names(reclaim.after_collection(df, packs)) == ["a", "c", "e"] and names(reclaim.after_collection(df, packs, compat=True)) == ["a", "c"]


def test_hard_delete(spark):
    refs = spark.createDataFrame([(1, "s"), (2, "s"), (3, "u"), (3, "u")], "snapshot_id int, storage_id string")
    c = chunks(spark, [("s", "p", 7, NOON), ("u", "p", 9, NOON)])
    gone = reclaim.hard_delete(refs, c, spark.createDataFrame([(3,)], "snapshot_id int"))
    assert [r["storage_id"] for r in gone.collect()] == ["u"]
    each = {r[0]: (r[1], r[2]) for r in reclaim.reclaim_by_snapshot(refs, c).collect()}
    assert each == {1: (0, 0), 2: (0, 0), 3: (1, 9)}


def test_true_dead_bytes(spark):
    entries = spark.createDataFrame([("p", "a", 5), ("p", "b", 6), ("q", "b", 6)], "pack_id string, storage_id string, length long")
    known = spark.createDataFrame([("a", "p"), ("b", "q")], "storage_id string, pack_id string")
    assert {r[0]: (r[1], r[2]) for r in reclaim.true_dead_bytes(entries, known).collect()} == {"p": (11, 6), "q": (6, 0)}
