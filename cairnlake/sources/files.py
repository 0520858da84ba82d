"""File system scans: readable files, skipped items, and the permission policy."""

from __future__ import annotations

import contextlib
import os
import stat
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

LISTED = "path string, size bigint, mode bigint, mtime_epoch bigint, uid bigint, gid bigint, symlink_target string, xattrs array<struct<name: string, value: binary>>"
ARROW = pa.schema([
    *((n, pa.string()) for n in ("found", "full", "path")), *((n, pa.int64()) for n in ("size", "mode", "mtime_epoch", "uid", "gid")), ("symlink_target", pa.string()),
    ("xattrs", pa.list_(pa.struct([("name", pa.string()), ("value", pa.binary())]))), *((n, pa.string()) for n in ("kind", "operation", "reason")),
])
POLICIES = ("fail", "skip")


class PermissionPreflightError(Exception):
    def __init__(self, items):
        super().__init__(f"{len(items)} items can't be read")
        self.items = items


#: What listing a folder gives: subfolders, files and skipped items, told apart by `found`.
FOUND = f"found string, full string, {LISTED}, kind string, operation string, reason string"


def _fact(full: str, base: str) -> dict | None:
    """The row of a file or link, or of an item that can't be read; none for what is neither."""
    rel, s = os.path.relpath(full, base).replace(os.sep, "/"), os.lstat(full)
    link = stat.S_ISLNK(s.st_mode)
    if not link and not stat.S_ISREG(s.st_mode):
        return None
    try:
        if not link:
            with open(full, "rb"):
                pass
        xattrs = [{"name": n, "value": os.getxattr(full, n, follow_symlinks=False)} for n in os.listxattr(full, follow_symlinks=False)]
    except PermissionError as e:
        return {"found": "skipped", "path": rel, "kind": "file", "operation": "open", "reason": e.strerror}
    except OSError:  # no extended attributes there
        xattrs = []
    return {
        "found": "file", "path": rel, "size": s.st_size, "mode": stat.S_IMODE(s.st_mode) & 0o777, "mtime_epoch": int(s.st_mtime), "uid": s.st_uid, "gid": s.st_gid,
        "symlink_target": os.readlink(full) if link else "", "xattrs": xattrs,
    }


def _listed(folder: str, base: str):
    """What lies in one folder; one that can't be read is a skipped item, and pruned."""
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    yield {"found": "folder", "full": entry.path}
                elif (row := _fact(entry.path, base)) is not None:
                    yield row
    except PermissionError as e:
        yield {"found": "skipped", "path": os.path.relpath(folder, base).replace(os.sep, "/"), "kind": "directory", "operation": "scan", "reason": e.strerror}


def scan(spark: SparkSession, path: str, policy: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(files, skipped items) below a path that executors mount, or of a single file, each by path. Folders themselves are not listed.

    Folders are listed on the executors, level by level; nothing of the listing goes through the driver. With policy fail any skipped item is an
    error before anything is written; with skip they are left out.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown permission policy {policy!r}")
    ensure_checkpoint_dir(spark)
    single = not os.path.isdir(path) or os.path.islink(path)
    base = os.path.dirname(path) if single else path

    def run(batches):
        for batch in batches:
            out = [row for full in batch.column("full").to_pylist() for row in ([_fact(full, base)] if single else _listed(full, base)) if row]
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    level, parts = spark.createDataFrame([(path,)], "full string"), []
    while True:
        found = level.mapInArrow(run, FOUND).checkpoint()
        parts.append(found)
        level = found.filter("found = 'folder'").select("full")
        if level.isEmpty():
            break
        level = level.repartition(min(1000, max(spark.sparkContext.defaultParallelism, level.count() // 50)))
    every = reduce(DataFrame.unionByName, parts)
    columns = [f.name for f in every.schema.fields]
    skipped = every.filter("found = 'skipped'").select("path", "kind", "operation", "reason").orderBy("path")
    if policy == "fail" and (bad := skipped.head(1000)):
        raise PermissionPreflightError(bad)
    return every.filter("found = 'file'").select(*columns[2:-3]).orderBy("path"), skipped


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), content, size and modification time of all files below a folder, read by the executors; any Hadoop URI."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.col("path"), rf"^[a-z0-9]+:/*(?:\Q{root}\E)/", "")
    return files.select(rel.alias("path"), "content", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime_epoch"))


def restore(files: DataFrame, folder: str) -> None:
    """Writes files (path, content, symlink_target, mtime_epoch; mode, uid, gid, xattrs as far as they are there) below a folder that executors mount.

    Paths that leave it are an error before any write. A file is whole when it gets its name. Owners are set by root only, and 0:0 never.
    """
    from ..functions.text import safe_relative_path

    bad = files.filter(~safe_relative_path(F.col("path"))).select("path").head(1)
    if bad:
        raise ValueError(f"path leaves the destination: {bad[0]['path']!r}")

    optional = [c for c in ("mode", "uid", "gid", "xattrs") if c in files.columns]

    def run(rows):
        for row in rows:
            full = os.path.join(folder, row["path"])
            os.makedirs(os.path.dirname(full), exist_ok=True)
            part = f"{full}.part"
            if row["symlink_target"]:
                if os.path.lexists(part):
                    os.remove(part)
                os.symlink(row["symlink_target"], part)
            else:
                with open(part, "wb") as f:
                    f.write(row["content"] or b"")
            if "uid" in optional and "gid" in optional and (row["uid"], row["gid"]) != (0, 0) and os.geteuid() == 0:
                os.chown(part, row["uid"], row["gid"], follow_symlinks=False)
            if not row["symlink_target"]:
                if "mode" in optional:
                    os.chmod(part, row["mode"])
                for x in (row["xattrs"] or ()) if "xattrs" in optional else ():
                    with contextlib.suppress(OSError):  # not every file system has them
                        os.setxattr(part, x["name"], bytes(x["value"]))
                os.utime(part, (row["mtime_epoch"], row["mtime_epoch"]))
            os.replace(part, full)

    files.select("path", "content", "symlink_target", "mtime_epoch", *optional).foreachPartition(run)
