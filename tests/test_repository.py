"""Manifests, integrity, replication, history, sources, tables and streams."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import catalog, history, integrity, manifest, replication
from cairnlake.sources import files, packfile, storage
from cairnlake.sources.repository import Repository, RepositoryBusy
from cairnlake.streaming import history as stream

NOON = dt.datetime(2026, 9, 20, 12)


def sid(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_manifest_and_tree(spark):
    chunks = spark.createDataFrame([("f", 2, "c", 3), ("f", 0, "a", 1), ("f", 1, "a", 1)], "path string, ordinal int, storage_id string, length long")
    r = manifest.file_manifest(chunks, ["path"]).first()
    assert (list(r["storage_ids"]), r["chunks"], r["size"]) == (["a", "a", "c"], 3, 5)
    fs = spark.createDataFrame([("s", "/d", "/d/x", sid("x")), ("s", "/", "/y", sid("y")), ("s", "/d", "/d/w", sid("w"))], "snapshot_id string, dir string, path string, hash string")
    dirs = spark.createDataFrame([("s", "/", None, 0), ("s", "/d", "/", 1), ("s", "/d/e", "/d", 2)], "snapshot_id string, path string, parent_path string, depth int")
    h = lambda p, *kids: hashlib.sha256(p.encode() + b"".join(map(bytes.fromhex, kids))).hexdigest()
    e = h("/d/e")
    d = h("/d", e, sid("w"), sid("x"))
    assert {r["path"]: r["hash"] for r in manifest.merkle_tree(fs, dirs).collect()} == {"/d/e": e, "/d": d, "/": h("/", d, sid("y"))}


def test_envelopes(spark):
    snaps = spark.createDataFrame([("a", None, NOON, ["DAILY"], "m", 3, 1, [("p", 3, ["s"], "h")])], "snapshot_id string, parent_snapshot_id string, ts timestamp, retention_tags array<string>, merkle_root string, total_bytes long, total_files long, files array<struct<path:string,size:long,storage_ids:array<string>,content_hash:string>>")
    sealed = manifest.encode_envelope(snaps, b"k" * 32)
    good = manifest.decode_envelope(sealed, b"k" * 32).first()
    assert good["status"] == "ok" and good["manifest"]["files"][0]["storage_ids"] == ["s"] and good["manifest"]["ts"] == NOON
    assert manifest.decode_envelope(sealed, b"x" * 32).first()["status"] == "auth-failed"
    assert manifest.decode_envelope(sealed.withColumn("format", F.lit("v9")), b"k" * 32).first()["status"] == "decode-error"


def test_parent_chain(spark):
    links = [(i, i - 1 if i else None) for i in range(12)] + [(100, 99), (99, None)]
    got = {tuple(r) for r in manifest.parent_chain(spark.createDataFrame(links, "snapshot_id int, parent_snapshot_id int")).collect()}
    assert got == {(i, j, i - j) for i in range(12) for j in range(i)} | {(100, 99, 1)}


def test_restore_and_verify(spark):
    refs = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("g", 0, "zz")], "path string, ordinal int, storage_id string")
    store = spark.createDataFrame([("a", "x"), ("b", "y")], "storage_id string, chunk string")
    restored = integrity.reassemble(refs, store, ["path"])
    fs = spark.createDataFrame([("f", sid("xy"), ""), ("g", sid("q"), ""), ("link", "00", "f"), ("empty", sid(""), "")], "path string, content_hash string, symlink_target string")
    got = {r["path"]: r["problem"] for r in integrity.verify(fs, restored, ["path"]).collect()}
    assert got == {"f": None, "g": "missing chunk", "link": None, "empty": None}
    assert integrity.verify_issues(integrity.verify(fs, restored, ["path"]), F.col("path")).first()["code"] == "verify-failed"


def test_packs(spark, tmp_path):
    raw = packfile.build_pack([(b"s" * 32, b"n" * 24, bytes.fromhex("AABBCCDD"))])
    assert raw[:4] == b"PACK" and int.from_bytes(raw[-40:-32], "big") == 72 and raw[-32:] == hashlib.sha256(raw[:-32][:-8]).digest()
    df = spark.createDataFrame([("good", bytearray(raw)), ("flip", bytearray(b"X" + raw[1:])), ("sum", bytearray(raw[:20] + b"?" + raw[21:])), ("short", bytearray(b"PACK"))], "pack_id string, content binary")
    parsed = packfile.parse_packs(df)
    assert {r["pack_id"]: r["error"] for r in parsed.collect()} == {"good": None, "flip": "no packfile", "sum": "checksum mismatch", "short": "too short"}
    assert [tuple(r) for r in packfile.pack_entries(parsed).collect()] == [("good", 0, (b"s" * 32).hex(), 8, 4)]
    assert integrity.scrub(parsed).count() == 3
    at = spark.createDataFrame([("good", 8, 4), ("good", 8, 5), ("none", 8, 4)], "pack_id string, offset long, length long")
    assert sorted((r["pack_id"], r["length"], r["content"] and bytes(r["content"])) for r in packfile.decode_records(df, at).collect()) == [("good", 4, bytes.fromhex("AABBCCDD")), ("good", 5, None), ("none", 4, None)]
    with pytest.raises(ValueError):
        packfile.build_pack([(b"s" * 32, b"n", b"")])
    folder = str(tmp_path / "packs")
    named = df.filter("pack_id = 'good'").withColumn("pack_id", F.sha2("content", 256))
    packfile.put_packs(named, folder)
    packfile.put_packs(named, folder)
    (tmp_path / "packs" / "notes.pack").write_text("x")
    back = packfile.read_packs(spark, folder).collect()
    assert [r["pack_id"] for r in back] == [hashlib.sha256(raw).hexdigest()] and bytes(back[0]["content"]) == raw
    packfile.delete_pack(folder, back[0]["pack_id"])
    with pytest.raises(FileNotFoundError):
        packfile.delete_pack(folder, back[0]["pack_id"])


def test_doctor(spark):
    c = spark.createDataFrame([(x, "p", i) for i, x in enumerate("abcdef")], "storage_id string, pack_id string, offset long")
    reverse = spark.createDataFrame([(x, f"c{x}") for x in "bcdef"], "storage_id string, cid string")
    forward = spark.createDataFrame([("cb", "q"), ("cc", "c"), ("cd", "d"), ("ce", "e"), ("cf", "f")], "cid string, storage_id string")
    entries = spark.createDataFrame([("p", 1, "b"), ("p", 3, "x"), ("p", 4, None), ("p", 5, "f")], "pack_id string, offset long, storage_id string")
    got = sorted((r["resource"], r["code"]) for r in integrity.doctor(c, reverse, forward, entries).collect())
    assert got == [("a", "missing-reverse-mapping"), ("b", "mapping-mismatch"), ("c", "unreadable-record"), ("d", "storage-id-mismatch"), ("e", "record-decode")]


def test_replication(spark, tmp_path):
    source = spark.createDataFrame([("A", 3), ("B", 5)], "object_id string, size long")
    planned = replication.plan(source, spark.createDataFrame([("A",)], "object_id string"))
    assert replication.counts(planned.withColumn("all", F.lit(1)), ["all"]).first()[1:] == (1, 1, 5)
    log = str(tmp_path / "tries")

    def copy(object_id):
        with open(log, "a") as f:
            f.write("x")
        if os.path.getsize(log) < 3:
            raise OSError("not yet")
        return 5

    assert tuple(replication.execute(planned, copy, wait=0.01).collect()[0]) == ("B", 5, 3, None)
    again = replication.plan(source, source)
    assert again.filter("action = 'copy'").isEmpty()
    entries = spark.createDataFrame([("s", "p1", 9, 1), ("s", "p2", 8, 1), ("t", "p1", 7, 1)], "storage_id string, pack_id string, offset long, length long")
    assert {r["storage_id"]: r["pack_id"] for r in replication.recover_locations(entries).collect()} == {"s": "p2", "t": "p1"}
    with pytest.raises(RuntimeError):
        replication.refuse_live(entries)
    journal = spark.createDataFrame([(["s"],)], "storage_ids array<string>")
    assert [r["storage_id"] for r in replication.roll_back(entries, journal).collect()] == ["t"]


def test_history(spark):
    rows = [(NOON + dt.timedelta(minutes=m), i, op) for i, (m, op) in enumerate([(0, "first"), (1, "second"), (2, "third"), (3, "a"), (3, "b")], 1)]
    h = spark.createDataFrame(rows, "completed_at timestamp, seq long, operation string")
    names = lambda d: [r["operation"] for r in d.collect()]
    assert names(history.newest(h, 3)) == ["b", "a", "third"] and len(names(history.newest(h, 0))) == 5
    assert sorted(names(history.pruned(h, F.lit(NOON + dt.timedelta(minutes=1))))) == ["a", "b", "second", "third"]
    more = spark.createDataFrame([(NOON, "z", 1), (NOON, "y", 0)], "completed_at timestamp, operation string, arrival int")
    assert {r["operation"]: r["seq"] for r in history.append(h, more).filter("seq > 5").collect()} == {"y": 6, "z": 7}


def test_lifecycle(spark):
    none = spark.createDataFrame([], "snapshot_id string, state string, pinned boolean, retain_until timestamp, labels array<string>, note string, trashed_at timestamp, purge_after timestamp")
    ids, now = spark.createDataFrame([("s",)], "snapshot_id string"), F.lit(NOON)
    rows = catalog.retain_until(catalog.pin(none, ids), ids, F.lit(NOON + dt.timedelta(hours=48)))
    rows = catalog.describe(rows, spark.createDataFrame([("s", ["Important", "important", "Photos"], " n ")], "snapshot_id string, labels array<string>, note string"))
    rows = catalog.trash(rows, ids, now, 3600)
    r = rows.first()
    assert (r["state"], r["pinned"], list(r["labels"]), r["note"], r["purge_after"] - r["trashed_at"]) == ("trashed", True, ["Important", "Photos"], "n", dt.timedelta(hours=1))
    assert catalog.trash(rows, ids, F.lit(NOON + dt.timedelta(days=1))).first()["trashed_at"] == NOON
    r = catalog.untrash(rows, ids).first()
    assert (r["state"], r["pinned"], r["trashed_at"], r["purge_after"], r["retain_until"]) == ("active", True, None, None, NOON + dt.timedelta(hours=48))
    with pytest.raises(ValueError):
        catalog.trash(rows, ids, now, -1)
    snaps = spark.createDataFrame([("s", NOON, 1, 1), ("t", NOON, 1, 1), ("u", None, 0, 0)], "snapshot_id string, ts timestamp, total_files long, total_bytes long")
    assert [r["snapshot_id"] for r in catalog.listing(catalog.details(snaps, rows)).collect()] == ["t", "u"]


def test_scan_and_restore(spark, tmp_path):
    src = tmp_path / "src"
    (src / "d").mkdir(parents=True)
    (src / "d" / "f.txt").write_bytes(b"content")
    (src / "a").write_bytes(b"")
    os.symlink("a", src / "link")
    (src / "void").mkdir()
    fs, skipped = files.scan(spark, str(src))
    assert [(r["path"], r["size"], r["symlink_target"]) for r in fs.collect()][:2] == [("a", 0, ""), ("d/f.txt", 7, "")] and fs.filter("symlink_target = 'a'").count() == 1 and skipped.isEmpty()
    assert [r["path"] for r in files.scan(spark, str(src / "a"))[0].collect()] == ["a"]
    with pytest.raises(ValueError):
        files.scan(spark, str(src), "maybe")
    read = {r["path"]: bytes(r["content"]) for r in files.contents(spark, str(src / "d")).collect()}
    assert read == {"f.txt": b"content"}
    out = spark.createDataFrame([("x/y", bytearray(b"1"), "", 5), ("l", None, "x/y", 0)], "path string, content binary, symlink_target string, mtime_epoch long")
    files.restore(out, str(tmp_path / "out"))
    assert (tmp_path / "out" / "l").read_bytes() == b"1"
    with pytest.raises(ValueError):
        files.restore(out.withColumn("path", F.concat(F.lit("../"), "path")), str(tmp_path / "out"))


def test_storage():
    config = storage.StorageConfig
    assert storage.storage_uri(config(path="/r")) == "file:///r/data"
    full = config("s3", endpoint="e", bucket="b", prefix="/p/", access_key="a", secret_key="s", object_lock_days=3)
    assert storage.storage_uri(full) == "s3a://b/p" and storage.hadoop_settings(full)["fs.s3a.endpoint"] == "e" and storage.lock_mode(full) == "GOVERNANCE"
    for bad in (config("ftp"), config("minio"), config("minio", endpoint="e"), config("minio", endpoint="e", bucket="b")):
        with pytest.raises(ValueError):
            storage.storage_uri(bad)
    with pytest.raises(ValueError):
        storage.refuse_local_remote(config())


def test_tables(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/repo")
    new = spark.createDataFrame([("c1", "s1", "p", 8, 5, 1), ("c2", "s2", "p", 73, 6, 1)], "cid string, storage_id string, pack_id string, offset long, length long, upload_time_unix long")
    repo.put_chunk_mappings(new)
    repo.put_chunk_mappings(new.filter("cid = 'c1'").withColumn("pack_id", F.lit("q")))
    assert {r["storage_id"]: r["pack_id"] for r in repo.table("chunks").collect()} == {"s1": "q", "s2": "p"} and repo.table("cids").count() == 2
    repo.delete_chunks(spark.createDataFrame([("s1",)], "storage_id string"))
    assert [repo.table(t).count() for t in ("cids", "cid_by_sid", "chunks")] == [1, 1, 1]
    repo.commit({"meta": spark.createDataFrame([("operation.backup.v1", bytearray(b"j"))], "key string, value binary")})
    snap = spark.createDataFrame([("s", None, NOON, 0, ["D"], "m", 1, 1)], "snapshot_id string, parent_snapshot_id string, ts timestamp, ts_ns bigint, retention_tags array<string>, merkle_root string, total_bytes bigint, total_files bigint")
    repo.commit_snapshot(snap, spark.createDataFrame([("s", "json-v1", bytearray(b"x"))], "snapshot_id string, format string, ciphertext binary"), "operation.backup.v1")
    assert repo.table("snapshots").count() == 1 and repo.table("meta").isEmpty()
    repo.delete_snapshots(snap)
    assert repo.table("snapshots").isEmpty() and repo.table("envelopes").isEmpty()
    before = repo.versions()
    assert repo.vacuum() > 0 and repo.versions() == before and repo.table("chunks").count() == 1
    with repo.lock():
        with pytest.raises(RepositoryBusy):
            with repo.lock():
                pass
    with repo.lock():
        pass


def test_stream(spark, tmp_path):
    rows = [(NOON + dt.timedelta(hours=13 * i), "op", 2) for i in range(4)]
    spark.createDataFrame(rows, "completed_at timestamp, operation string, duration long").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("completed_at timestamp, operation string, duration long").parquet(f"{tmp_path}/in")
    got = sorted(tuple(r)[1:] for r in stream.run_to_table(spark, stream.rollup(source)).collect())
    assert got == [("op", 1, 2), ("op", 1, 2), ("op", 2, 4)]
