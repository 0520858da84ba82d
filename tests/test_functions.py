"""Hashes, codecs, text functions and chunking against plain Python."""

import hashlib
import hmac
import random
import struct

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import codec, hashing, text
from cairnlake.operators import chunking, dedup


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_keys():
    a, b = hashing.subkeys("p", b"0123456789abcdef")
    assert len(a) == len(b) == 32 and a != b and (a, b) != hashing.subkeys("q", b"0123456789abcdef")
    with pytest.raises(ValueError):
        hashing.master_key("p", b"short")


def test_hmac_and_ids(spark):
    for key in (b"k" * 32, b"long" * 40):
        got = one(spark, hashing.hmac_sha256(key, F.lit(bytearray(b"message"))))[0]
        assert bytes(got) == hmac.new(key, b"message", hashlib.sha256).digest()
    cid = hashlib.sha256(b"c").hexdigest()
    a, b = one(spark, hashing.storage_id(b"1" * 32, F.lit(cid)), hashing.storage_id(b"2" * 32, F.lit(cid)))
    assert a != b and a == hashlib.sha256(hmac.new(b"1" * 32, bytes.fromhex(cid), hashlib.sha256).digest()).hexdigest()


def test_byte_orders(spark):
    n = 0x0102030405060708
    le, be = one(spark, hashing.little_endian(F.lit(n), 8), hashing.big_endian(F.lit(n), 4))
    assert bytes(le) == struct.pack("<Q", n) and bytes(be) == struct.pack(">I", n & 0xFFFFFFFF)


def test_merkle_file(spark):
    sids, content = [hashlib.sha256(x).hexdigest() for x in (b"a", b"b")], hashlib.sha256(b"ab").hexdigest()
    x = F.array(F.struct(F.lit("n").alias("name"), F.lit(bytearray(b"v")).alias("value")))
    lit = lambda v: F.lit(v).cast("bigint")
    got = one(spark, hashing.merkle_file_hash(F.lit("p/q"), F.array(*map(F.lit, sids)), F.lit(content), lit(0o644), lit(99), lit(1000), lit(7), F.lit("t"), x))[0]
    raw = b"p/q" + b"".join(map(bytes.fromhex, sids)) + bytes.fromhex(content) + struct.pack("<IQII", 0o644, 99, 1000, 7) + b"t" + b"nv"
    assert got == hashlib.sha256(raw).hexdigest()


def test_seal(spark):
    key, aad = F.lit(bytearray(b"k" * 32)), F.lit(bytearray(b"a"))
    sealed = hashing.seal(F.lit(bytearray(b"content")), key, aad)
    good, bad, again = one(spark, hashing.open_sealed(sealed, key, aad), hashing.open_sealed(sealed, key, F.lit(bytearray(b"b"))), sealed == hashing.seal(F.lit(bytearray(b"content")), key, aad))
    assert bytes(good) == b"content" and bad is None and again
    meta = hashing.encrypt_metadata(F.lit(bytearray(b"m")), b"k" * 32)
    assert bytes(one(spark, hashing.decrypt_metadata(meta, b"k" * 32))[0]) == b"m" and one(spark, hashing.decrypt_metadata(meta, b"x" * 32))[0] is None


def test_location_codec(spark):
    pack = "ab" * 32
    record = codec.encode_location(F.lit(pack), F.lit(2**40), F.lit(2**32 - 1), F.lit(1_700_000_000))
    raw, back = one(spark, record, codec.decode_location(record))
    assert bytes(raw) == bytes.fromhex(pack) + struct.pack(">QIQ", 2**40, 2**32 - 1, 1_700_000_000) and tuple(back) == (pack, 2**40, 2**32 - 1, 1_700_000_000)
    with pytest.raises(Exception, match="corrupt"):
        spark.range(1).select(codec.decode_location(F.lit(bytearray(b"short")))).collect()


def test_bloom(spark):
    cids = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(2500)]
    bits = codec.bloom_bits(1000)
    assert bits == 10_240
    words = [int.from_bytes(bytes.fromhex(cids[0])[8 * i : 8 * i + 8], "little") % bits for i in range(4)]
    df = spark.createDataFrame([(c,) for c in cids], "cid string")
    assert list(df.filter(F.col("cid") == cids[0]).select(codec.bloom_positions(F.col("cid"), bits)).first()[0]) == words
    known = spark.createDataFrame([(c,) for c in cids[:500]], "cid string")
    hit = {r["cid"]: r["might_contain"] for r in codec.might_contain(df, codec.bloom_filter(known, 1000), 1000).collect()}
    assert all(hit[c] for c in cids[:500]) and sum(not hit[c] for c in cids[500:]) >= 1800


def test_text(spark):
    labels = F.array(*map(F.lit, ["Important", " important", "", "Photos "]))
    assert one(spark, text.label_normalise(labels))[0] == ["Important", "Photos"]
    assert one(spark, text.tag_split(F.lit(" a, ,b ")), text.tag_split(F.lit("")), text.tag_split(F.lit(None)), text.tag_split(F.lit(","), True)) == (["a", "b"], ["DAILY"], ["DAILY"], [])
    many, long_, fine = F.array(*[F.lit(str(i)) for i in range(17)]), F.array(F.lit("é" * 33)), F.array(F.lit("é" * 32))
    errors = one(spark, *(text.label_error(x, F.lit("n")) for x in (many, long_, fine)), text.label_error(fine, F.lit("x" * 2049)))
    assert [e is None for e in errors] == [False, False, True, False]
    assert one(spark, text.fuzzy_match(F.lit("Downloads"), "dwn"), text.fuzzy_match(F.lit("Documents"), "dwn"), text.fuzzy_match(F.lit("a.b"), "a.b"), text.fuzzy_match(F.lit("axb"), "a.b"), text.fuzzy_match(F.lit("x"), "")) == (True, False, True, False, True)
    paths = ["a/b", "../a", "a/../b", "/a", "a/..b", "", ".."]
    assert one(spark, *(text.safe_relative_path(F.lit(p)) for p in paths)) == (True, False, False, False, True, False, False)
    assert one(spark, text.normalise_path(F.lit("\\r\\a//b"), "/r"), text.normalise_path(F.lit("/r"), "/r/"), text.normalise_path(F.lit("/rx/a"), "/r")) == ("a/b", "r", "/rx/a")
    assert one(spark, *(text.human_bytes(F.lit(n)) for n in (5, 1024, 10_240, 1536)), text.human_bytes(F.lit(1500), 1000)) == ("5 B", "1.0 KiB", "10 KiB", "1.5 KiB", "1.5 kB")
    assert one(spark, *(text.parse_time(F.lit(s)) for s in ("2026-01-02T03:04:05Z", "2026-01-02 03:04", "2026-01-02", "x")))[3] is None
    assert one(spark, text.present_error(F.lit("Snapshot not found"))[0], text.present_error(F.lit("zzz"))[0], text.present_error(F.lit(None).cast("string"))[0]) == ("Snapshot was not found", "Operation failed", None)
    assert one(spark, text.hex_id(F.lit("ab" * 32)).isNull(), text.hex_id(F.lit("ab")).isNull()) == (False, True)


def cuts(data, s):
    """Byte by byte."""
    gear, out, start = [int(x) for x in chunking.gear_table()], [], 0
    while start < len(data):
        n = min(s.most, len(data) - start)
        end, fp = n, 0
        for i in range(s.least, n):
            fp = ((fp << 1) + gear[data[start + i]]) & 0xFFFFFFFF
            if fp & (s.strict if i < s.target else s.normal) == 0:
                end = i
                break
        start += end
        out.append(start)
    return out


def test_content_defined_chunks(spark):
    rng = random.Random(1)
    assert int(chunking.gear_table()[0]) == (0x12345678 * 1664525 + 1013904223) % 2**32
    for sizes in (chunking.SMALL, chunking.Sizes(16, 40, 90, 0xF, 0x7), chunking.Sizes(64, 256, 1024, 0x1F, 0xF)):
        for n in (0, 1, 16, 17, 63, 64, 65, 256, 5000, 20_000):
            data = rng.randbytes(n) if n % 2 else bytes(rng.choices(b"abc ", k=n))
            assert chunking.cut_points(data, sizes) == cuts(data, sizes)
    data = rng.randbytes(3 << 20)
    assert chunking.cut_points(data) == cuts(data, chunking.Sizes())
    files = spark.createDataFrame([("a", bytearray(data[:9000])), ("b", bytearray()), ("c", None)], "path string, content binary")
    rows = sorted(chunking.fastcdc(files, chunking.SMALL).collect())
    assert {r["path"] for r in rows} == {"a"} and sum(r["length"] for r in rows) == 9000
    assert all(r["cid"] == hashlib.sha256(data[r["offset"] : r["offset"] + r["length"]]).hexdigest() for r in rows)


def test_shared_contents(spark):
    chunks = spark.createDataFrame([(f, 0, "c", 5) for f in range(16)], "file int, ordinal int, cid string, length long")
    got = dedup.dedup_counts(chunks, ["file"]).agg(F.sum("examined"), F.sum("new"), F.sum("reused")).first()
    assert tuple(got) == (16, 1, 15)
    again = dedup.dedup_counts(chunks, ["file"], chunks.select("cid").distinct()).agg(F.sum("new"), F.sum("reused"), F.sum("stored_bytes")).first()
    assert tuple(again) == (0, 16, 0)


def test_pack_filling(spark):
    rng = random.Random(2)
    rows = [(w, i, rng.randrange(0, 900)) for w in range(3) for i in range(400)]
    got = {(r["w"], r["i"]): (r["pack"], r["pack_offset"]) for r in dedup.assign_packs(spark.createDataFrame(rows, "w int, i int, length long"), ["w"], ["i"], 4096).collect()}
    want = {}
    for w in range(3):
        size, pack = 8, 0
        for _, i, n in (r for r in rows if r[0] == w):
            if size >= 4096:
                size, pack = 8, pack + 1
            want[w, i] = (pack, size)
            size += 60 + n
    assert got == want
