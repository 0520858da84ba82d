"""Fixed binary records, and the probabilistic filter of content ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import big_endian, from_big_endian

#: A chunk location: pack id 32, offset 8, length 4, upload time 8 bytes, big-endian.
LOCATION_BYTES = 52
#: Bits an item, least number of items, probes of the filter.
BITS_PER_ITEM, LEAST_ITEMS, PROBES = 10, 1024, 4


def encode_location(pack_id: Column, offset: Column, length: Column, upload_time_unix: Column) -> Column:
    return F.concat(F.unhex(pack_id), big_endian(offset, 8), big_endian(length, 4), big_endian(upload_time_unix, 8))


def decode_location(record: Column) -> Column:
    """struct(pack_id, offset, length, upload_time_unix); a record of another size is an error, not a skipped row."""
    good = F.when(F.octet_length(record) == LOCATION_BYTES, record).otherwise(F.raise_error(F.lit("corrupt chunk location")).cast("binary"))
    part = lambda at, n: F.substring(good, at + 1, n)
    return F.struct(
        F.lower(F.hex(part(0, 32))).alias("pack_id"), from_big_endian(part(32, 8)).alias("offset"),
        from_big_endian(part(40, 4)).alias("length"), from_big_endian(part(44, 8)).alias("upload_time_unix"),
    )


def well_formed(record: Column, size: int = 32) -> Column:
    """Whether a key or id has its size; other rows are skipped by scans."""
    return F.octet_length(record) == size


def bloom_bits(expected: int) -> int:
    return (max(expected, LEAST_ITEMS) * BITS_PER_ITEM + 63) // 64 * 64


def bloom_positions(cid: Column, bits: int) -> Column:
    """The bit numbers of a content id (hex): its four little-endian words, as unsigned numbers, modulo the bits."""
    word = lambda i: F.conv(F.concat(*(F.substring(cid, 16 * i + 15 - 2 * b, 2) for b in range(8))), 16, 10).cast("decimal(20,0)")
    return F.array(*((word(i) % F.lit(bits).cast("decimal(20,0)")).cast("bigint") for i in range(PROBES)))


def bloom_filter(cids: DataFrame, expected: int) -> DataFrame:
    """The filter as bitmaps of 32,768 bits (bucket, bits), built by partial aggregation: a byte and a quarter an id in all."""
    at = F.col("position") + 1
    places = cids.select(F.explode(bloom_positions(F.col("cid"), bloom_bits(expected))).alias("position"))
    return places.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def might_contain(asked: DataFrame, filter_bits: DataFrame, expected: int) -> DataFrame:
    """asked (cid) with might_contain: whether all of an id's bits are set; false is certain.

    Each of an id's places is looked up in its bitmap. A filter that is small is sent to all tasks, and then no id is shuffled.
    """
    rows = asked.select("cid").withColumn("places", bloom_positions(F.col("cid"), bloom_bits(expected))).withColumn("might_contain", F.lit(True))
    for i in range(PROBES):
        at = F.col("places")[i] + 1
        rows = rows.withColumns({"bucket": F.bitmap_bucket_number(at), "bit": F.bitmap_bit_position(at)}).join(filter_bits, "bucket", "left")
        byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.col("bits").isNotNull() & (F.call_function("getbit", byte, (F.col("bit") % 8).cast("int")) == 1)
        rows = rows.select("cid", "places", (F.col("might_contain") & F.coalesce(hit, F.lit(False))).alias("might_contain"))
    return rows.drop("places")
