"""The driver's tables in the roles of repository tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_id, subkeys
from ..operators.chunking import line_chunks
from ..session import findable

#: Keys of test data, derived from a fixed passphrase; never those of a real repository.
KEY_DATA, KEY_META = subkeys("fixture passphrase", b"fixture salt 0123456789")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    findable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots: snapshot_id, ts, tag, size, customer."""
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("ts"), "o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice")


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle records of the orders that are finished, urgent or high; the others have none."""
    o = load(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") | F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    trashed = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("snapshot_id"), F.when(trashed, "trashed").otherwise("active").alias("state"), (F.col("o_orderpriority") == "1-URGENT").alias("pinned"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("retain_until"),
        F.when(trashed & (F.col("o_totalprice") > 1000), F.col("o_orderdate") + F.expr("INTERVAL 900 DAYS")).alias("purge_after"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_partkey").alias("storage_id"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as chunks: pack, length, and the last shipping as upload time."""
    shipped = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("upload_time"))
    part = load(spark, sf_dir, "part").join(shipped, "p_partkey")
    return part.select(F.col("p_partkey").alias("storage_id"), F.col("p_brand").alias("pack_id"), F.col("p_size").cast("bigint").alias("length"), "upload_time")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks: doc_id, source, lang, ordinal, chunk, length, cid."""
    return line_chunks(documents(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as ordered chunks."""
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("ordinal"), content_id(F.col("text")).alias("storage_id"), F.octet_length("text").cast("bigint").alias("length"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("ts").alias("completed_at"), F.col("event_id").alias("seq"), F.col("event_type").alias("operation"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.round(F.col("value") * 1000).cast("bigint").alias("duration_ns"), F.col("props").alias("result"),
    )
