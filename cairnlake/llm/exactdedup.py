"""Exact dedup by distributed MSD radix partitioning.

Documents are split by their most significant bytes first. A round takes the next digit (a block of
successive bytes) of every document that still has company, counts each (group, digit) with map-side
partial aggregation, and deals every document its subgroup. A group is finished once it is a singleton
or once its digit is shorter than the block, i.e. the texts have ended; texts that end together in one
group agree in every byte, so equality is decided by bytes alone and needs no digest.

Groups are told apart by row numbers, not by digests. Digits start short, because most texts differ early, and grow, so that copies of long texts
take few rounds; only documents with company go into a further round. Each round is one table in the shared folder. A group of any size is
counted by partial sums; the counts are written before rows are joined with them, so that adaptive execution can deal a large group's rows to several tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

FIRST_DIGIT, GROWTH, LAST_DIGIT = 64, 8, 1 << 20


def exact_groups(docs: DataFrame, first_digit: int = FIRST_DIGIT, growth: int = GROWTH, last_digit: int = LAST_DIGIT) -> DataFrame:
    """Groups of byte-equal texts: a row (doc_id, keep_id, group_size, text_sha256) for every row of docs.

    Null texts count as empty; empty texts are one group. Rows that repeat a doc_id count each. A null
    doc_id never stays unless its whole group has none (keep_id is then null). Other columns are not read,
    so their names do not matter. No rows give no rows. text_sha256 only labels the output.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.encode(text_or_empty(), "utf-8").alias("bytes"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("bytes", 256)))
    short = lambda step: step.withColumn("bytes", F.when(F.col("open"), F.col("bytes")))
    done = _rounds(rows, F.col("bytes"), short, first_digit, growth, last_digit)
    return done.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"))


def _rounds(rows: DataFrame, content: Column, shorten: Callable[[DataFrame], DataFrame], first_digit: int, growth: int, last_digit: int) -> DataFrame:
    """All rows (id, and more) with keep_id, group_size and turn and group (together the group's number) once they are finished. content has their bytes.

    shorten drops what is not needed any more of a round's table, by the columns id, keep_id, group_size and open (goes into the next round).
    """
    work = Workspace(rows.sparkSession, "exactdedup")
    state = rows.withColumns({"row": F.monotonically_increasing_id(), "group": F.lit(0).cast("long")})
    digit, at, done, k = first_digit, 0, [], 0
    while True:
        split = state.withColumn("digit", F.substring(content, at + 1, digit))
        groups = split.groupBy("group", "digit").agg(F.min("row").alias("part"), F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = work.write(groups, f"groups{k}")
        # Groups grow with the corpus: a merge join at every size.
        step = split.hint("merge").join(groups.hint("merge"), ["group", "digit"]).withColumn("open", (F.col("group_size") > 1) & (F.octet_length("digit") == digit)).withColumn("turn", F.lit(k))
        step = work.write(shorten(step.drop("group", "digit").withColumnRenamed("part", "group")), f"round{k}")
        work.drop(f"groups{k}")
        done.append(step.filter(~F.col("open")))
        state = step.filter("open").drop("keep_id", "group_size", "open", "turn")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)
        at, digit, k = at + digit, min(digit * growth, last_digit), k + 1


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without copies: of each group of equal texts, the row with the largest doc_id, in the columns of docs.

    Where that doc_id itself is repeated, one of its rows stays; texts that only rows without a doc_id have keep one of these. Null texts
    count as empty. Columns of docs may have any names; no rows give no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    rows = docs.toDF(*names).withColumn("id", F.col(at["doc_id"]).cast("long"))
    largest = lambda step: step.filter(F.col("open") | F.col("id").eqNullSafe(F.col("keep_id")))
    left = _rounds(rows, F.encode(text_or_empty(at["text"]), "utf-8"), largest, FIRST_DIGIT, GROWTH, LAST_DIGIT)
    # Of copies that share the largest doc_id one row stays; all others have no company any more.
    several = left.filter("group_size > 1")
    one = several.groupBy("turn", "group").agg(F.min("row").alias("row")).select("row")
    kept = left.filter("group_size = 1").unionByName(several.join(one, "row", "left_semi").select(*left.columns))
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
