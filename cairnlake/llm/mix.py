"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Since keys are uniform, the ranges of a source's key space are
known beforehand: a document's range is the head of its key, every range of a source holds a like share
of it, and no sampling pass is needed. Within a range documents are sorted by key and their sizes summed
up; the sums of the ranges give every range its offset (two-level prefix sum). A document is taken as far
as its source's budget reaches; budgets above the source's size start further epochs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, text_or_empty

SHARE, MOST_EPOCHS, WEIGHTS, SEED = 1.5, 2, (3, 1, 2), "mix-1"
#: Rows that one range of a source holds about, and the least number of ranges.
RANGE_ROWS, LEAST_DIGITS = 20_000, 2


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Blank-delimited word starts are counted, one pass, no list of matches."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds target (double) to a table of one row per source (source, source_size).

    Sources by code point, null last, take the weights in turn. Targets share `share` of all sizes by
    weight, at most `most` times the own size; the excess is shared anew among the others. A target is
    min(weight * level, most * size): the level is found exactly by going through the sources in the order
    in which a rising level fills them. The table has a row per source, never per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double") * share)
        .withColumn("before", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
        .withColumn("place", F.row_number().over(filled))
    )
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap")))).select("source", "source_size", "target")


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """How much of each document the mix takes: doc_id, source, size, source_size, target, taken, for every row of docs.

    size is the number of words, 0 for null or blank texts. A source's taken words are the whole part of
    its target: whole epochs of it, then its documents in key order, the last one cut to fit. Null sources
    are a source of their own. Rows that repeat a doc_id count each; ties of keys go by doc_id, then size.
    Other columns are not read. No rows give no rows.
    """
    return _shares(docs, [], share, weights, most, seed).select("doc_id", "source", "size", "source_size", "target", "taken")


def _shares(docs: DataFrame, marks: list[Column], share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of mix() with further columns of docs, which also settle ties."""
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    rows = work.write(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), *marks), "sizes")
    marked = rows.columns[3:]
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(rows.count() / RANGE_ROWS, 1), 16)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # A null source becomes a flag and an empty name, so that joins and windows need no null rule.
    rows = rows.select("*", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), key.alias("key")).withColumn("range", F.substring("key", 1, digits))
    ranges = rows.groupBy("none", "name", "range").agg(F.sum("size").alias("sum"))
    offset = F.coalesce(F.sum("sum").over(Window.partitionBy("none", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("sum").over(Window.partitionBy("none", "name"))
    ranges = ranges.select("none", "name", "range", offset.alias("offset"), whole.alias("source_size"))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    goal = goal.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "target")
    inside = Window.partitionBy("none", "name", "range").orderBy("key", "doc_id", "size", *marked).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    reach = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = epochs * F.col("size") + F.least(F.greatest(reach, F.lit(0)), F.col("size"))
    return summed.join(ranges, ["none", "name", "range"]).join(goal, ["none", "name"]).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *marked)


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each epoch that takes a document, whole but for the one
    document of a source at which its budget ends, which is cut after its last word taken (and n_chars, if there, set anew).

    Documents without words take no part in budgets; they stay once, as they are. Rows that repeat a doc_id, or have none, are taken each by its own
    share. Columns may have any names; no rows give no rows.
    """
    work = Workspace(docs.sparkSession, "mixed")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "source", "text", *({"n_chars"} & set(docs.columns)))}
    rows = work.write(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    own = rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), F.col(at["text"]).alias("text"), "row")
    parts = work.write(_shares(own, [F.xxhash64(text_or_empty()).alias("mark"), F.col("row")], **parameters).select("row", "size", "taken"), "shares")
    joined = rows.hint("merge").join(parts.hint("merge"), "row")  # both grow with the corpus: a merge join at every size
    epochs = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).cast("int")
    turns = joined.filter(epochs > 0).withColumn("epoch", F.explode_outer(F.sequence(F.lit(1), epochs)))
    words = F.when(F.col("size") > 0, F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")))
    # The head up to the last word taken; the possessive group is matched in a loop, without a deep stack.
    text = F.col(at["text"])
    head = F.call_function("regexp_extract", text, F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), words.cast("string"), F.lit("}+")), F.lit(0))
    cut = words < F.col("size")
    out = turns.withColumn(at["text"], F.when(cut, head).otherwise(text))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.when(cut, F.length(at["text"]).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col(at["n_chars"])))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
