"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Lines that are not blank are hashed. Around every line two windows are laid: the shortest run from it on, and the shortest run up to it,
that hold `min_words` words. The smallest line hash in a window is selected as its fingerprint: equal windows select the same line, so every
repeated run of `min_words` words or more is certain to share one. Fingerprints (hash and position) are gathered first, and those whose hash
stands at one position only are dropped (most are). The positions of the others are joined: a window that selected one is compared, by its whole contents, with
the first position where these stand. A match extends both ways from its fingerprint line by line: back for as long as the windows that begin
one line earlier match too, and on for as long as those that end one line later do; what that covers of the later copy is deleted.

A line is thus deleted exactly if a run of whole lines through it that holds at least `min_words` words equals an earlier
one (by doc_id, then line) that it does not overlap. Of each line of a repeated run either the shortest run from it on lies within, or what
follows it is too short for that, and then the shortest run that ends with the repeated one holds it; so both kinds of windows cover it. Every
deleted line stands somewhere earlier, so the first copy of any line always stays.

Without `maximal` only windows from a line on count, which leaves the end of a repeated run whose last lines hold too few words for a window
of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty
from .mix import word_count

MIN_WORDS = 50
ID = ["doc_id", "tkey"]
ADDED = ["n_lines", "removed_lines"]


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, maximal: bool = True) -> DataFrame:
    """The runs of lines to delete: doc_id, tkey (128 bits of the text), runs (sorted array of start, last, and before, the line after the last run; lines from 0), for rows that have any."""
    work = Workspace(docs.sparkSession, "linededup")
    keyed = docs.select(F.col("doc_id").cast("long"), F.md5(text_or_empty()).alias("tkey"), "text")  # once a text, not once a line
    rows = keyed.select(*ID, F.posexplode_outer(F.split("text", "\n")).alias("line", "s"))
    lines = rows.filter(F.col("s").rlike(r"[^\x20\x09-\x0D]")).select(*ID, "line", F.unhex(F.md5("s")).alias("h"), word_count(F.col("s")).alias("words"))
    own = Window.partitionBy(*ID).orderBy("line")
    lines = lines.withColumn("again", F.lag("line").over(own).eqNullSafe(F.col("line"))).filter(~F.col("again"))  # of rows that repeat wholly one counts
    lines = lines.withColumn("before", F.coalesce(F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("i", F.row_number().over(own))
    window = lambda over: F.struct(
        F.min("line").over(over).alias("line"), F.max("line").over(over).alias("last"), F.min("i").over(over).alias("i"), F.max("i").over(over).alias("j"), F.sum("words").over(over).alias("n"),
        F.min(F.struct(F.xxhash64("h").alias("hash"), F.col("line").alias("at"))).over(over).alias("print"),
        F.unhex(F.md5(F.array_join(F.transform(F.collect_list("h").over(over), lambda h: F.hex(h)), ""))).alias("content"),
    )
    kinds = [window(Window.partitionBy(*ID).orderBy("before").rangeBetween(0, min_words - 1)).alias("x")]
    if maximal:
        lines = lines.withColumn("after", F.col("before") + F.col("words"))
        kinds.append(window(Window.partitionBy(*ID).orderBy("after").rangeBetween(1 - min_words, 0)).alias("y"))
    windows = lines.select(*ID, *kinds)
    both = F.array("x") if not maximal else F.when(F.expr("x.line = y.line and x.last = y.last"), F.array("x")).otherwise(F.array("x", "y"))
    windows = windows.withColumn("both", both).select(*ID, F.explode_outer("both").alias("w")).select(*ID, "w.line", "w.last", "w.i", "w.j", "w.n", "w.print.hash", "w.print.at", "w.content")
    windows = work.write(windows.filter(F.col("n") >= min_words).drop("n"), "windows")
    # What joins are made with is written first: then a hot key's rows can be dealt to several tasks.
    place = F.struct(*ID, "at")
    prints = windows.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("hash")
    matched = work.write(windows.join(work.write(prints, "prints"), "hash", "left_semi").select(*ID, "line", "last", "i", "j", "content").distinct(), "matched")
    first = matched.groupBy("content").agg(F.min(F.struct(*ID, "line", "last")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = matched.join(work.write(first, "first"), "content").filter(~F.struct(*ID).eqNullSafe(F.struct("first.doc_id", "first.tkey")) | (F.col("line") > F.col("first.last")))
    # The union of a row's matches: a match begins a run where a line (that is not blank) lies between it and the end of all before it.
    order = Window.partitionBy(*ID).orderBy("i", "j")
    later = later.withColumn("reach", F.max("j").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("run", F.sum(F.when(F.coalesce("reach", F.lit(-2)) + 1 < F.col("i"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy(*ID, "run").agg(F.min("line").alias("start"), F.max("last").alias("last"))
    runs = runs.withColumn("before", F.coalesce(F.lag("last").over(Window.partitionBy(*ID).orderBy("run")) + 1, F.lit(0)))
    found = work.write(runs.groupBy(*ID).agg(F.sort_array(F.collect_list(F.struct("start", "last", "before"))).alias("runs")), "runs")
    work.drop("windows", "prints", "matched", "first")
    return found


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, maximal: bool = True) -> DataFrame:
    """docs without the later copies of repeated runs of lines; adds n_lines (of the text as it was) and removed_lines (array of line numbers from 0).

    Lines end at line feeds only. Blank lines don't break a run; they go where the lines around them both go. Null texts stay null, empty
    texts empty, with no lines removed. Rows that agree in doc_id and text count as one document and get one
    result; rows that share only the doc_id are different documents, in the order of a hash of their text.
    A null doc_id comes before all others. Other columns pass through, whatever their names; columns named n_lines or removed_lines give way to the new ones. No rows give no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    runs = repeated_lines(docs.select("doc_id", "text"), min_words, maximal)
    # No part of the key is null, so that the join deals out rows without an id alike.
    key = lambda c: [F.col(c).isNull().alias("none"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("id"), F.col("tkey")]
    rows = docs.toDF(*names).withColumn("tkey", F.md5(text_or_empty(at["text"])))
    # Runs grow with the corpus: a merge join at every size.
    joined = rows.select(*names, *key(at["doc_id"])).hint("merge").join(runs.select(*key("doc_id"), "runs").hint("merge"), ["none", "id", "tkey"], "left")
    joined = joined.withColumn("lines", F.when(F.col("runs").isNotNull(), F.split(at["text"], "\n")))
    kept = F.expr("array_join(flatten(concat(transform(runs, r -> slice(lines, r.before + 1, r.start - r.before)), array(slice(lines, element_at(runs, -1).last + 2, size(lines))))), '\n')")
    text, whole = F.when(F.col("runs").isNull(), F.col(at["text"])).otherwise(kept), F.col(at["text"])
    n_lines = F.when(whole.isNull(), 0).otherwise(F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    removed = F.when(F.col("runs").isNull(), F.expr("cast(array() as array<int>)")).otherwise(F.expr("flatten(transform(runs, r -> sequence(r.start, r.last)))"))
    own = [(text if c == "text" else F.col(n)).alias(c) for n, c in zip(names, docs.columns) if c not in ADDED]
    return joined.select(*own, n_lines.alias(ADDED[0]), removed.alias(ADDED[1]))
