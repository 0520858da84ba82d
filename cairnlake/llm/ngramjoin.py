"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

Tokens are word shingles (64-bit hashes). All documents order their tokens alike: rare ones first, then
those of the frequent class, by hash within each. Two sets that are similar enough share a token within
prefixes of known length, so a document whose prefix is rare throughout is indexed by single tokens. Where rare
tokens do not fill the prefix, it is extended by g tokens; then two such documents share either a rare token or
g + 1 frequent ones. The frequent tokens fall into g classes by hash, so two of the shared ones are in one
class: pairs of one class are the index keys (k-token combinations, k = 2), which are few (classes hold
some four tokens) and far rarer than the tokens. g hangs on the set's size band; a set is indexed for its own
band and the next, which covers all partners.

Equal sets are one class from the start. Documents under one key are candidates: all pairs of a small group; of
a larger one each document with the smallest (the leader). Sizes, and the number of keys that a pair shares, exclude
most pairs before any set is compared. Candidates are verified; components follow from the links.

Tokens are counted over the whole corpus; what is broadcast of the frequent ones is bounded, so in a very large corpus some frequent tokens count as
rare. Where a leader's documents still are in several components, these documents go into a second round, among themselves, with the counts
of their tokens alone, which leaves few keys in large groups. What is open after that is
compared in blocks, less those pairs whose distances to the leader exclude a link (Jaccard distance is a metric). Every pair that shares a key is thus linked
through its component, excluded by a bound, or verified: no link is lost, and large groups of copies are never expanded into all pairs. A key that a
great many documents share needs no task of its own: its leader is known beforehand, and its documents meet it where they are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, in_parts, lean, small_batches, text_or_empty
from .components import connected_components, merged_components
from .shingles import MULTIPLIERS, mixed, shingle_sets

WORDS, PERCENT = 5, 75
#: A token is of the frequent class if it occurs in so many documents; of these at most MOST_FREQUENT, the most frequent (a bound
#: on what is broadcast). The class bears on cost only, never on the result. Tokens are counted in blocks of so many, dealt by ranges of their hashes.
FREQUENT, MOST_FREQUENT, BLOCK_TOKENS, MOST_RANGES = 16, 2_000_000, 1_000_000, 65_536
#: A key is known beforehand to be hot if it occurs in so many documents, as far as tasks see it LOCAL_HOT times or more among BLOCK_TOKENS; of these the MOST_FREQUENT. It bears on cost only.
HOT, LOCAL_HOT = 20_000, 64
#: All pairs of a group of so many documents are candidates; a larger one goes by its leader.
SMALL = 32
#: Documents of one leader meet in blocks of about so many.
BLOCK = 1000
#: Pairs that a task compares at least.
PAIRS_A_PART = 20_000


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def index_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, bool]:
    """The keys of a set of sorted tokens, and whether they are its whole prefix of rare tokens."""
    n = len(tokens)
    p = prefix_length(n, percent)
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        often = frequent[np.minimum(at, len(frequent) - 1)] == tokens
        rare, often = tokens[~often], tokens[often]
    else:
        rare, often = tokens, tokens[:0]
    if len(rare) >= p:
        return rare[:p], True
    ratio = math.log(100 / percent)
    band, keys = int(math.log(n) / ratio), [rare]
    for b in (band, band + 1):
        g = max(1, int(math.exp(b * ratio) * (100 - percent) / 400))
        head = often[: p - len(rare) + g]
        kind = mixed(head + np.uint64(1)) % np.uint64(g)
        order = np.argsort(kind, kind="stable")
        head, kind = head[order], kind[order]
        for d in range(1, int(np.bincount(kind.astype(np.int64)).max(initial=0))):
            same = kind[d:] == kind[:-d]
            x, y = head[:-d][same], head[d:][same]
            keys.append(mixed(np.minimum(x, y) * MULTIPLIERS[0] + mixed(np.maximum(x, y)) + np.uint64(b)))
    return np.concatenate(keys), False


def _codes(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """What tokens are counted by: the range of the hash, and its low 32 bits."""
    return (((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)) << np.uint64(32) | (tokens & np.uint64(0xFFFFFFFF))


def _ranges(docs: DataFrame) -> int:
    return min(MOST_RANGES, max(64, 16 * docs.rdd.getNumPartitions()))


def _sets(docs: DataFrame, words: int, ranges: int) -> DataFrame:
    """(doc_id, n, sig, range, codes): a row per document with its set's size and 128-bit signature, and rows with the tokens of a
    range that a task has seen, in order, as compressed differences (some three bytes a token)."""

    def run(batches):
        seen, size, pack = [], 0, zstandard.ZstdCompressor(1).compress

        def counted():
            codes = _codes(np.concatenate(seen), ranges)
            codes.sort()
            cuts = np.searchsorted(codes >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
            own = np.flatnonzero(np.diff(cuts))
            low = codes.astype(np.uint32)
            blobs = [pack(np.diff(low[a:b], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()) for a, b in zip(cuts[own].tolist(), cuts[own + 1].tolist())]
            none = [pa.nulls(len(own), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(own, pa.int64()), pa.array(blobs, pa.binary())], names)

        names = ["doc_id", "n", "sig", "range", "codes"]
        for batch in batches:
            sizes, sigs = [], []
            for s in shingle_sets(batch.column("text"), words):
                sizes.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.data) if len(s) else None)
                seen.append(s)
                size += len(s)
                if size > BLOCK_TOKENS:
                    yield counted()
                    seen, size = [], 0
            none = [pa.nulls(len(sizes), t) for t in (pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), *none], names)
        if size:
            yield counted()

    return docs.mapInArrow(lean(run), "doc_id long, n long, sig binary, range long, codes binary")


def _frequent(sets: DataFrame):
    """The frequent class as a broadcast of codes, sorted, MOST_FREQUENT at most. Counts are over all documents; a range is counted in one task."""
    least = FREQUENT

    def count(table: pa.Table) -> pa.Table:
        unpack, parts = zstandard.ZstdDecompressor().decompress, []
        for blob in table.column("codes").to_pylist():
            parts.append(np.cumsum(np.frombuffer(unpack(blob), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32))
        low, counts = np.unique(np.concatenate(parts), return_counts=True)
        code = low[counts >= least].astype(np.int64) | (table.column("range")[0].as_py() << 32)
        return pa.table({"code": code, "n": counts[counts >= least].astype(np.int64)})

    counts = sets.filter(F.col("codes").isNotNull()).select("range", "codes").groupBy("range").applyInArrow(count, "code long, n long")
    often = counts.orderBy(F.col("n").desc(), "code").limit(MOST_FREQUENT).select("code").toArrow()["code"].to_numpy()
    return sets.sparkSession.sparkContext.broadcast(np.sort(often.astype(np.uint64)))


def _keys(docs: DataFrame, frequent, ranges: int, words: int, percent: int) -> DataFrame:
    """(doc_id, n, keys): n is the set's size, negative where frequent tokens had to fill the prefix; keys are 8 bytes each."""

    def run(batches):
        known = frequent.value
        for batch in batches:
            sizes, keys = [], []
            for s in shingle_sets(batch.column("text"), words):
                often = s[:0]
                if len(s) and len(known):
                    codes = _codes(s, ranges)
                    often = s[known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes]
                own, full = index_keys(s, often, percent) if len(s) else (s, True)
                sizes.append(len(s) if full else -len(s))
                keys.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "n", "keys"])

    return docs.mapInArrow(lean(run), "doc_id long, n int, keys binary")


def _small(batches, some: int = 500):
    """Batches of some rows each: what is made of one is held at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, some):
            yield batch.slice(start, some)


def _rows_of(batch: pa.RecordBatch, some: int = 500):
    """(key, doc_id, n) as numpy arrays, a row for each key, of some documents at a time."""
    for start in range(0, batch.num_rows, some):
        part = batch.slice(start, some)
        own = part.column("keys").to_pylist()
        at = np.repeat(np.arange(len(own)), [len(k) // 8 for k in own])
        yield np.frombuffer(b"".join(own), np.int64), part.column("doc_id").to_numpy()[at], part.column("n").to_numpy()[at]


def _hot(keys: DataFrame):
    """Keys of very many documents as a broadcast: sorted keys, their leaders, and the leaders' n."""

    def run(batches):
        held, size = [], 0

        def found():
            key, doc, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, key))
            key, doc, n = key[order], doc[order], n[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            counts = np.diff(np.r_[starts, len(key)])
            some = starts[counts >= LOCAL_HOT]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[some], counts[counts >= LOCAL_HOT], doc[some], n[some])], ["key", "count", "doc_id", "n"])

        for batch in batches:
            for rows in _rows_of(batch):
                held.append(rows)
                size += len(rows[0])
                if size > BLOCK_TOKENS:
                    yield found()
                    held, size = [], 0
        if size:
            yield found()

    seen = keys.mapInArrow(lean(run), "key long, count long, doc_id long, n int")
    hot = seen.groupBy("key").agg(F.sum("count").alias("count"), F.min(F.struct("doc_id", "n")).alias("leader")).filter(F.col("count") >= HOT)
    hot = hot.orderBy(F.col("count").desc(), "key").limit(MOST_FREQUENT).select("key", "leader.doc_id", "leader.n")
    with small_batches(keys.sparkSession):
        hot = hot.toArrow().sort_by("key")
    return keys.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("key", "doc_id", "n")))


def _index(keys: DataFrame, hot) -> DataFrame:
    """A row (key, doc_id, n) for each key that is not hot."""

    def run(batches):
        known = hot.value[0]
        for batch in batches:
            for key, doc, n in _rows_of(batch):
                cold = ~np.isin(key, known)
                yield pa.RecordBatch.from_arrays([pa.array(x[cold]) for x in (key, doc, n)], ["key", "doc_id", "n"])

    return keys.mapInArrow(lean(run), "key long, doc_id long, n int")


def _hot_meetings(keys: DataFrame, hot) -> DataFrame:
    """Documents with hot keys meet the leaders of these, as in _meetings()."""

    def run(batches):
        known, leader, size = hot.value
        for batch in batches:
            for key, doc, n in _rows_of(batch):
                if not len(known):
                    break
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                at, doc, n = at[hit], doc[hit], n[hit]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (leader[at], doc, size[at], n)] + [pa.array(np.full(len(doc), True))], MEETING)

    return keys.mapInArrow(lean(run), "a long, b long, na int, nb int, star boolean")


MEETING = ["a", "b", "na", "nb", "star"]


def _meetings(rows: DataFrame) -> DataFrame:
    """Documents that meet under a key: (a, b, na, nb, star), a <= b. Rows come sorted by key and doc_id; groups stream through.

    Of a group of SMALL documents at most all pairs; of a larger one each document with the leader (the first), the leader itself included.
    """

    def out(a, b, na, nb, star):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, na, nb)] + [pa.array(np.full(len(a), star))], MEETING)

    def run(batches):
        held, leader = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], None
        for batch in _and_end(batches):
            if batch is not None:
                held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "doc_id", "n"))]
            key, doc, n = held
            if not len(key):
                continue
            # Groups that are complete; the last one may go on in the next batch.
            end = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            if leader is not None:  # a large group goes on
                more = int(np.searchsorted(key, leader[0], "right"))
                if more:
                    yield out(np.full(more, leader[1]), doc[:more], np.full(more, leader[2], np.int32), n[:more], True)
                    key, doc, n = key[more:], doc[more:], n[more:]
                    end = max(0, end - more)
                if len(key):
                    leader = None
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(key)])
            group = np.repeat(np.arange(len(starts)), sizes)
            small = np.repeat(sizes <= SMALL, sizes)
            done = np.arange(len(key)) < end
            for d in range(1, SMALL):
                hit = np.flatnonzero((group[d:] == group[:-d]) & small[d:] & done[d:])
                if not len(hit):
                    break
                hit = hit[doc[hit] != doc[hit + d]]
                yield out(doc[hit], doc[hit + d], n[hit], n[hit + d], False)
            large = np.flatnonzero(~small)  # complete or not
            if len(large):
                first = starts[group[large]]
                yield out(doc[first], doc[large], n[first], n[large], True)
            if batch is not None and len(key) and not small[-1]:
                leader, end = (key[-1], doc[starts[-1]], n[starts[-1]]), len(key)
            held = [key[end:], doc[end:], n[end:]]

    return rows.sortWithinPartitions("key", "doc_id").mapInArrow(lean(run), "a long, b long, na int, nb int, star boolean")


def _and_end(batches):
    yield from batches
    yield None


def _candidates(meetings: DataFrame, percent: int, n: int) -> DataFrame:
    """Distinct pairs (a, b) of n meetings that sizes and counts of shared keys do not exclude; those of large groups with their leader stay all (star).

    Where rare tokens fill both prefixes, the shared keys are the tokens shared within the prefixes, and at most
    ceil(share * n) - 1 of the larger set can be shared beyond; keys in large groups are counted as if shared.
    """
    counts = meetings.filter("not star").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    stars = meetings.filter("star")
    big = stars.groupBy(F.col("b").alias("doc_id")).agg(F.count(F.lit(1)).alias("big"))
    x, y = F.abs("na"), F.abs("nb")
    counts = in_parts(counts.withColumns({"x": F.least(x, y).cast("long"), "y": F.greatest(x, y).cast("long")}).filter(f"100 * x >= {percent} * y"), n)
    for side in ("a", "b"):
        counts = counts.join(big.withColumnsRenamed({"doc_id": side, "big": f"big_{side}"}), side, "left")
    most = F.col("c") + F.least(F.coalesce("big_a", F.lit(0)), F.coalesce("big_b", F.lit(0)))
    kept = counts.filter((F.col("na") < 0) | (F.col("nb") < 0) | (most >= _needed("x", "y", percent)))
    both = kept.select("a", "b", F.lit(False).alias("star")).unionByName(stars.filter("a <> b").select("a", "b", "star"))
    return both.groupBy("a", "b").agg(F.max("star").alias("star"))


def _verified(pairs: DataFrame, tokens: DataFrame, n: int) -> DataFrame:
    """The n pairs (a, b, star) with both and one: sizes of intersection and union."""

    def run(batches):
        for batch in _small(batches):
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            both, one = [], []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                merged = np.concatenate([p, q])
                merged.sort(kind="stable")
                both.append(int((merged[1:] == merged[:-1]).sum()))
                one.append(len(p) + len(q) - both[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "star")), pa.array(both, pa.int64()), pa.array(one, pa.int64())], ["a", "b", "star", "both", "one"])

    x, y = tokens.toDF("a", "x"), tokens.toDF("b", "y")
    # Pairs grow with the corpus: they are never broadcast, at any size.
    joined = pairs.hint("merge").join(x.hint("merge"), "a").hint("merge").join(y.hint("merge"), "b").select("a", "b", "star", "x", "y")
    return in_parts(joined, n, PAIRS_A_PART).mapInArrow(lean(run), "a long, b long, star boolean, both long, one long")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Components of documents whose shingle sets have 100 * |intersection| >= percent * |union|: doc_id, n_shingles, component_id for every row of docs.

    component_id is the smallest doc_id reachable by links, its own included. Null, empty and blank texts have no
    set and are linked with nothing. Rows that repeat a doc_id are one document in the graph: a link of any of them
    counts. Rows without doc_id are linked with nothing (component_id null). Other columns are not read; no rows give no rows.
    Tokens and set signatures are hashes of 64 and 128 bits.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ngramjoin")
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    ranges = _ranges(docs)
    sets = work.write(_sets(docs, words, ranges), "sets")
    frequent = _frequent(sets)
    rows = work.write(sets.filter(F.col("codes").isNull()).select("doc_id", "n", "sig"), "documents")
    total = rows.count()
    work.drop("sets")
    named = rows.filter(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    first = work.write(in_parts(named.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), total), "classes")
    # What need not be indexed: copies but for each class's first. Ids that repeat may be both; then they are indexed.
    copies = named.join(first.filter("copies > 1"), "sig").filter("doc_id <> rep").select("doc_id").distinct()
    repeats = _repeats(rows)
    copies = copies.join(first.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_anti") if repeats else copies
    several = named.groupBy("doc_id").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).filter("x <> y").select("doc_id") if repeats else None
    copies = work.write(in_parts(copies, total), "copies")
    texts = docs.filter(F.col("doc_id").isNotNull())
    meetings, judged = _round(work, "first", texts, copies, (frequent, ranges), None, words, percent)
    near = F.col("both") * 100 >= F.col("one") * percent
    roots = connected_components(judged.filter(near).select("a", "b"), work, "first-roots")
    open_ = work.write(in_parts(_open_members(meetings, judged, roots, several).select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), total), "open")
    work.drop("first-meetings", "first-tokens")
    if not open_.isEmpty():
        texts = work.write(texts.join(open_, "doc_id", "left_semi").join(copies, "doc_id", "left_anti"), "texts")
        ranges = _ranges(texts)
        meetings, judged = _round(work, "second", texts, None, (_frequent(_sets(texts, words, ranges)), ranges), roots, words, percent)
        roots = merged_components(roots, judged.filter(near).select("a", "b"), work, "second-roots")
        members = work.write(in_parts(_open_members(meetings, judged, roots, several), meetings.count()), "members")
        asked = members.join(work.write(in_parts(_open_documents(members, percent), members.count()), "asked"), ["a", "b"], "left_semi")
        tokens = _token_sets(texts.join(asked.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi"), words)
        roots = merged_components(roots, _open_links(asked.join(tokens.toDF("b", "tokens"), "b"), percent), work, "roots")
    roots = roots.toDF("rep", "root")
    classes = first.select("sig", "rep").join(roots, "rep", "left").select("sig", F.coalesce("root", "rep").alias("root"))
    out = rows.join(work.write(in_parts(classes, total), "roots-of-classes"), "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def _round(work: Workspace, name: str, texts: DataFrame, copies: DataFrame | None, frequent: tuple, roots: DataFrame | None, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(meetings, verified pairs) of texts, but those of copies. Pairs that are in one component of roots already are left out."""
    keys = _keys(texts, *frequent, words, percent)
    keys = work.write(keys if copies is None else keys.join(copies, "doc_id", "left_anti"), f"{name}-keys")
    hot = _hot(keys)
    n = keys.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    index = in_parts(_index(keys, hot).repartition(_partitions(work.spark, n), "key"), n // 8, 500_000)
    meetings = work.write(_meetings(index).unionByName(_hot_meetings(keys, hot)), f"{name}-meetings")
    work.drop(f"{name}-keys")
    n = meetings.count()
    pairs = _candidates(meetings, percent, n)
    if roots is not None:
        for side in ("a", "b"):
            pairs = pairs.join(roots.toDF(side, f"root_{side}"), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
        pairs = pairs.filter("root_a <> root_b").select("a", "b", "star")
    pairs = work.write(in_parts(pairs, n), f"{name}-pairs")
    n = pairs.count()
    ids = work.write(in_parts(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), n), f"{name}-ids")
    tokens = work.write(_token_sets(texts.join(ids, "doc_id", "left_semi"), words), f"{name}-tokens")
    return meetings, work.write(_verified(pairs, tokens, n), f"{name}-judged")


def _repeats(rows: DataFrame) -> bool:
    return not rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").isEmpty()


def _partitions(spark, total: int) -> int:
    """A million index rows a partition; total: bytes of keys."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 8_000_000 + 1)


def _token_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in _small(batches):
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], ["doc_id", "tokens"])

    return docs.mapInArrow(lean(run), "doc_id long, tokens binary")


def _open_members(meetings: DataFrame, first_links: DataFrame, roots: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """Documents of leaders' groups that hold several components, but the leaders (judged already): a, b, d (distance to the leader),
    root, n, big (keys in large groups), rest (whether outside the group's largest component), and block (of so many blocks).
    several has the ids that repeat with another set, if any: a distance to or from one of these is of one of its sets only, and is no bound (null)."""
    stars = meetings.filter("star")
    # A document whose id repeats with another text has no bound (n = 0).
    size = F.when(F.min("nb") == F.max("nb"), F.min("nb")).otherwise(0)
    docs = stars.groupBy("b").agg(size.alias("n"), F.count(F.lit(1)).alias("big"))
    distance = first_links.groupBy("a", "b").agg(F.min(1 - F.col("both") / F.col("one")).alias("d"))
    members = stars.select("a", "b").distinct().join(distance, ["a", "b"], "left").withColumn("d", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("d")))
    if several is not None:
        for side in ("a", "b"):
            members = members.join(several.select(F.col("doc_id").alias(side), F.lit(True).alias("several")), side, "left").withColumn("d", F.when(F.col("several").isNull(), F.col("d"))).drop("several")
    n = meetings.count()
    members = in_parts(members, n).join(docs, "b").join(roots.toDF("b", "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    members = in_parts(members, n)
    groups = members.groupBy("a", "root").agg(F.count(F.lit(1)).alias("k"))
    largest = groups.groupBy("a").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.count(F.lit(1)).alias("components"), F.sum("k").alias("size"))
    members = members.join(largest.filter("components > 1"), "a").filter("a <> b").withColumn("rest", F.col("root") != F.col("largest"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return members.select("a", "b", "d", "root", "n", "big", "rest", blocks.alias("blocks"), F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"))


def _meet_in_blocks(members: DataFrame, fn, schema: str) -> DataFrame:
    """fn(rest, members) for every block of a group's documents outside its largest component and every block of all of them."""
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left, right = members.toDF(*members.columns), members.toDF(*members.columns)  # columns of their own
    left = left.filter("rest").withColumnRenamed("block", "x").withColumn("y", every)
    right = right.withColumnRenamed("block", "y").withColumn("x", every)
    return left.groupBy("a", "x", "y").cogroup(right.groupBy("a", "x", "y")).applyInPandas(fn, schema)


def _open(one: pd.Series, many: pd.DataFrame, percent: int) -> np.ndarray:
    """Which of many rows may be linked with one, by component, sizes, distances to the leader, and shared keys.

    A pair that shares a key of a small group has been judged already. So where rare tokens fill both prefixes, the
    keys that a pair shares are all of large groups, and each of the two has as many of these as the sizes ask for.
    """
    n, sizes = abs(one.n), many["n"].abs().to_numpy().astype(np.int64)
    x, y = np.minimum(n, sizes), np.maximum(n, sizes)
    known = (x > 0) & (one.n > 0) & (many["n"].to_numpy() > 0)
    needed = -(-percent * (x + y) // (100 + percent)) + (-percent * y // 100) + 1
    gap = np.abs(many["d"].to_numpy(dtype=float) - (np.nan if one.d is None else one.d))
    return (
        (many["root"].to_numpy() != one.root) & ((x == 0) | (100 * x >= percent * y)) & ~(gap > 1 - percent / 100 + 1e-9)
        & (~known | (np.minimum(one.big, many["big"].to_numpy()) >= needed))
    )


def _open_documents(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members that take part in any pair that no bound excludes."""

    def run(rest: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        hit, own = np.zeros(len(many), bool), []
        for one in rest.itertuples(index=False):
            may = _open(one, many, percent)
            hit |= may
            if may.any():
                own.append(one.b)
        both = pd.Series(own + many["b"][hit].tolist(), dtype="int64").unique()
        return pd.DataFrame({"a": (many if len(many) else rest)["a"].iloc[0], "b": both}) if len(both) else pd.DataFrame({"a": [], "b": []}).astype("int64")

    return _meet_in_blocks(members, run, "a long, b long").distinct()


def _open_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): one link from each document outside the largest component to each component that it is linked with. members have tokens."""

    def run(rest: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rest) and len(many):
            sets = [np.frombuffer(t, np.uint64) for t in many["tokens"]]
            lengths = np.array([len(x) for x in sets])
            tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            for one in rest.itertuples(index=False):
                may, own = _open(one, many, percent), np.frombuffer(one.tokens, np.uint64)
                if not may.any():
                    continue
                low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
                spans = high - low
                at = np.repeat(low - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                near = np.flatnonzero(may & (100 * both >= percent * (len(own) + lengths - both)))
                seen = set()
                for k in near:
                    if (root := many["root"].iat[k]) not in seen:
                        seen.add(root)
                        found.append((one.b, many["b"].iat[k]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return _meet_in_blocks(members, run, "a long, b long")


def _needed(x: str, y: str, percent: int):
    """How many keys two sets of x <= y rare-prefixed tokens share at least if they are similar: the least intersection, less what can be shared beyond the prefixes."""
    ceil = lambda v, by: F.expr(f"cast(ceil(cast({v} as decimal(20,0)) / {by}) as long)")
    return ceil(f"{percent} * ({x} + {y})", 100 + percent) - ceil(f"{percent} * {y}", 100) + 1


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id, in the columns of docs.

    Documents without words (null, empty, blank), and rows without doc_id, all stay; rows that repeat the doc_id that stays stay too. Columns may have any names; no rows give no rows.
    """
    found = jaccard_components(docs.select("doc_id", "text"), words, percent)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    gone = Workspace(docs.sparkSession, "oneofeach").write(gone, "gone")
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = docs.toDF(*names).join(gone, F.col(names[docs.columns.index("doc_id")]).cast("long") == F.col("doc_id"), "left_anti")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
