"""Exact top-k search by inner product, with a pivot table.

Pivots come from a bounded sample; every vector's distances to all pivots are computed once and kept with
it (the pivot table). For a query q and a candidate x each pivot p gives d(q, x) >= |d(q, p) - d(x, p)|;
the maximum over pivots bounds the distance from below, and with q.x = (|q|^2 + |x|^2 - d^2) / 2 the inner
product from above. Candidates are evaluated in the order of their bounds until no bound reaches the k-th
best score: the result is exact.

Queries and candidates are dealt into blocks, and every block of queries meets every block of candidates
in a task of its own, which returns k rows a query; the best of these are the result. Sizes of blocks
bound a task's memory, whatever the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

PIVOTS, PIVOT_SAMPLE, QUERY_BLOCK, ROW_BLOCK, BATCH = 24, 2048, 2048, 16_384, 512
SCALE = 256
_LONG = np.iinfo(np.int64)


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v = floor(scale * x) of each component (array of double, whole numbers); vectors that are null
    or hold a null or non-finite component, and rows without vec_id, are left out. An empty vector stays, with no components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() of a double is a long in Spark; larger components keep their own value, which has no fraction.
    v = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 2.0**52 / scale, F.floor(x.cast("double") * F.lit(float(scale))).cast("double")).otherwise(x.cast("double") * F.lit(float(scale))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), v.alias("v"))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Pivots by farthest-first choice among the `sample` vectors whose ids hash lowest (the documented bound)."""
    rows = vectors.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(sample).select("v").collect()
    if not rows:
        return np.zeros((0, 1))
    m = _matrix([r[0] for r in rows])
    chosen, far = [0], np.full(len(m), np.inf)
    while len(chosen) < min(pivots, len(m)):
        far = np.minimum(far, ((m - m[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return m[chosen]


def _matrix(rows, width: int = 0) -> np.ndarray:
    """Rows as a matrix of doubles; shorter ones are filled up with zeros, which add nothing to an inner product."""
    width = max([width, *(len(r) for r in rows)])
    if all(len(r) == width for r in rows):
        return np.array([np.asarray(r, dtype=np.float64) for r in rows]).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(m.shape[1], pivots.shape[1])
    a, p = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (m, pivots))
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * a @ p.T, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows, as int64: exact in doubles where sums stay below 2^53, else in whole numbers of any size, held at the ends of long."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.size < 2.0**53:
        return (x @ q).astype(np.int64)
    exact = (sum(int(a) * int(b) for a, b in zip(row, q)) for row in x)
    return np.array([min(max(s, int(_LONG.min)), int(_LONG.max)) for s in exact], dtype=np.int64)


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of the block for each query, by bounds."""
    width = max(*(len(v) for v in queries["v"]), *(len(v) for v in rows["v"]))
    q, x = _matrix(list(queries["v"]), width), _matrix(list(rows["v"]), width)
    dq, dx = (np.array([np.asarray(d) for d in t["d"]]).reshape(len(t), -1) for t in (queries, rows))
    ids, nx = rows["vec_id"].to_numpy(), (x**2).sum(1)
    by_pivot = np.ascontiguousarray(dx.T)
    out = []
    for i, own in enumerate(queries["vec_id"]):
        low = np.zeros(len(x))
        for p, d in enumerate(by_pivot):
            np.maximum(low, np.abs(d - dq[i, p]), out=low)
        nq = (q[i] ** 2).sum()
        scale = math.sqrt(max(nq, nx.max(initial=0.0))) + 1
        low = np.maximum(low - 1e-6 * scale, 0)  # more than the distances' rounding, which is below 1e-7 of the norms
        bound = (nq + nx - low * low) / 2
        bound = bound + 1e-9 * np.abs(bound) + 1
        bound[ids == own] = -np.inf
        best_s, best_i, left = np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(x))
        while len(left):
            take = min(BATCH, len(left))
            cut = np.argpartition(-bound[left], take - 1)
            now, left = left[cut[:take]], left[cut[take:]]
            now = now[np.isfinite(bound[now])]
            s, c = np.concatenate([best_s, _scores(q[i], x[now])]), np.concatenate([best_i, ids[now]])
            top = np.lexsort((c, -s.astype(np.float64) if len(s) and np.abs(s).max() < 2**53 else np.array([-int(v) for v in s], dtype=object)))[:k]
            best_s, best_i = s[top], c[top]
            if len(best_s) == k:  # equal bounds stay: a tie may have the smaller id
                left = left[bound[left] >= best_s[-1]]
            else:
                left = left[np.isfinite(bound[left])]
        out.append(pd.DataFrame({"query_id": own, "vec_id": best_i, "score": best_s}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The k rows of highest integer inner product for every query row: query_id, rank (from 1), vec_id, score.

    rows and queries have vec_id and embedding; other columns are not read. Vectors that are null or
    hold null or non-finite components take no part on either side; shorter vectors count as filled up with
    zeros, so an empty one scores 0 with all. A query is not its own candidate: no row with its vec_id is. Ties go to the smaller vec_id. Rows
    that repeat a vec_id are candidates each, and a repeated query counts once. Fewer than k candidates: all. No
    queries or no candidates: no rows. Scores beyond the range of long are held at its ends.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "topk")
    base = integer_vectors(rows, scale)
    chosen = choose_pivots(base, pivots)
    width = chosen.shape[1]

    def with_distances(batches):
        for pdf in batches:
            if len(pdf):
                m = _matrix(list(pdf["v"]), width)
                pdf["d"] = list(_distances(m, chosen))
                yield pdf

    schema = "vec_id long, v array<double>, d array<double>"
    index = work.write(base.mapInPandas(with_distances, schema), "pivots")
    asked = work.write(integer_vectors(queries, scale).dropDuplicates(["vec_id"]).mapInPandas(with_distances, schema), "queries")
    n, m = index.count(), asked.count()
    row_blocks, query_blocks = max(1, math.ceil(n / row_block)), max(1, math.ceil(m / query_block))
    if n > 1000:  # enough blocks to keep every core of a small cluster at work
        row_blocks = max(row_blocks, min(24, n // 1000))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = index.withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    left, right = (t.select(F.col("qb").cast("int"), F.col("rb").cast("int"), "vec_id", "v", "d") for t in (left, right))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best(a, b, k) if len(a) and len(b) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
