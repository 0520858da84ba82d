"""Connected components of links, by rounds of contraction in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, in_parts


def connected_components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, root) for every node of links (a, b): root is the component's smallest node.

    Each round draws a random priority for every node. A node goes to the neighbour of the least priority (or stays, if it is
    the least itself), then to where that one went, and links are contracted. Priorities are drawn anew each round, so about half of
    a chain's nodes go in a round in whatever order its ids stand: rounds grow with the logarithm of the number of nodes. A round's table has only
    nodes that still have links, so all rounds together cost little more than the first. Hubs are counted by partial aggregation. No links give no rows.
    """
    n = links.count()
    edges, steps = work.write(in_parts(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), n), f"{name}-edges0"), []
    n = edges.count()
    while not steps or n:
        k = len(steps)
        priority = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("to"))
        both = edges.union(edges.select("b", "a")).toDF("node", "next")
        best = both.groupBy("node").agg(F.min(priority("next")).alias("best"))
        parent = work.write(in_parts(best.select("node", F.least("best", priority("node"))["to"].alias("root")), n), f"{name}-parent{k}")
        up = parent.toDF("root", "up")
        step = work.write(in_parts(parent.join(up, "root").select("node", F.col("up").alias("root")), n), f"{name}-step{k}")
        moved = edges.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b").filter("ra <> rb")
        edges = work.write(in_parts(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), n), f"{name}-edges{k + 1}")
        n = edges.count()
        work.drop(f"{name}-parent{k}", f"{name}-edges{k}")
        steps.append(step)
    roots, nodes = steps[-1], steps[0].count()
    for step in reversed(steps[:-1]):
        top = roots.toDF("root", "top")
        roots = in_parts(step.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), nodes)
    roots = work.write(roots, f"{name}-roots")
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    least = work.write(in_parts(roots.join(least, "root").select("node", F.col("least").alias("root")), nodes), name)
    work.drop(*(f"{name}-step{k}" for k in range(len(steps))), f"{name}-edges{len(steps)}", f"{name}-roots")
    return least


def merged_components(roots: DataFrame, links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) as of connected_components() once further links are there; only the components that these join are gone through."""
    for side in ("a", "b"):
        links = links.join(roots.toDF(side, "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    nodes = roots.count()
    links = work.write(in_parts(links.filter("a <> b").select("a", "b"), nodes), f"{name}-links")
    if links.isEmpty():
        return roots
    moved = connected_components(links, work, f"{name}-moved")
    known = roots.join(moved.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return work.write(in_parts(known.unionByName(moved.join(roots.select("node"), "node", "left_anti")), nodes), name)
