"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch

#: Far more than the logarithm of any component's size.
MOST_ROUNDS = 200


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round links a node's larger neighbours to its smallest one, then its
    smaller neighbours likewise, until nothing changes; the number of rounds
    grows with the logarithm of the component's size.  Minima are combined
    before the shuffle, and no task collects a node's neighbours.  Every round is
    a written table, so lost executors cost one round at most.  Rounds end when a table's links are those of the one before, by their number and the
    sums of two 64-bit hashes of each; RuntimeError if MOST_ROUNDS do not suffice.
    """
    now = scratch.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before = None
    for k in range(1, MOST_ROUNDS + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(lower, "a")
        small = linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        now = scratch.put(small, f"{name}-{k}")
        sums = [F.sum(F.xxhash64(*keys).cast("decimal(20,0)")) for keys in (("a", "b"), ("b", F.lit(1), "a"))]
        state = tuple(now.agg(F.count(F.lit(1)), *sums).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not complete after {MOST_ROUNDS} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return scratch.put(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), f"{name}-roots")


def joined_components(roots: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, root`` as ``roots`` (of ``connected_components``, written) with further ``edges`` (a, b).

    The edges are followed between components only, so what is found already is not gone through again; where they join none,
    ``roots`` is returned as it is.
    """
    between = edges.select("a", "b")
    for side in ("a", "b"):
        between = between.join(roots.select(F.col("node").alias(side), F.col("root").alias("found")), side, "left")
        between = between.withColumn(side, F.coalesce("found", side)).drop("found")
    between = scratch.put(between.filter("a <> b").distinct(), f"{name}-between")
    if between.isEmpty():
        return roots
    merged = connected_components(between, scratch, name)
    moved = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return scratch.put(moved.unionByName(merged.join(roots, "node", "left_anti").select("node", "root")), f"{name}-joined")
