"""Graphs of sentences: construction, adjacency, random walks, retrofitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors as vec
from textloom.operators.shared import Tables
from textloom.operators.spaces import neighbours

#: Rows of alias tables made in one task, edges of a node in one table, and proposals that a step makes at once.
ALIAS_ROWS = 100_000
PART_EDGES = 100_000
TRIES = 4


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge (a, b, weight) both ways, once; of several weights the largest."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def context_graph(vectors: DataFrame, k: int = 20, intra: float = 0.8, inter: float = 0.5) -> DataFrame:
    """``a, b, weight`` with a < b: each sentence (``id, doc, v``) with its k most similar, by thresholds that
    depend on whether they share a document; united over both ends."""
    found = neighbours(vectors, vectors, k, doc=True, intra=intra, inter=inter)
    pairs = found.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), F.col("score").alias("weight"))
    return pairs.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def with_all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, degree`` for every node; isolated ones have degree 0."""
    degrees = undirected(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").join(degrees, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def padded_adjacency(edges: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """``keys, node, neighbours, weights``: lists by neighbour, padded with (-1, 0.0) to the largest degree (or ``width``)."""
    lists = edges.groupBy(*keys, F.col("a").alias("node")).agg(F.array_sort(F.collect_list(F.struct("b", "weight"))).alias("l"))
    if width is None:
        width = lists.agg(F.max(F.size("l"))).first()[0] or 0
    pad = F.greatest(F.lit(width) - F.size("l"), F.lit(0))
    return lists.select(
        *keys, "node", F.concat(F.transform("l", lambda e: e["b"].cast("long")), F.array_repeat(F.lit(-1).cast("long"), pad)).alias("neighbours"),
        F.concat(F.transform("l", lambda e: e["weight"].cast("double")), F.array_repeat(F.lit(0.0), pad)).alias("weights"),
    )


def document_graph(vectors: DataFrame, threshold: float) -> DataFrame:
    """``doc, a, b, weight``: pairs within a document (a sentence with itself too) of an inner product of at least the threshold."""
    a, b = (vectors.select("doc", F.col("id").alias(n), F.col("v").alias(f"v{n}")) for n in "ab")
    return a.join(b, "doc").select("doc", "a", "b", vec.dot(F.col("va"), F.col("vb")).alias("weight")).filter(F.round("weight", 9) >= threshold)


def with_lexicon(edges: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sentence edges and synonym edges (``src, dst``) in one table, told apart by ``kind``."""
    own = edges.select(F.lit("sentence").alias("kind"), F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), "weight")
    return own.unionByName(lexicon.select(F.lit("lexicon").alias("kind"), "src", "dst", F.lit(1.0).alias("weight")))


def vose(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance, other) of each of n slots: a uniform slot gives itself with its chance, else the other, and so each place in proportion to its weight."""
    n = len(weights)
    chance, other = weights * (n / weights.sum()), np.arange(n)
    small, large = [int(k) for k in np.flatnonzero(chance < 1)], [int(k) for k in np.flatnonzero(chance >= 1)]
    while small and large:
        low, high = small.pop(), large[-1]
        other[low] = high
        chance[high] -= 1 - chance[low]
        if chance[high] < 1:
            small.append(large.pop())
    chance[small + large] = 1.0  # what rounding left over
    return chance, other


def alias_tables(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """``keys, slot, size, item, chance, other``: an alias table for each group of ``keys, item, weight``, one row a slot (from 0).

    Groups are dealt by a hash to tasks of some ALIAS_ROWS rows; weights of 0 or less are left out.
    """
    rows = rows.select(*keys, item, F.col("weight").cast("double").alias("weight")).filter("weight > 0")
    tasks = max(1, -(-rows.count() // ALIAS_ROWS))
    kind = {c: rows.schema[c].dataType.simpleString() for c in (*keys, item)}

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by([(c, "ascending") for c in (*keys, item)])
        new = np.ones(own.num_rows, bool)
        new[1:] = np.any([pc.not_equal(own.column(c)[1:], own.column(c)[:-1]).to_numpy(zero_copy_only=False) for c in keys], axis=0)
        at = np.append(np.flatnonzero(new), own.num_rows)
        weights = own.column("weight").to_numpy()
        chance, other = np.empty(own.num_rows), np.empty(own.num_rows, np.int64)
        for lo, hi in zip(at, at[1:]):
            chance[lo:hi], there = vose(weights[lo:hi])
            other[lo:hi] = there + lo
        size = np.repeat(np.diff(at), np.diff(at))
        slot = np.arange(own.num_rows) - np.repeat(at[:-1], np.diff(at))
        return pa.table([*[own.column(c) for c in keys], pa.array(slot), pa.array(size), own.column(item), pa.array(chance), own.column(item).take(pa.array(other))], names=[*keys, "slot", "size", item, "chance", "other"])

    dealt = rows.withColumn("task_", F.pmod(F.xxhash64(*keys), F.lit(tasks)))
    schema = ", ".join([*[f"{c} {kind[c]}" for c in keys], "slot long, size long", f"{item} {kind[item]}", f"chance double, other {kind[item]}"])
    return dealt.groupBy("task_").applyInArrow(run, schema)


def random_walks(edges: DataFrame, per_node: int = 10, length: int = 6, p: float = 0.4, q: float = 0.5, seed: int = 1) -> DataFrame:
    """``start, walk, path``: biased second-order walks over the undirected graph (``a, b, weight``), ``per_node`` from each node.

    A step weighs an edge's weight over p to go back, as it is to stay beside the node before, over q to move on.  It proposes
    neighbours in proportion to the edges' weights, from the node's alias table, and takes the first that passes a draw of its bias over the largest bias, which
    gives exactly the biased shares.  A proposal is a join on (node, slot), so walks at a node of many edges meet its slots spread over all tasks, and
    never all its edges; nodes of more than PART_EDGES edges draw a part first.  Walks without a neighbour accepted propose again, until
    all have one.  Every step is a written table; draws are hashes of seed, walk, step and proposal, so reruns agree.
    """
    tables = Tables(edges.sparkSession, "walks")
    both = tables.put(undirected(edges).filter("weight > 0"), "edges")
    degrees = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    parts = tables.put(degrees.select("node", F.ceil(F.col("degree") / PART_EDGES).cast("int").alias("parts")), "parts")
    dealt = both.join(parts.withColumnRenamed("node", "a"), "a").select(F.col("a").alias("node"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.col("b").alias("item"), "weight")
    dealt = tables.put(dealt, "dealt")
    slots = tables.put(alias_tables(dealt, ["node", "part"], "item"), "slots")
    sizes = slots.filter("slot = 0").select("node", "part", "size").join(parts, "node")
    whole = tables.put(sizes.filter("parts = 1").select("node", "size"), "whole")
    split = dealt.join(parts.filter("parts > 1"), "node", "left_semi").groupBy("node", "part").agg(F.sum("weight").alias("weight"))
    split = tables.put(alias_tables(split, ["node"], "part").join(sizes.select("node", F.col("part").alias("p_"), F.col("size").alias("s_")), "node").groupBy("node", "slot", "size", "part", "chance", "other").agg(
        F.max(F.when(F.col("p_") == F.col("part"), F.col("s_"))).alias("own_size"), F.max(F.when(F.col("p_") == F.col("other"), F.col("s_"))).alias("other_size")), "split")
    any_split = not split.isEmpty()
    beside = both.select(F.col("a").alias("before"), F.col("b").alias("next"), F.lit(True).alias("near"))
    most = max(1.0, 1 / p, 1 / q)

    def u(name: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}-{name}"), "start", "walk", "step", "try"), 11) / F.lit(float(1 << 53))

    def located(rows: DataFrame) -> DataFrame:
        """rows with the part and its size in which their node's slot is drawn."""
        found = rows.join(whole.withColumnRenamed("node", "now"), "now").withColumn("part", F.lit(0))
        if not any_split:
            return found
        counts = parts.filter("parts > 1").select(F.col("node").alias("now"), F.col("parts").alias("slots"))
        drawn = rows.join(counts, "now").withColumn("slot", F.floor(u("part") * F.col("slots"))).join(split.withColumnRenamed("node", "now").drop("size"), ["now", "slot"])
        own = u("own part") < F.col("chance")
        drawn = drawn.select(*rows.columns, F.when(own, F.col("own_size")).otherwise(F.col("other_size")).alias("size"), F.when(own, F.col("part")).otherwise(F.col("other")).cast("int").alias("part"))
        return found.select(*rows.columns, "size", "part").unionByName(drawn)

    walks = parts.select(F.col("node").alias("start")).withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
    kind = both.schema["a"].dataType
    walks = walks.select("start", "walk", F.lit(None).cast(kind).alias("before"), F.col("start").alias("now"))
    steps = [walks.select("start", "walk", F.lit(0).alias("step"), F.col("start").alias("node"))]
    for step in range(1, length):
        waiting, tried, moved = walks.withColumn("step", F.lit(step)), 0, []
        while True:
            tries = 1 if step == 1 else TRIES
            asked = located(waiting.withColumn("try", F.explode(F.sequence(F.lit(tried), F.lit(tried + tries - 1)))))
            asked = asked.withColumn("slot", F.floor(u("slot") * F.col("size")))
            met = asked.drop("size").join(slots.withColumnRenamed("node", "now").drop("size"), ["now", "part", "slot"])
            met = met.withColumn("next", F.when(u("own") < F.col("chance"), F.col("item")).otherwise(F.col("other"))).drop("slot", "part", "item", "chance", "other")
            if step > 1:
                met = met.join(beside, ["before", "next"], "left")
                bias = F.when(F.col("next") == F.col("before"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
                met = met.filter(u("bias") * most < bias)
            taken = met.groupBy("start", "walk").agg(F.min_by(F.struct("now", "next"), "try").alias("m"))
            taken = tables.put(taken.select("start", "walk", F.col("m.now").alias("before"), F.col("m.next").alias("now")), f"taken-{step}-{tried}")
            moved.append(taken)
            if step == 1:
                break
            waiting = tables.put(waiting.join(taken.select("start", "walk"), ["start", "walk"], "left_anti"), f"waiting-{step}-{tried}")
            if waiting.isEmpty():
                break
            tried += tries
        walks = moved[0]
        for more in moved[1:]:
            walks = walks.unionByName(more)
        steps.append(walks.select("start", "walk", F.lit(step).alias("step"), F.col("now").alias("node")))
    every = steps[0]
    for more in steps[1:]:
        every = every.unionByName(more)
    paths = every.groupBy("start", "walk").agg(F.array_sort(F.collect_list(F.struct("step", "node"))).alias("l"))
    return paths.select("start", "walk", F.transform("l", lambda x: x["node"]).alias("path"))


def _smoothed(s: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int, alpha: float) -> np.ndarray:
    n = np.bincount(a, minlength=len(s)).astype(float)
    some, v = n > 0, s.copy()
    for _ in range(rounds):
        got = np.zeros_like(s)
        np.add.at(got, a, w[:, None] * v[b])
        v = np.where(some[:, None], (alpha * n[:, None] * s + got) / np.where(some, alpha * n + n, 1.0)[:, None], s)
    return v


def retrofit_groups(values: DataFrame, edges: DataFrame, rounds: int = 20, alpha: float = 1.0) -> DataFrame:
    """``g, id, v``: vectors (``g, id, v``) drawn towards their neighbours' (edges ``g, a, b, weight``, both ways) within groups.

    Each round sets v to ``(alpha n s + sum w v_j) / (alpha n + n)`` for n neighbours, from the round before; nodes
    without neighbours keep s, alpha of 0 or less counts as 1.  A group, a document say, is iterated in
    one task, so all rounds cost one shuffle; a graph that spans groups goes through ``corpus.retrofit``.
    """
    alpha = alpha if alpha > 0 else 1.0

    def run(values: pa.Table, edges: pa.Table) -> pa.Table:
        order = np.argsort(values.column("id").to_numpy(), kind="stable")
        ids = values.column("id").to_numpy()[order]
        if not len(ids):
            return values.select(["g", "id", "v"])
        s = np.stack(values.column("v").to_numpy(zero_copy_only=False)).astype(float)[order]
        a, b, w = (edges.column(c).to_numpy() for c in ("a", "b", "weight"))
        known = np.isin(a, ids) & np.isin(b, ids)
        a, b, w = np.searchsorted(ids, a[known]), np.searchsorted(ids, b[known]), w[known]
        v = _smoothed(s, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), rounds, alpha)
        return pa.table([values.column("g").take(pa.array(order)), pa.array(ids), pa.array(list(v), pa.list_(pa.float64()))], names=["g", "id", "v"])

    return values.select("g", "id", "v").filter(F.col("v").isNotNull()).groupBy("g").cogroup(edges.select("g", "a", "b", "weight").groupBy("g")).applyInArrow(run, "g long, id long, v array<double>")


def retrofit(values: DataFrame, edges: DataFrame, rounds: int = 20, alpha: float = 1.0) -> DataFrame:
    """``id, v, unit``: vectors (``id, v``) drawn towards their neighbours' (edges ``a, b`` and perhaps ``weight``, each way in a row of its own), and their unit copies.

    Each round sets v to ``(alpha n s + sum w v_j) / (alpha n + n)`` from the round before; a neighbour listed several times counts as often, nodes without
    neighbours keep s, rows without a vector are left out, and so are edges to unknown nodes.  Each round is one join of whole vectors with the edges and
    one mean a node, combined before the shuffle, and a written table.
    """
    tables, alpha = Tables(values.sparkSession, "retrofit"), alpha if alpha > 0 else 1.0
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    near = tables.put(edges.select(F.col("a").alias("id"), F.col("b").alias("to"), weight.alias("w")), "edges")
    first = tables.put(values.filter(F.col("v").isNotNull()).select("id", F.col("v").cast("array<double>").alias("s")), "first")
    now = first.select("id", F.col("s").alias("v"))
    dims = first.agg(F.max(F.size("s"))).first()[0] or 0
    for k in range(rounds):
        sent = near.join(now.select(F.col("id").alias("to"), "v"), "to").select("id", F.transform("v", lambda x: x * F.col("w")).alias("x"))
        means = sent.groupBy("id").agg(vec.mean(F.col("x"), dims).alias("m"))
        moved = F.zip_with("s", "m", lambda s, m: (alpha * s + m) / (alpha + 1.0))
        now = tables.put(first.join(means, "id", "left").select("id", F.when(F.col("m").isNull(), F.col("s")).otherwise(moved).alias("v")), f"round-{k}")
        tables.drop(f"round-{k - 1}")
    return now.select("id", "v", vec.normalised(F.col("v")).alias("unit"))


def retrofit_walks(values: DataFrame, walks: DataFrame, rounds: int = 20) -> DataFrame:
    """``id, v, unit``: as ``retrofit``, with all nodes that a walk (``start, path``) visits after its start as neighbours, as often as it does."""
    after = F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))
    return retrofit(values, walks.select(F.col("start").alias("a"), F.explode(after).alias("b")), rounds)


def diverse_ranks(ranks: DataFrame, edges: DataFrame, balance: float) -> DataFrame:
    """``doc_id, node, position``: greedy re-ranking of a document's nodes by rank and novelty.

    A node's rank place (0 the best) as a share of their number is weighed by ``balance``, its largest edge weight to a chosen
    node by ``1 - balance``; the first choice is the best rank, then always the smallest sum (ties: the better rank).
    """
    kind = ranks.schema["doc_id"].dataType.simpleString()

    def run(ranks: pa.Table, edges: pa.Table) -> pa.Table:
        node, rank = ranks.column("node").to_numpy(), ranks.column("rank").to_numpy()
        order = np.lexsort((node, -np.round(rank, 9)))
        names = node[order]
        at = {int(x): i for i, x in enumerate(names)}
        beside: list[list[tuple[int, float]]] = [[] for _ in names]
        for a, b, w in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), edges.column("weight").to_pylist()):
            if a in at and b in at:
                beside[at[a]].append((at[b], w))
        place, close, free = np.arange(len(names)) / max(len(names), 1), np.zeros(len(names)), np.ones(len(names), bool)
        chosen: list[int] = []
        while len(chosen) < len(names):
            cost = np.where(free, balance * place + (1 - balance) * close, np.inf)
            best = int(np.argmin(cost)) if chosen else 0
            chosen.append(best)
            free[best] = False
            for other, w in beside[best]:
                close[other] = max(close[other], w)
        doc = pa.array([ranks.column("doc_id")[0].as_py()] * len(names), ranks.schema.field("doc_id").type) if len(names) else ranks.column("doc_id").combine_chunks()
        return pa.table([doc, pa.array(names[chosen], pa.int32()), pa.array(np.arange(1, len(names) + 1), pa.int32())], names=["doc_id", "node", "position"])

    own = ranks.select("doc_id", F.col("node").cast("int").alias("node"), "rank")
    steps = edges.select(F.col("doc_id").alias("of"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "weight")
    return own.groupBy("doc_id").cogroup(steps.groupBy("of")).applyInArrow(run, f"doc_id {kind}, node int, position int")
