"""SimHash near-duplicates by a self-join of binary tries.

1. A text's fingerprint is the majority, bit by bit, over the 64-bit hashes of its word shingles.
2. The distinct fingerprints are the leaves of a binary trie.  Nodes are visited in pairs: a pair's children differ in one bit
   more or not, and a pair is given up once its differing bits exceed the budget.
3. To share the trie out, its bits are cut into blocks.  Two fingerprints within the budget agree in at least
   ``blocks - budget`` of them, so for each choice of so many blocks there is one trie with those blocks on top, in which the two stand below
   the same top node: only equal top nodes are paired, and each is a small trie of its own in some task.
   Top nodes with very many leaves are dealt into parts, and the parts' tries are joined two by two.
4. A task keeps a forest of the links it finds, not all pairs; links between tasks are joined by ``connected_components``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import Scratch, maybe_broadcast, pieces, short_batches, text_or_empty
from textloom.llm.components import connected_components

#: Leaves that meet in one task, and leaves of one top node above which it is dealt into parts.
TASK_LEAVES = 1 << 17
PART_LEAVES = 1 << 16
#: Fingerprints from which five blocks (ten tries, top nodes of some 26 bits) replace four (four tries, 16 bits).
MANY = 1 << 28
#: Node pairs visited at once, and leaf pairs of two nodes few enough to be compared directly.
PAIRS = 1 << 14
LEAF_PAIRS = 64
#: Hashes whose bits are counted at once.
HASHES = 1 << 16


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of each word shingle, repeats included; of all words if there are fewer; none without words."""
    import xxhash

    words = text.lower().split()  # of bytes: only A-Z change, and blanks are exactly \x20 and \x09-\x0D
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(width)))), repeat(seed)))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at : at + HASHES]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: a signed 64-bit fingerprint of each row's text, 0 for a text without words."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1)):
                found[i] = majority(np.array(shingle_hashes(text.as_py(), width, seed), dtype="<u8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return own.mapInArrow(run, T.StructType([own.schema["doc_id"], T.StructField("fp", T.LongType())]))


def close_leaves(x: np.ndarray, starts: tuple[np.ndarray, ...], top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of leaves that differ in at most ``budget`` of their last ``64 - top`` bits.

    ``x`` is sorted, its leaves distinct; those alike in the first ``top`` bits are one trie.  ``starts`` are the first node
    pairs: two tries as ``lo_a, hi_a, lo_b, hi_b``, or one and itself.  A node of depth d is a stretch of x alike in d bits.
    """
    low = np.uint64((1 << (64 - top)) - 1)
    first = np.array([len(starts[0])])
    todo = [(*starts, np.full(first, top, np.uint64), np.zeros(first, np.int64))]
    while todo:
        pair = todo.pop()
        if len(pair[0]) > PAIRS:
            todo.append(tuple(c[PAIRS:] for c in pair))
            pair = tuple(c[:PAIRS] for c in pair)
        la, ha, lb, hb, depth, differ = pair
        few = ((ha - la) * (hb - lb) <= LEAF_PAIRS) | (depth >= 64)
        if few.any():
            a0, b0, nb = la[few], lb[few], (hb - lb)[few]
            many = (ha - la)[few] * nb
            row = np.repeat(np.arange(len(many)), many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            a, b = a0[row] + at // nb[row], b0[row] + at % nb[row]
            near = (np.bitwise_count((x[a] ^ x[b]) & low) <= budget) & ((a < b) | (a0 != b0)[row])
            if near.any():
                yield a[near], b[near]
        if few.all():
            continue
        la, ha, lb, hb, depth, differ = (c[~few] for c in pair)
        bit, self_pair = np.uint64(63) - depth, la == lb
        ones = lambda lo: np.searchsorted(x, (x[lo] >> bit | np.uint64(1)) << bit)  # noqa: E731  where the bit is set from
        ma = ones(la)
        mb = np.where(self_pair, ma, 0)
        mb[~self_pair] = np.searchsorted(x, ((x[lb] >> bit | np.uint64(1)) << bit)[~self_pair])
        children = []
        for a, b, more in (((la, ma), (lb, mb), 0), ((ma, ha), (mb, hb), 0), ((la, ma), (mb, hb), 1), ((ma, ha), (lb, mb), 1)):
            keep = (a[0] < a[1]) & (b[0] < b[1]) & (differ + more <= budget)
            if more and a[0] is ma:
                keep &= ~self_pair  # of a node and itself, its two children are one pair
            children.append(tuple(c[keep] for c in (*a, *b, depth + np.uint64(1), differ + more)))
        todo.append(tuple(np.concatenate(c) for c in zip(*children)))


class Forest:
    """Components of the numbers below n, by their smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (above := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = above


def block_cuts(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block."""
    at = [64 * k // blocks for k in range(blocks + 1)]
    return [(lo, hi - lo) for lo, hi in zip(at, at[1:])]


def _reordered(fp: Column, order: list[tuple[int, int]]) -> Column:
    """The fingerprint with its blocks in this order, from the highest bit down."""
    out, left = F.lit(0).cast("long"), 64
    for lo, wide in order:
        left -= wide
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << wide) - 1).cast("long")), left))
    return out


def trie_links(fps: DataFrame, scratch: Scratch, budget: int = 3, blocks: int | None = None) -> DataFrame:
    """``a, b``: links among distinct fingerprints ``fp``, enough that those within the budget are in one component.

    The links of each task are those of a forest; no pair within the budget ends in two components.
    """
    n = fps.count()
    blocks = blocks or budget + (1 if n < MANY else 2)
    cuts, chosen = block_cuts(blocks), list(combinations(range(blocks), blocks - budget))
    tries = []
    for k, on_top in enumerate(chosen):
        top = sum(cuts[i][1] for i in on_top)
        moved = _reordered(F.col("fp"), [cuts[i] for i in on_top] + [c for i, c in enumerate(cuts) if i not in on_top])
        tries.append(F.struct(F.lit(k).alias("trie"), F.shiftrightunsigned(moved, 64 - top).alias("node"), moved.alias("x")))
    tops = [sum(cuts[i][1] for i in on_top) for on_top in chosen]
    rows = fps.select("fp", F.explode(F.array(*tries)).alias("t")).select("fp", "t.*")
    # Top nodes with too many leaves for one task: at most len(tries) * n / PART_LEAVES of them.
    hot = scratch.put(rows.groupBy("trie", "node").count().filter(F.col("count") > PART_LEAVES), "hot-nodes")
    parts = F.ceil(F.col("count") / PART_LEAVES).cast("int")
    if hot.isEmpty():
        dealt = rows.withColumn("p", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        dealt = rows.join(maybe_broadcast(hot), ["trie", "node"], "left").withColumn("n", F.coalesce(parts, F.lit(1)))
        dealt = dealt.withColumn("p", F.pmod(F.xxhash64("x"), "n").cast("int")).withColumn("q", F.explode(F.expr("sequence(0, n - 1)")))
        dealt = dealt.withColumn("i", F.least("p", "q")).withColumn("j", F.greatest("p", "q")).drop("q", "n", "count")
    tasks = max(1, math.ceil(len(tries) * n / TASK_LEAVES))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("trie", "node", "i", "j"), F.lit(tasks)).cast("int"))

    def join(rows: pa.Table) -> pa.Table:
        col = {c: rows.column(c).to_numpy() for c in ("fp", "trie", "node", "x", "p", "i", "j")}
        col["x"] = col["x"].view(np.uint64) if col["x"].dtype == np.int64 else col["x"]
        found = []
        for trie in np.unique(col["trie"]):
            mine = {k: v[col["trie"] == trie] for k, v in col.items()}
            order = np.lexsort((mine["x"], mine["p"], mine["j"], mine["i"], mine["node"]))
            mine, top = {k: v[order] for k, v in mine.items()}, tops[trie]
            new = np.ones(len(order) + 1, bool)
            new[1:-1] = np.any([mine[k][1:] != mine[k][:-1] for k in ("node", "i", "j", "p")], axis=0)
            at = np.flatnonzero(new)  # bounds of the tries
            # The bits on top are alike within a trie, so its number takes their place and all tries are sorted as one.
            for k in range(0, len(at) - 1, 1 << top):
                lo, hi = at[:-1][k : k + (1 << top)], at[1:][k : k + (1 << top)]
                begin, rank = lo[0], np.repeat(np.arange(len(lo), dtype=np.uint64), hi - lo)
                x = (mine["x"][begin : hi[-1]] & np.uint64((1 << (64 - top)) - 1)) | rank << np.uint64(64 - top)
                lo, hi, part = lo - begin, hi - begin, {c: mine[c][lo] for c in ("node", "i", "j")}
                alone = part["i"] == part["j"]
                # Of a pair of different parts, the two tries are neighbours.
                both = np.flatnonzero(~alone[:-1] & ~alone[1:] & np.all([v[1:] == v[:-1] for v in part.values()], axis=0))
                starts = tuple(np.concatenate([own[alone], own[both + s]]) for own, s in ((lo, 0), (hi, 0), (lo, 1), (hi, 1)))
                forest = Forest(len(x))
                for a, b in close_leaves(x, starts, top, budget):
                    forest.unite(a, b)
                linked = np.flatnonzero(forest.root != np.arange(len(x)))
                found.append((mine["fp"][begin + linked], mine["fp"][begin + forest.root[linked]]))
        a, b = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.int64) for s in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("task").applyInArrow(join, "a long, b long")


def near_duplicates(
    docs: DataFrame, budget: int = 3, width: int = 3, seed: int = 42, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Returns ``doc_id, fingerprint, component_id`` for every row.

    Fingerprints are linked when at most ``budget`` of their 64 bits differ; ``component_id`` is the smallest id reachable, as 16 hexadecimal digits show the
    fingerprint.  Texts without words, null ones too, have fingerprint zero and are linked like any other.  Null ids stay
    null and are the smallest of a component only if it has no other; ids may be of any type that has an order.
    Repeated rows give repeated results, an empty table none; other columns are not read; texts are read whole.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    with short_batches(docs.sparkSession):
        rows = scratch.put(with_fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    own = scratch.put(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = scratch.put(trie_links(own.select("fp"), scratch, budget, blocks), "links")
    roots = connected_components(links, scratch).withColumnRenamed("node", "fp")
    of = own.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.put(of.join(least, "root").select("fp", "component_id"), "components")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", hexed, "component_id")
