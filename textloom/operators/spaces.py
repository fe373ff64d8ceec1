"""Operators on tables of vectors (``id, v``): features, neighbours, sentence vectors, clusters, linear maps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import vectors as vec
from textloom.operators.shared import Tables

#: Vectors that meet in one block; bytes of one side's vectors, at most, that a task gets; blocks a side, for enough tasks, as far as BLOCK allows.
BLOCK = 2_048
SIDE_BYTES = 1 << 25
SIDE_BLOCKS = 8
#: Queries of the metric tree that meet a region's vectors in one task.
QUERY_PART = 16_384


def clipped_cosine(a: Column, b: Column) -> Column:
    """Cosine, negative values raised to 0."""
    return F.greatest(F.lit(0.0), vec.dot(vec.normalised(a, 0.0), vec.normalised(b, 0.0)))


def pair_features(a: Column, b: Column) -> Column:
    """The absolute differences, then the products."""
    return F.concat(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def _blocks(rows: DataFrame, count: int, *more: str) -> DataFrame:
    # New columns, so that a table may meet itself.
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("block"), *[F.col(c).alias(f"{c}_") for c in ("id", "v", *more)]).toDF("block", "id", "v", *more)


def best_of(queries: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """(query, id, score) of each row's k largest finite scores to nine digits (ties: the smaller id); only those at or above the k-th are sorted."""
    rounded = np.round(score, 9)
    least = -np.partition(-rounded, k - 1, axis=1)[:, k - 1 : k] if rounded.shape[1] > k else np.full((len(score), 1), -np.inf)
    row, col = np.nonzero((rounded >= least) & (rounded > -np.inf))
    order = np.lexsort((ids[col], -rounded[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col = row[place < k], col[place < k]
    return [queries[row], ids[col], score[row, col]]


def stacked(column: pa.ChunkedArray) -> np.ndarray:
    """The lists of a column, all of one length, as a matrix."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest(a: np.ndarray, of: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, metric: str, docs: tuple[np.ndarray, np.ndarray] | None = None, intra: float = -np.inf, inter: float = -np.inf) -> list[np.ndarray]:
    """(query, id, score) of the k largest scores of each row of ``a`` with rows of ``b``; Euclidean distances count, and come back, negative.

    Scores are computed piece by piece; of a piece only those that reach the k-th of the pieces before are looked at.
    """
    found = [[of[:0], ids[:0], np.zeros(0)]]
    squares = (b * b).sum(1)
    for lo in range(0, len(a), 512):
        own = a[lo : lo + 512]
        n, at, held = len(own), np.arange(len(own)), [np.zeros(0, np.int64), ids[:0], np.zeros(0)]
        floor = np.full(n, min(intra, inter) if docs else -np.inf)
        for c in range(0, len(b), 2 * BLOCK):
            part, names = slice(c, c + 2 * BLOCK), ids[c : c + 2 * BLOCK]
            score = own @ b[part].T
            if metric == "euclidean":
                score = -np.sqrt(np.maximum((own * own).sum(1)[:, None] + squares[part][None] - 2 * score, 0))
            row, col = np.nonzero(score >= (floor - 1e-8)[:, None])
            if docs:
                same = docs[0][lo + row] == docs[1][c + col]
                fits = (np.round(score[row, col], 9) >= np.where(same, intra, inter)) & (of[lo + row] != names[col])
                row, col = row[fits], col[fits]
            new = [row, names[col], score[row, col]]
            if len(row) > 16 * k * n:
                some = np.full_like(score, -np.inf)
                some[row, col] = new[2]
                new = best_of(at, names, some, k)
            row, name, value = (np.concatenate(x) for x in zip(held, new))
            order = np.lexsort((name, -np.round(value, 9), row))
            place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
            held = [x[order[place < k]] for x in (row, name, value)]
            full = np.flatnonzero(np.bincount(held[0], minlength=n) == k)
            last = np.searchsorted(held[0], full, "right") - 1
            floor[full] = np.maximum(floor[full], np.round(held[2][last], 9))
        found.append([of[lo + held[0]], held[1], held[2]])
    return [np.concatenate(x) for x in zip(*found)]


def _sides(rows: int, most: int) -> int:
    return max(1, -(-rows // most), min(SIDE_BLOCKS, -(-rows // BLOCK)))


def neighbours(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "dot", doc: bool = False, intra: float = -np.inf, inter: float = -np.inf) -> DataFrame:
    """``query, id, score``: for each query (``id, v``) its k best vectors, exactly; ties go to the smaller id.

    ``metric`` is ``dot`` (larger is better) or ``euclidean`` (a distance).  With ``doc`` both tables have a
    column of that name, a query does not meet itself, and only scores of at least ``intra`` (same document)
    or ``inter`` count.  Blocks of queries meet blocks of vectors as matrices; a block has up to SIDE_BYTES of vectors, so a vector is sent to few
    meetings, and each meeting keeps k rows a query.  All vectors meet all queries: work grows with their product.  Rows without a vector are left out.
    """
    more = ["doc"] if doc else []
    queries, vectors = (t.filter(F.col("v").isNotNull()) for t in (queries, vectors))
    n, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = max(BLOCK, SIDE_BYTES // (8 * max(dims or 1, 1)))
    of_vectors, of_queries = _sides(n, most), _sides(queries.count(), most)
    left = _blocks(queries, of_queries, *more).withColumnRenamed("block", "x").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(of_vectors - 1))))
    right = _blocks(vectors, of_vectors, *more).withColumnRenamed("block", "y").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(of_queries - 1))))
    # By number: the meetings cost far more time than their bytes tell.
    left, right = (t.repartition(of_vectors * of_queries, "x", "y") for t in (left, right))

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if q.num_rows and v.num_rows:
            docs = (q.column("doc").to_numpy(), v.column("doc").to_numpy()) if doc else None
            found = nearest(stacked(q.column("v")), q.column("id").to_numpy(), stacked(v.column("v")), v.column("id").to_numpy(), k, metric, docs, intra, inter)
        if metric == "euclidean":
            found[2] = -found[2]
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query", "id", "score"])

    met = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(meet, "query long, id long, score double")
    return _merged(met, k, metric).select("query", "id", "score")


def _merged(met: DataFrame, k: int, metric: str) -> DataFrame:
    rounded = F.round("score", 9)
    place = F.row_number().over(Window.partitionBy("query").orderBy(rounded if metric == "euclidean" else rounded.desc(), "id"))
    return met.withColumn("place", place).filter(F.col("place") <= k)


class VantageTree:
    """A complete binary tree over space: a node's half of the sample lies within ``radius`` of its vantage point, the other beyond.

    Node n has the children 2n + 1 (within) and 2n + 2; regions are the leaves, numbered from 0.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        inner = (1 << depth) - 1
        self.depth, self.points, self.radius = depth, np.zeros((inner, sample.shape[1])), np.zeros(inner)
        held = {0: sample}
        for n in range(inner):
            own = held.pop(n)
            if len(own):
                self.points[n] = own[0]
                distance = np.linalg.norm(own - own[0], axis=1)
                self.radius[n] = np.median(distance)
                inside = distance < self.radius[n]
            else:
                inside = np.zeros(0, bool)
            held[2 * n + 1], held[2 * n + 2] = own[inside], own[~inside]

    def region(self, v: np.ndarray) -> np.ndarray:
        node = np.zeros(len(v), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.linalg.norm(v - self.points[node], axis=1) >= self.radius[node])
        return node - len(self.radius)

    def reached(self, v: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, region): the regions that can hold a vector within the bound of the row's."""
        row, node = np.arange(len(v)), np.zeros(len(v), np.int64)
        for _ in range(self.depth):
            slack = np.linalg.norm(v[row] - self.points[node], axis=1) - self.radius[node]
            inside, outside = slack <= bound[row] + 1e-8, -slack <= bound[row] + 1e-8
            row, node = np.concatenate([row[inside], row[outside]]), np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
        return row, node - len(self.radius)


def tree_neighbours(queries: DataFrame, vectors: DataFrame, k: int, leaf: int = BLOCK, sample: int = 8_192, most_depth: int = 10) -> DataFrame:
    """``query, id, score, looked``: as ``neighbours`` by Euclidean distance, exactly, and how many distances were computed for the query.

    The driver builds a vantage-point tree of at most ``2 ** most_depth`` regions over ``sample`` vectors that a hash picks.  A query first
    searches its own region; its k-th distance there, by the triangle inequality, rules out regions, and it goes on to those left.  A region
    with more than BLOCK vectors is cut into chunks that meet its queries one by one.
    """
    tables = Tables(vectors.sparkSession, "tree")
    queries, vectors = (t.filter(F.col("v").isNotNull()).select("id", F.col("v").cast("array<double>").alias("v")) for t in (queries, vectors))
    vectors, queries = tables.put(vectors, "vectors"), tables.put(queries, "queries")
    n = vectors.count()
    depth = max(0, min(most_depth, math.ceil(math.log2(max(n, 1) / leaf)))) if n > leaf else 0
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).collect() if depth else []
    tree = VantageTree(np.array([r["v"] for r in picked]), depth) if depth else None

    def placed(rows: DataFrame) -> DataFrame:
        if tree is None:
            return rows.withColumn("region", F.lit(0).cast("long"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.region(stacked(b.column(1))))], names=["id", "v", "region"])

        return rows.mapInArrow(run, "id long, v array<double>, region long")

    def meet(key: tuple, q: pa.Table, v: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if q.num_rows and v.num_rows:
            found = nearest(stacked(q.column("v")), q.column("id").to_numpy(), stacked(v.column("v")), v.column("id").to_numpy(), k, "euclidean")
        alike = [pa.array([x.as_py()] * len(found[0]), pa.int64()) for x in key[:2]] + [pa.array([v.num_rows] * len(found[0]), pa.int64())]
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(-found[2], pa.float64()), *alike], names=["query", "id", "score", "region", "chunk", "looked"])

    held = placed(vectors)
    counts = tables.put(held.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks")), "regions")  # one row a region
    held = tables.put(held.join(F.broadcast(counts), "region").select("id", "v", "region", F.pmod(F.xxhash64("id"), "chunks").alias("chunk")), "held")

    def searched(asked: DataFrame, name: str) -> DataFrame:
        # A region's vectors are sent to as many parts as its own queries need.
        asking = tables.put(asked.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / QUERY_PART).alias("parts")), f"{name}-parts")
        every = asked.join(F.broadcast(counts.join(asking, "region")), "region").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
        every = every.select("id", "v", "region", "chunk", F.pmod(F.xxhash64("id"), "parts").alias("part"))
        parts = every.select("region", "chunk", "part").distinct()
        there = held.join(parts, ["region", "chunk"]).select(*[F.col(c).alias(f"{c}_") for c in ("region", "chunk", "part", "id", "v")]).toDF("region", "chunk", "part", "id", "v")
        met = every.groupBy("region", "chunk", "part").cogroup(there.groupBy("region", "chunk", "part")).applyInArrow(meet, "query long, id long, score double, region long, chunk long, looked long")
        return tables.put(met, name)

    own = tables.put(placed(queries), "own")
    near = searched(own, "near")
    if tree is None:
        return _with_looked(near, k)
    bounds = _merged(near, k, "euclidean").groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("bound"))
    asked = own.join(bounds.withColumnRenamed("query", "id"), "id", "left").select("id", "v", "region", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, region = tree.reached(stacked(b.column(1)), b.column(3).to_numpy())
                other = region != b.column(2).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[other])), b.column(1).take(pa.array(row[other])), pa.array(region[other])], names=["id", "v", "region"])

    far = searched(tables.put(asked.mapInArrow(visits, "id long, v array<double>, region long"), "visits"), "far")
    return _with_looked(near.unionByName(far), k)


def _with_looked(met: DataFrame, k: int) -> DataFrame:
    looked = met.select("query", "region", "chunk", "looked").distinct().groupBy("query").agg(F.sum("looked").alias("looked"))
    return _merged(met, k, "euclidean").select("query", "id", "score").join(looked, "query")


#: Words of the sentences that meet their vectors in one task.
BLOCK_WORDS = 200_000


def word_sums(sentences: DataFrame, words: DataFrame, keys: list[str], how: str = "avg") -> DataFrame:
    """``keys, v``: mean (``avg``) or sum of the vectors of a sentence's words.

    ``sentences`` has ``keys, tokens``, ``words`` has ``term, v``.  Repeated words count repeatedly, unknown words are left out, sentences without
    a known word give no row.  Sentences are dealt into blocks of some BLOCK_WORDS words; a block gets the vector of each word it names once, so what
    is shuffled grows with the blocks' different words, not with places times dimensions.
    """
    tables = Tables(sentences.sparkSession, "sums")
    texts = tables.put(sentences.select(*keys, "tokens").filter(F.size("tokens") > 0), "read")
    blocks = max(1, -(-(texts.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0) // BLOCK_WORDS))
    texts = texts.withColumn("block_", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    given = words.filter(F.col("v").isNotNull()).select("term", F.col("v").cast("array<double>").alias("v"))
    needs = texts.select("block_", F.explode("tokens").alias("term")).distinct().join(given, "term").select(F.col("block_").alias("of_"), "term", "v")

    def run(own: pa.Table, needs: pa.Table) -> pa.Table:
        names = pc.unique(needs.column("term").combine_chunks())
        number = pc.index_in(needs.column("term").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
        lists = needs.column("v").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        width = int(sizes.max(initial=0))
        # A word may have several vectors, and vectors several lengths: each dimension has its own number of terms.
        matrix, terms = np.zeros((len(names), width)), np.zeros((len(names), width))
        row, place = np.repeat(number, sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        np.add.at(matrix, (row, place), lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False))
        np.add.at(terms, (row, place), 1.0)
        tokens = own.column("tokens").combine_chunks()
        code = np.stack([own.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in keys], axis=1)
        _, first, owner = np.unique(code, axis=0, return_index=True, return_inverse=True)  # rows with equal keys are one sentence
        owner = owner.ravel()[pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)]
        found = pc.index_in(pc.list_flatten(tokens), value_set=names)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        owner, word = owner[known], found.fill_null(-1).to_numpy(zero_copy_only=False)[known]
        order = np.argsort(owner, kind="stable")
        owner, word = owner[order], word[order]
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        sums, have = [], []
        for k in range(0, len(at), 1_024):  # so many sentences at once
            ends = np.append(at, len(owner))[k : k + 1_025]
            part = word[ends[0] : ends[-1]]
            sums.append(np.add.reduceat(matrix[part], ends[:-1] - ends[0], axis=0))
            have.append(np.add.reduceat(terms[part], ends[:-1] - ends[0], axis=0))
        sums, have = (np.concatenate([np.zeros((0, width)), *x]) for x in (sums, have))
        given, length = have > 0, (have > 0).sum(axis=1)
        values = (sums / np.where(given, have, 1.0) if how == "avg" else sums)[given]
        some = length > 0
        rows = own.take(pa.array(first[owner[at]][some])).select(keys)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length[some])), pa.int32()), pa.array(values))
        return rows.append_column("v", lists)

    kind = ", ".join(f"`{c}` {sentences.schema[c].dataType.simpleString()}" for c in keys)
    return texts.groupBy("block_").cogroup(needs.groupBy("of_")).applyInArrow(run, f"{kind}, v array<double>")


def sentence_vectors(sentences: DataFrame, words: DataFrame, keys: list[str], how: str = "avg") -> DataFrame:
    """``keys, k, x``: the sums or means of ``word_sums`` by dimension."""
    return word_sums(sentences, words, keys, how).select(*keys, F.posexplode("v").alias("k", "x"))


def gathered(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, v`` from ``keys, k, x``."""
    rows = F.array_sort(F.collect_list(F.struct("k", "x")))
    return cells.groupBy(*keys).agg(F.transform(rows, lambda r: r["x"]).alias("v"))


def spherical_kmeans(vectors: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """``id, cluster``: vectors start in cluster ``id mod k``; each round takes unit centroids and moves
    every vector to the one with the largest inner product (ties: the smaller cluster).  Centroids are k rows."""
    now = vectors.withColumn("cluster", F.pmod("id", F.lit(k)).cast("int"))
    for _ in range(rounds):
        means = now.select("cluster", F.posexplode("v").alias("d", "x")).groupBy("cluster", "d").agg(F.avg("x").alias("x")).collect()  # k rows of one vector
        size = max((r["d"] for r in means), default=-1) + 1
        centres: dict[int, list[float]] = {c: [0.0] * size for c in range(k)}
        for r in means:
            centres[r["cluster"]][r["d"]] = r["x"]
        units = {c: np.array(v) / (np.linalg.norm(v) or 1.0) for c, v in centres.items()}
        scores = [F.struct(F.round(vec.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in u])), 9).alias("s"), F.lit(-c).alias("c")) for c, u in units.items()]
        now = vectors.withColumn("cluster", (-F.greatest(*scores)["c"] if k > 1 else F.lit(0)).cast("int"))
    return now.select("id", "cluster")


def linear_map(pairs: DataFrame) -> np.ndarray:
    """The matrix M of the least squares ``y ~ x M`` over rows ``x, y``.

    Tasks add up their own parts of the normal equations; the driver gets one small matrix a task group and solves.
    Rows that lack x or y are left out.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx = xy = None
        for batch in batches:
            if batch.num_rows:
                x, y = (np.stack(batch.column(i).to_numpy(zero_copy_only=False)).astype(float) for i in range(2))
                xx, xy = (x.T @ x, x.T @ y) if xx is None else (xx + x.T @ x, xy + x.T @ y)
        if xx is not None:
            at = [(m, i, j, v) for m, a in enumerate((xx, xy)) for (i, j), v in np.ndenumerate(a)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in at]) for c in range(4)], names=["m", "i", "j", "v"])

    rows = pairs.select("x", "y").dropna().mapInArrow(parts, "m long, i long, j long, v double").groupBy("m", "i", "j").agg(F.sum("v").alias("v")).collect()  # two matrices
    found = [np.zeros((1 + max((r["i"] for r in rows), default=-1), 1 + max((r["j"] for r in rows if r["m"] == m), default=-1))) for m in (0, 1)]
    for r in rows:
        found[r["m"]][r["i"], r["j"]] = r["v"]
    return np.linalg.lstsq(found[0], found[1], rcond=None)[0]


def apply_map(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    columns = [F.array(*[F.lit(float(x)) for x in matrix[:, j]]) for j in range(matrix.shape[1])]
    return vectors.withColumn("v", F.array(*[vec.dot(F.col("v"), c) for c in columns]))
