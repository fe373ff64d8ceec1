"""Documents, sentences, tokens and their graphs as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators.relational import running_total
from textloom.operators.shared import Tables


def sentence_table(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, sentence, tokens``; positions keep the gaps of dropped sentences (2 words or fewer)."""
    pieces = docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    return pieces.withColumn("tokens", tx.tokens(F.col("sentence"))).filter(F.size("tokens") > 2)


def term_frequency(sents: DataFrame) -> DataFrame:
    """``doc_id, pos, term, n, tf``: counts over the largest count in the sentence."""
    counts = sents.select("doc_id", "pos", F.explode("tokens").alias("term")).groupBy("doc_id", "pos", "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("tf", F.col("n") / F.max("n").over(Window.partitionBy("doc_id", "pos")))


def inverse_frequency(tf: DataFrame, sents: DataFrame) -> DataFrame:
    """``doc_id, term, idf``: ln(sentences / (1 + sentences with the term)), per document."""
    total = sents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    return tf.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("k")).join(total, "doc_id").select("doc_id", "term", F.log(F.col("total") / (F.col("k") + 1)).alias("idf"))


#: Words of documents whose sentences are compared in one task, and numbers of a matrix in it.
BLOCK_WORDS = 200_000
MATRIX = 1 << 22


def _close(row: np.ndarray, term: np.ndarray, w: np.ndarray, norm: np.ndarray, threshold: float) -> list[np.ndarray]:
    """(a, b, weight) of a document's sentences from its cells (sentence, term, weight, sorted by sentence), a piece of the sentences and of the terms at a time."""
    n, found = len(norm), [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
    terms = int(term.max(initial=-1)) + 1
    rows, wide = max(1, MATRIX // n), max(16, MATRIX // n)
    order = np.argsort(term, kind="stable")
    row, term, w = row[order], term[order], w[order]
    for lo in range(0, n, rows):
        score, shared = np.zeros((min(rows, n - lo), n)), None if threshold >= 0 else np.zeros((min(rows, n - lo), n))
        for c in range(0, terms, wide):
            part = slice(*np.searchsorted(term, (c, c + wide)))
            matrix = np.zeros((n, min(wide, terms - c)))
            matrix[row[part], term[part] - c] = w[part]
            score += matrix[lo : lo + rows] @ matrix.T
            if shared is not None:
                matrix[row[part], term[part] - c] = 1.0
                shared += matrix[lo : lo + rows] @ matrix.T
        good = (norm[lo : lo + rows, None] > 0) & (norm[None] > 0)
        score = np.where(good, score, 0.0) / np.where(good, norm[lo : lo + rows, None] * norm[None], 1.0)
        good &= np.round(score, 9) > threshold
        x, y = np.nonzero(good if shared is None else good & (shared > 0))
        found.append([x + lo, y, score[x, y]])
    return [np.concatenate(x) for x in zip(*found)]


def similarity_edges(sents: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, a, b, weight`` above the threshold, both directions and self loops included.

    The norm sums over token occurrences, so repeated words weigh repeatedly.  Documents are dealt into blocks of some BLOCK_WORDS words, whose
    sentences' words are sent once; pairs of sentences stay in their task, only edges leave it.
    """
    texts = Tables(sents.sparkSession, "similar").put(sents.select("doc_id", "pos", "tokens").filter(F.col("doc_id").isNotNull()), "texts")
    blocks = max(1, -(-(texts.agg(F.sum(F.greatest(F.size("tokens"), F.lit(0)).cast("long"))).first()[0] or 0) // BLOCK_WORDS))
    kinds = {c: texts.schema[c].dataType.simpleString() for c in ("doc_id", "pos")}

    def run(own: pa.Table) -> pa.Table:
        doc, pos, lists = (own.column(c).combine_chunks() for c in ("doc_id", "pos", "tokens"))
        doc_code, pos_code = (x.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (doc, pos))
        total = np.bincount(doc_code)
        _, first, sentence = np.unique(np.stack([doc_code, pos_code], axis=1), axis=0, return_index=True, return_inverse=True)
        of = doc_code[first]  # a sentence's document; sentences are in the order of their documents
        terms = pc.list_flatten(lists).dictionary_encode()
        code = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = sentence.ravel()[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)]
        size = len(terms.dictionary) + 1
        cell, n = np.unique(owner[code >= 0] * size + code[code >= 0], return_counts=True)
        row, term = cell // size, cell % size
        most = np.zeros(len(first))
        np.maximum.at(most, row, n)
        in_doc, place, k = np.unique(of[row] * size + term, return_inverse=True, return_counts=True)
        w = n / most[row] * np.log(total[of[row]] / (k[place.ravel()] + 1))
        norm = np.sqrt(np.bincount(row, n * w * w, minlength=len(first)))
        begins = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        found = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
        for lo, hi in zip(begins, np.append(begins[1:], len(of))):
            part = slice(*np.searchsorted(row, (lo, hi)))
            local = place.ravel()[part] - np.searchsorted(in_doc, of[lo] * size)
            a, b, weight = _close(row[part] - lo, local, w[part], norm[lo:hi], threshold)
            found.append([first[a + lo], first[b + lo], weight])
        a, b, weight = (np.concatenate(x) for x in zip(*found))
        return pa.table([doc.take(pa.array(a)), pos.take(pa.array(a)), pos.take(pa.array(b)), pa.array(weight)], names=["doc_id", "a", "b", "weight"])

    # By number: the comparisons cost more time than the blocks' bytes tell.
    dealt = texts.withColumn("block_", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block_")
    edges = dealt.groupBy("block_").applyInArrow(run, f"doc_id {kinds['doc_id']}, a {kinds['pos']}, b {kinds['pos']}, weight double")
    return edges.filter("a is not null and b is not null")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``doc_id, node, rank`` after a fixed number of rounds; mass of nodes without edges is spread evenly."""
    by_doc = Window.partitionBy("doc_id")
    steps = edges.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("doc_id", "a")))
    # A node's own document bounds its neighbours.
    out = steps.groupBy("doc_id", F.col("a").alias("node")).agg(F.collect_list(F.struct("b", "p")).alias("out"))
    none = F.array().cast("array<struct<b:int,p:double>>")
    ranks = nodes.select("doc_id", F.col("node").cast("int").alias("node")).withColumn("n", F.count(F.lit(1)).over(by_doc))
    ranks = ranks.join(out, ["doc_id", "node"], "left").withColumn("out", F.coalesce("out", none)).withColumn("rank", 1.0 / F.col("n"))
    for _ in range(rounds):
        # Each round reads the one before once: a node sends itself what it knows, and its neighbours their shares.
        lost = F.sum(F.when(F.size("out") == 0, F.col("rank")).otherwise(0.0)).over(by_doc)
        own = F.array(F.struct(F.col("node").alias("to"), F.lit(0.0).alias("got"), F.struct("n", "lost", "out").alias("known")))
        sent = F.transform("out", lambda e: F.struct(e["b"].cast("int").alias("to"), (F.col("rank") * e["p"]).alias("got"), F.lit(None).cast("struct<n:bigint,lost:double,out:array<struct<b:int,p:double>>>").alias("known")))
        moved = ranks.withColumn("lost", lost).select("doc_id", F.explode(F.concat(own, sent)).alias("m"))
        met = moved.groupBy("doc_id", F.col("m.to").alias("node")).agg(F.sum("m.got").alias("got"), F.first("m.known", ignorenulls=True).alias("k"))
        rank = (1 - damping) / F.col("k.n") + damping * (F.col("got") + F.col("k.lost") / F.col("k.n"))
        ranks = met.select("doc_id", "node", F.col("k.n").alias("n"), F.col("k.out").alias("out"), rank.alias("rank"))
    return ranks.select("doc_id", "node", "rank")


def converged_pagerank(nodes: DataFrame, edges: DataFrame, most: int = 100, tolerance: float = 1e-10, damping: float = 0.85) -> DataFrame:
    """``doc_id, node, rank``: each document's rounds go on until its ranks change by less than ``tolerance`` in all, ``most`` at most.

    The reference stops within 100 rounds too, but at 1e-6 a node, a looser bound.
    A document's graph is iterated in one task; mass of nodes without edges is spread evenly.
    """
    kind = nodes.schema["doc_id"].dataType.simpleString()

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        names = np.unique(nodes.column("node").to_numpy())
        n = len(names)
        a, b = (np.searchsorted(names, edges.column(c).to_numpy()) for c in ("a", "b"))
        weight = edges.column("weight").to_numpy()
        total = np.bincount(a, weights=weight, minlength=n)
        p, lost = weight / total[a], total == 0
        rank = np.full(n, 1.0 / n)
        for _ in range(most):
            before = rank
            rank = (1 - damping) / n + damping * (np.bincount(b, weights=before[a] * p, minlength=n) + before[lost].sum() / n)
            if np.abs(rank - before).sum() < tolerance:
                break
        ids = pa.array([nodes.column("doc_id")[0].as_py()] * n, nodes.schema.field("doc_id").type)
        return pa.table([ids, pa.array(names, pa.int32()), pa.array(rank)], names=["doc_id", "node", "rank"])

    own = nodes.select("doc_id", F.col("node").cast("int").alias("node"))
    steps = edges.select(F.col("doc_id").alias("of"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "weight")
    return own.groupBy("doc_id").cogroup(steps.groupBy("of")).applyInArrow(run, f"doc_id {kind}, node int, rank double")


def summary(ranks: DataFrame, fraction: float) -> DataFrame:
    """``doc_id, node, position``: the best ceil(n * fraction) sentences; ties go to the earlier one."""
    w = Window.partitionBy("doc_id")
    ranked = ranks.withColumn("position", F.row_number().over(w.orderBy(F.round("rank", 9).desc(), "node"))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("position") <= F.ceil(F.round(F.col("n") * fraction, 9))).select("doc_id", "node", "position")


def summarise(docs: DataFrame, threshold: float = 0.1, fraction: float = 0.2) -> DataFrame:
    """Extractive summaries: ``doc_id, position, pos, sentence``."""
    sents = sentence_table(docs)
    ranks = converged_pagerank(sents.select("doc_id", F.col("pos").alias("node")), similarity_edges(sents, threshold))
    return summary(ranks, fraction).withColumnRenamed("node", "pos").join(sents.select("doc_id", "pos", "sentence"), ["doc_id", "pos"])


def grams(size: int) -> Column:
    """The contiguous n-grams of ``tokens``."""
    last = F.size("tokens") - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice("tokens", i, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def skip_bigrams(gap: int) -> Column:
    """The ordered pairs of ``tokens`` with at most ``gap`` tokens between."""
    return F.flatten(F.transform("tokens", lambda x, i: F.transform(F.slice("tokens", i + 2, F.lit(gap + 1)), lambda y: F.concat_ws(" ", x, y))))


def gram_counts(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``key, gram, n`` of the contiguous n-grams of ``tokens``."""
    return rows.select(key, F.explode(grams(size)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))


def skip_bigram_counts(rows: DataFrame, key: str, gap: int) -> DataFrame:
    """``key, gram, n`` of ordered pairs of tokens with at most ``gap`` tokens between."""
    return rows.select(key, F.explode(skip_bigrams(gap)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))


def rouge(peers: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """``key, recall, precision, f1`` of clipped overlaps of gram counts."""
    p, m = peers.withColumnRenamed("n", "p"), models.withColumnRenamed("n", "m")
    hits = p.join(m, [key, "gram"]).groupBy(key).agg(F.sum(F.least("p", "m")).alias("hit"))
    tp, tm = p.groupBy(key).agg(F.sum("p").alias("tp")), m.groupBy(key).agg(F.sum("m").alias("tm"))
    hit = F.coalesce("hit", F.lit(0))
    both = tp.join(tm, key).join(hits, key, "left").select(key, (hit / F.col("tm")).alias("r"), (hit / F.col("tp")).alias("p"))
    f1 = F.when(F.col("r") + F.col("p") > 0, 2 * F.col("r") * F.col("p") / (F.col("r") + F.col("p"))).otherwise(0.0)
    return both.select(key, F.round("r", 5).alias("recall"), F.round("p", 5).alias("precision"), F.round(f1, 5).alias("f1"))



def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    """``column, rank_<column>``: the average rank of each distinct value; null values have none.

    Values are counted first; running totals over ranges of the values give the ranks.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(counts, [column], F.col("n"))
    return placed.select(column, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(f"rank_{column}"))


def v_measure(rows: DataFrame) -> DataFrame:
    """Homogeneity, completeness and V-measure of classes ``y`` against clusters ``p``; rows with a null are left out."""
    cells = rows.dropna(subset=["y", "p"]).groupBy("y", "p").agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = Window.partitionBy()  # over the contingency table, already aggregated
    cells = cells.withColumn("total", F.sum("n").over(whole)).withColumn("ny", F.sum("n").over(Window.partitionBy("y"))).withColumn("np", F.sum("n").over(Window.partitionBy("p")))

    def entropy(of: str, given: str) -> Column:
        return -F.sum(F.col("n") / F.col("total") * F.log(F.col(of) / F.col(given)))

    h = cells.agg(entropy("ny", "total").alias("hy"), entropy("np", "total").alias("hp"), entropy("n", "np").alias("hy_p"), entropy("n", "ny").alias("hp_y"))
    hom = F.when(F.col("hy") == 0, 1.0).otherwise(1 - F.col("hy_p") / F.col("hy"))
    com = F.when(F.col("hp") == 0, 1.0).otherwise(1 - F.col("hp_y") / F.col("hp"))
    v = F.when(hom + com == 0, 0.0).otherwise(2 * hom * com / (hom + com))
    return h.select(F.round(hom, 6).alias("homogeneity"), F.round(com, 6).alias("completeness"), F.round(v, 6).alias("v_measure"))


def retrofit(values: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``g, a, s, v``: vectors s drawn towards their neighbours' (edges g, a, b, both ways) in rounds.

    Each round sets v to the mean of s and the neighbours' mean of the round before; nodes without neighbours keep s.
    """
    both = edges.select("g", "a", "b").unionByName(edges.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
    now = values.withColumn("v", F.col("s"))
    for _ in range(rounds):
        sent = both.join(now.select("g", F.col("a").alias("b"), "v"), ["g", "b"]).select("g", "a", F.posexplode("v").alias("k", "x"))
        means = sent.groupBy("g", "a", "k").agg(F.avg("x").alias("x")).groupBy("g", "a").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("m"))
        now = now.drop("v").join(means, ["g", "a"], "left")
        now = now.select("g", "a", "s", F.when(F.col("m").isNull(), F.col("s")).otherwise(F.zip_with("s", F.col("m.x"), lambda x, y: (x + y) / 2)).alias("v"))
    return now


def second_order_transitions(edges: DataFrame, p: float, q: float) -> DataFrame:
    """``g, previous, node, following, p``: biased walk steps over undirected edges (g, a, b, weight).

    Going back weighs 1/p, staying next to the previous node 1, moving away 1/q.
    """
    both = edges.select("g", "a", "b", "weight").unionByName(edges.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "weight")).dropDuplicates(["g", "a", "b"])
    step = both.select("g", F.col("a").alias("previous"), F.col("b").alias("node"))
    onward = both.select("g", F.col("a").alias("node"), F.col("b").alias("following"), "weight")
    near = both.select("g", F.col("a").alias("previous"), F.col("b").alias("following"), F.lit(True).alias("near"))
    steps = step.join(onward, ["g", "node"]).join(near, ["g", "previous", "following"], "left")
    bias = F.when(F.col("following") == F.col("previous"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
    w = F.col("weight") * bias
    return steps.withColumn("w", w).withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("g", "previous", "node")))
