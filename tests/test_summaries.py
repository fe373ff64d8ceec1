"""Summaries against PageRank iterated by brute force until it no longer moves."""

import math

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import corpus

SF = "/root/testdata/sf0.001"


def ranked(nodes, edges):
    at = {v: i for i, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        m[at[a], at[b]] += w
    sums = m.sum(1, keepdims=True)
    m = np.where(sums > 0, m / np.where(sums > 0, sums, 1), 1 / len(nodes))
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(1000):
        rank = 0.15 / len(nodes) + 0.85 * rank @ m
    return rank


def test_summaries_come_from_converged_ranks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sents = corpus.sentence_table(docs).select("doc_id", "pos", "sentence", "tokens").cache()
    nodes, edges = {}, {}
    for r in sents.select("doc_id", "pos").collect():
        nodes.setdefault(r.doc_id, []).append(r.pos)
    similar = corpus.similarity_edges(sents, 0.1).cache()
    for r in similar.collect():
        edges.setdefault(r.doc_id, []).append((r.a, r.b, r.weight))
    got = {}
    for r in corpus.converged_pagerank(sents.select("doc_id", F.col("pos").alias("node")), similar).collect():
        got.setdefault(r.doc_id, {})[r.node] = r["rank"]
    picked = {}
    for r in corpus.summarise(docs).collect():
        picked.setdefault(r.doc_id, set()).add(r.pos)
    assert set(got) == set(nodes) == set(picked)
    for d, at in nodes.items():
        at = sorted(at)
        want = ranked(at, edges.get(d, []))
        assert np.abs(np.array([got[d][i] for i in at]) - want).sum() < 1e-5 * len(at)
        k = math.ceil(round(len(at) * 0.2, 9))
        last = np.sort(want)[-k]
        # Ranks that differ by less than the tolerance may take either place.
        sure = {i for i, x in zip(at, want) if x > last + 1e-5}
        able = {i for i, x in zip(at, want) if x >= last - 1e-5}
        assert len(picked[d]) == k and sure <= picked[d] <= able


def test_ranks_of_a_long_chain_converge(spark):
    links = [(1, i, i + 1, 1.0 + i % 3) for i in range(40)]
    edges = spark.createDataFrame(links + [(d, b, a, w) for d, a, b, w in links], "doc_id long, a int, b int, weight double")
    got = corpus.converged_pagerank(spark.createDataFrame([(1, i) for i in range(42)], "doc_id long, node int"), edges).collect()
    want = ranked(list(range(42)), [r[1:] for r in edges.collect()])
    assert max(abs(r["rank"] - want[r.node]) for r in got) < 1e-5
