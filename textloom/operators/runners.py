"""Methods that give sentences vectors, each a composition of learners, graphs and sums.

Sentences are ``id, doc, pos, tokens`` with whole numbers as ids; every method returns ``id, v, unit``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors as vec
from textloom.operators import graphs, learners, spaces
from textloom.operators.sgd import Settings

#: Numbers of the methods (fixed values).
METHODS = {
    "tf_idf": 1, "paragraph_vectors": 2, "retrofitted": 5, "regularised": 6, "first_sentence": 21, "averaged_words": 80, "retrofitted_chain": 82,
    "regularised_chain": 83, "adjacent_sums": 84, "joint_chain": 85, "joint": 86, "phrase_sums": 90,
}


def _with_unit(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", "v", vec.normalised(F.col("v")).alias("unit"))


def _side_by_side(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), key).select(key, F.concat("v", "w").alias("v"))


def _both_kinds(sentences: DataFrame, s: Settings, wanted: str) -> tuple[DataFrame, DataFrame]:
    """What skip-gram learns, and what the mean of words to the left does, with steps twice as large."""
    return learners.learn(sentences, replace(s, bag=False), wanted=wanted), learners.learn(sentences, replace(s, bag=True, alpha=2 * s.alpha), wanted=wanted)


def paragraph_vectors(sentences: DataFrame, s: Settings) -> DataFrame:
    """Sentence vectors of both kinds side by side: ``2 * s.dims`` numbers."""
    kind = sentences.schema["id"].dataType.simpleString()
    a, b = (learners.sentence_vectors(x, kind) for x in _both_kinds(sentences, s, "sentences"))
    return _with_unit(_side_by_side(a, b, "id"))


def document_vectors(docs: DataFrame, s: Settings, least: int = 9) -> DataFrame:
    """Paragraph vectors of whole documents (``id, tokens``), those of fewer than ``least`` tokens filled up in front with ``null``."""
    pad = F.array_repeat(F.lit("null"), F.greatest(least - F.size("tokens"), F.lit(0)))
    return paragraph_vectors(docs.select("id", F.concat(pad, "tokens").alias("tokens")), s)


def averaged_words(sentences: DataFrame, s: Settings) -> DataFrame:
    """The mean of a sentence's word vectors of both kinds, side by side; sentences without words give no row."""
    a, b = (learners.word_vectors(x) for x in _both_kinds(sentences, s, "words"))
    return _with_unit(spaces.word_sums(sentences, _side_by_side(a, b, "term"), ["id"]))


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges once each way, sentences by row name, all of weight 1."""
    rows = graphs.undirected(edges.select("a", "b", F.lit(1.0).alias("weight"))).filter("a <> b")
    return rows.select(learners.sentence_row(F.col("a")).alias("a"), learners.sentence_row(F.col("b")).alias("b"), "weight")


def chain(sentences: DataFrame) -> DataFrame:
    """``a, b``: each sentence and the next of its document."""
    following = sentences.select("doc", (F.col("pos") - 1).alias("pos"), F.col("id").alias("b"))
    return sentences.select("doc", "pos", F.col("id").alias("a")).join(following, ["doc", "pos"]).select("a", "b")


def similar(sentences: DataFrame, vectors: DataFrame, k: int = 20, intra: float = 0.8, inter: float = 0.5) -> DataFrame:
    """``a, b, weight``: the context graph of the unit vectors."""
    return graphs.context_graph(vectors.join(sentences.select("id", "doc"), "id").select("id", "doc", F.col("unit").alias("v")), k, intra, inter)


def retrofitted(vectors: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Vectors (``id, v``) drawn towards their neighbours' over edges ``a, b``."""
    both = graphs.undirected(edges.select("a", "b", F.lit(1.0).alias("weight"))).filter("a <> b").select("a", "b")
    return graphs.retrofit(vectors.select("id", "v"), both, rounds)


def regularised(sentences: DataFrame, edges: DataFrame, s: Settings, beta: float) -> DataFrame:
    """Sentence vectors that are pulled to their neighbours' at every step: ``2 * s.dims`` numbers."""
    state = learners.learn(sentences, replace(s, dims=2 * s.dims, pull=beta), edges=_both_ways(edges), wanted="sentences")
    return _with_unit(learners.sentence_vectors(state, sentences.schema["id"].dataType.simpleString()))


def lexicon_regularised(sentences: DataFrame, edges: DataFrame, lexicon: DataFrame, s: Settings, beta: float) -> DataFrame:
    """As ``regularised``, with words pulled to the words that a lexicon (``src, dst``) puts beside them."""
    words = graphs.undirected(lexicon.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight"))).filter("a <> b")
    words = words.select(learners.word_row(F.col("a")).alias("a"), learners.word_row(F.col("b")).alias("b"), "weight")
    state = learners.learn(sentences, replace(s, dims=2 * s.dims, pull=beta), edges=_both_ways(edges).unionByName(words), wanted="sentences")
    return _with_unit(learners.sentence_vectors(state, sentences.schema["id"].dataType.simpleString()))


def joint(sentences: DataFrame, edges: DataFrame, s: Settings, strength: float, every: bool = False, labels: DataFrame | None = None, both: bool = False) -> DataFrame:
    """Sentence vectors that predict their words and their neighbours (one at a time, or with ``every`` all), and are pulled to them.

    With ``labels`` (``id, label``) they predict those too.  ``2 * s.dims`` numbers, or with ``both`` the two kinds of learners side by side.
    """
    kind = sentences.schema["id"].dataType.simpleString()
    own = replace(s, predict="all" if every else "one", pull=strength, dims=s.dims if both else 2 * s.dims)
    found = learners.sentence_vectors(learners.learn(sentences, own, edges=_both_ways(edges), labels=labels, wanted="sentences"), kind)
    if both:
        bags = learners.learn(sentences, replace(s, bag=True, alpha=2 * s.alpha), wanted="sentences")
        found = _side_by_side(found, learners.sentence_vectors(bags, kind), "id")
    return _with_unit(found)


def node_vectors(edges: DataFrame, s: Settings, per_node: int = 10, length: int = 6, init: DataFrame | None = None, beta: float = 0.0) -> DataFrame:
    """Vectors of a graph's nodes from biased walks, whose nodes are read as words; given first vectors (``id, v``) may also anchor them (``beta``)."""
    walks = graphs.random_walks(edges, per_node, length)
    texts = walks.select(F.concat_ws("-", "start", "walk").alias("id"), F.transform("path", lambda x: x.cast("string")).alias("tokens"))
    given = None if init is None else init.select(learners.word_row(F.col("id").cast("string")).alias("row"), "v")
    state = learners.learn(texts, replace(s, dims=2 * s.dims, sentence_token=False, anchor=beta), init=given, anchors=given if beta else None, wanted="words")
    kind = edges.schema["a"].dataType.simpleString()
    return _with_unit(learners.word_vectors(state).select(F.col("term").cast(kind).alias("id"), "v"))


def adjacent_sums(sentences: DataFrame, s: Settings, itself: bool = False) -> DataFrame:
    """Sums of word vectors that learned to predict the words of adjacent sentences."""
    return phrase_sums(sentences, learners.word_vectors(learners.learn_adjacent(sentences, s, itself, wanted="words")))


def phrase_sums(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """Sums of given word vectors (``term, v``); unknown words are left out, sentences without a known word have no row."""
    return _with_unit(spaces.word_sums(sentences, words, ["id"], "sum"))
