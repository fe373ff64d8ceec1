"""Learners: single blocks against plain loops, gradients against finite differences, whole runs against what must be learned."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import graphs, learners, sgd
from textloom.operators.sgd import Lists, Settings

PLAIN = Settings(dims=5, window=3, negative=2, alpha=0.1, epochs=2, sample=0, batch=1, block_words=10**9, seed=3)


def small_block(seed=0, sentences=6, **more):
    """Rows 0-5 are sentence tokens, 6-15 words; vectors are no zeros, so that every gradient counts."""
    r = np.random.default_rng(seed)
    tokens, begins = [], [0]
    for k in range(sentences):
        tokens += [k, *r.integers(6, 16, r.integers(0, 7))]
        begins.append(len(tokens))
    n = 18
    pool = np.where((np.arange(n) < 16), r.random(n) + 0.1, 0)
    return sgd.Block(r.normal(size=(n, 5)), r.normal(size=(n, 5)), np.array(tokens), np.array(begins), np.ones(n), pool, np.where(np.arange(n) < 6, 1.0, 0), **more)


def sigma(x):
    return 1.0 if x > 6 else 0.0 if x < -6 else 1 / (1 + math.exp(-x))


def logistic(vectors, v, targets, alpha):
    """The error for v of one step with (row, label) targets; the targets' rows are moved."""
    gain = [(t, label - sigma(float(vectors[t] @ v))) for t, label in targets]
    error = sum((alpha * g * vectors[t] for t, g in gain), np.zeros_like(v))
    for t, g in gain:
        vectors[t] = vectors[t] + alpha * g * v
    return error


def plain_loop(block, s, epoch, rng, near={}, weights={}, labels={}, heads=(), anchors={}):
    """The sequential rule, pair by pair, with the same draws."""
    x, y = block.inputs.copy(), block.outputs.copy()
    rng.random(len(block.tokens))  # nothing is left out
    b = rng.integers(0, s.window, len(block.tokens))
    alpha = s.alpha * max(1e-4, 1 - epoch / s.epochs)

    def wrong(pool, right):
        rows = np.flatnonzero(pool > 0)
        upto = np.cumsum(pool[rows])
        found = [int(rows[min(np.searchsorted(upto, u * upto[-1], "right"), len(rows) - 1)]) for u in rng.random((1, s.negative))[0]]
        return [(w, 0) for w in found if w != right]

    if s.bag:
        for k in range(len(block.begins) - 1):
            sen = [int(t) for t in block.tokens[block.begins[k] : block.begins[k + 1]]]
            for i, word in enumerate(sen):
                skip = int(b[block.begins[k] + i])
                rows = [sen[i - s.window + a] for a in range(skip, s.window + 1 - skip) if a != s.window and i - s.window + a > 0] + [sen[0]]
                h = sum((x[r] for r in rows), np.zeros(5)) / len(rows)
                error = logistic(y, h, [(word, 1), *wrong(block.pool, word)], alpha)
                for r in rows:
                    x[r] = x[r] + error
        return x, y
    for k in range(len(block.begins) - 1):
        sen = [int(t) for t in block.tokens[block.begins[k] : block.begins[k + 1]]]
        for i, word in enumerate(sen):
            skip = int(b[block.begins[k] + i])
            places = [i - s.window + a for a in range(skip, 2 * s.window + 1 - skip) if a != s.window]
            for c in [c for c in places if 0 <= c < len(sen)] + [0]:
                row = sen[c]
                if s.negative:
                    x[row] = x[row] + logistic(y, x[row], [(word, 1), *wrong(block.pool, word)], alpha)
                mine = near.get(row, [])
                if mine and s.predict == "one":
                    chosen = [mine[min(int(rng.random(1)[0] * len(mine)), len(mine) - 1)]]
                elif mine and s.predict == "all":
                    n = len(mine) // len(sen)
                    chosen = mine[i : i + 1] if not n else mine[n * i :] if i == len(sen) - 1 else mine[n * i : n * (i + 1)]
                else:
                    chosen = []
                if chosen and s.negative:
                    # A batch takes its draws together, and moves the row by the sum.
                    steps = [[(t, 1)] for t in chosen]
                    u = rng.random((len(chosen), s.negative))
                    rows = np.flatnonzero(block.near_pool > 0)
                    upto = np.cumsum(block.near_pool[rows])
                    for step, us, t in zip(steps, u, chosen):
                        step += [(w, 0) for w in (int(rows[min(np.searchsorted(upto, v * upto[-1], "right"), len(rows) - 1)]) for v in us) if w != t]
                    before = y.copy()
                    total, moved = np.zeros(5), np.zeros_like(y)
                    for step in steps:
                        here = before.copy()
                        total += logistic(here, x[row], step, alpha)
                        moved += here - before
                    y += moved
                    x[row] = x[row] + total
                if row in labels:
                    w = np.exp([y[h] @ x[row] for h in heads])
                    gain = [alpha * ((h == labels[row]) - p) for h, p in zip(range(len(heads)), w / w.sum())]
                    error = sum(g * y[h] for g, h in zip(gain, heads))
                    for g, h in zip(gain, heads):
                        y[h] = y[h] + g * x[row]
                    x[row] = x[row] + error
                if mine and s.pull:
                    x[row] = x[row] + alpha * s.pull / len(mine) * sum(weights[row, j] * (x[j] - x[row]) for j in mine)
                if row in anchors and s.anchor:
                    x[row] = x[row] + alpha * s.anchor * (anchors[row] - x[row])
    return x, y


NEAR = {0: [1, 2], 1: [0], 2: [0, 3, 4, 5], 4: [2], 7: [8, 9]}
WEIGHTS = {(a, b): 0.5 + b / 10 for a, bs in NEAR.items() for b in bs}


def with_near(block):
    pairs = [(a, b) for a, bs in NEAR.items() for b in bs]
    block.near = Lists.of(18, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), np.array([WEIGHTS[p] for p in pairs]))
    return block


@pytest.mark.parametrize("more", [{}, {"bag": True}, {"predict": "one"}, {"predict": "all"}, {"pull": 0.8}, {"predict": "one", "pull": 0.5}, {"anchor": 0.7}, {"negative": 0, "pull": 1.0, "anchor": 1.0}])
def test_a_block_equals_a_plain_loop(more):
    s = replace(PLAIN, **more)
    block = small_block(1)
    anchors = {}
    if not s.bag:
        with_near(block)
    if s.anchor:
        block.anchors, block.anchored = np.random.default_rng(9).normal(size=(18, 5)), np.arange(18) % 2 == 0
        anchors = {k: block.anchors[k] for k in range(0, 18, 2)}
    x, y = plain_loop(block, s, 1, np.random.default_rng(4), {} if s.bag else NEAR, WEIGHTS, anchors=anchors)
    start = block.inputs.copy()
    sgd.train(block, s, 1, np.random.default_rng(4))
    assert np.allclose(block.inputs, x) and np.allclose(block.outputs, y)
    assert not np.allclose(block.inputs, start)


def test_labels_equal_a_plain_loop():
    block = small_block(2, label=np.array([0, 1, -1, 1, 0, -1] + [-1] * 12), label_rows=np.array([16, 17]))
    x, y = plain_loop(block, PLAIN, 0, np.random.default_rng(4), labels={0: 0, 1: 1, 3: 1, 4: 0}, heads=(16, 17))
    sgd.train(block, PLAIN, 0, np.random.default_rng(4))
    assert np.allclose(block.inputs, x) and np.allclose(block.outputs, y)


def test_many_pulls_at_once_are_as_many_one_by_one():
    many, one = with_near(small_block(3)), with_near(small_block(3))
    s = replace(PLAIN, negative=0, pull=0.9)
    sgd._after_pairs(many, np.array([2] * 7), np.zeros(7, int), np.ones(7, int), s, None, 0.1)
    for _ in range(7):
        sgd._after_pairs(one, np.array([2]), np.zeros(1, int), np.ones(1, int), s, None, 0.1)
    assert np.allclose(many.inputs, one.inputs)


def test_codes_follow_the_gradient():
    r = np.random.default_rng(5)
    codes = Lists(np.array([0, 2, 3, 3]), np.array([0, 1, 0]), np.array([1.0, 0.0, 0.0]))
    block = sgd.Block(r.normal(size=(3, 4)), r.normal(size=(3, 4)), np.zeros(0, int), np.zeros(1, int), np.ones(3), np.zeros(3), np.zeros(3), codes=codes)
    hidden, words, before = r.normal(size=(2, 4)), np.array([0, 1]), block.outputs.copy()

    def loss(h, out):
        return -sum(math.log(sigma((1 - 2 * bit) * float(out[node] @ h[k]))) for k, bits in enumerate([[(0, 1), (1, 0)], [(0, 0)]]) for node, bit in bits)

    error = sgd.along_codes(block, hidden, words, 1.0)
    assert block.loss == pytest.approx(loss(hidden, before))
    for at in np.ndindex(2, 4):
        step = np.zeros((2, 4))
        step[at] = 1e-6
        assert error[at] == pytest.approx(-(loss(hidden + step, before) - loss(hidden - step, before)) / 2e-6, abs=1e-5)
    for at in np.ndindex(2, 4):
        step = np.zeros((3, 4))
        step[at] = 1e-6
        assert (block.outputs - before)[at] == pytest.approx(-(loss(hidden, before + step) - loss(hidden, before - step)) / 2e-6, abs=1e-5)


def two_themes(spark, n=160, seed=2):
    """Sentences of two vocabularies that share a few words; ten sentences a document, one theme each."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        theme = k // 10 % 2
        rows.append((k, k // 10, k % 10, [r.choice([f"{'ab'[theme]}{i}" for i in range(15)] + ["the", "of"]) for _ in range(r.randrange(6, 14))], theme))
    return spark.createDataFrame(rows, "id long, doc long, pos int, tokens array<string>, theme int"), [x[4] for x in rows]


def separated(vectors, themes):
    """The share of sentences nearer to their own theme's mean direction than to the other's."""
    v = np.array([x.v for x in sorted(vectors.collect(), key=lambda x: x.id)])
    v = v - v.mean(axis=0)
    themes = np.array(themes)
    means = np.stack([v[themes == k].mean(axis=0) for k in (0, 1)])
    return float((np.argmax(v @ means.T, axis=1) == themes).mean())


SMALL = Settings(dims=12, window=4, negative=4, alpha=0.1, epochs=6, sample=0, batch=64, block_words=700, pool=500)


@pytest.mark.parametrize("bag", [False, True])
def test_sentence_vectors_tell_themes_apart(spark, bag):
    sentences, themes = two_themes(spark)
    state = learners.learn(sentences, replace(SMALL, bag=True, alpha=0.2, epochs=12) if bag else SMALL)
    loss = [x.loss for x in learners.losses(state).orderBy("epoch").collect()]
    assert len(loss) == (12 if bag else 6) and loss[-1] < loss[0] - 0.05
    assert separated(learners.sentence_vectors(state, "long"), themes) > 0.95
    assert learners.word_vectors(state).count() == 32


def chain(sentences):
    both = sentences.select("doc", "pos", "id")
    ahead = both.select("doc", (F.col("pos") - 1).alias("pos"), F.col("id").alias("b"))
    e = both.join(ahead, ["doc", "pos"]).select(learners.sentence_row(F.col("id")).alias("a"), learners.sentence_row(F.col("b")).alias("b"), F.lit(1.0).alias("weight"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def test_neighbours_bring_sentences_together(spark):
    sentences, themes = two_themes(spark)
    plain = learners.sentence_vectors(learners.learn(sentences, SMALL), "long")
    joint = learners.sentence_vectors(learners.learn(sentences, replace(SMALL, predict="one", pull=1.0), edges=chain(sentences)), "long")

    def apart(vectors):
        v = {x.id: np.array(x.v) / np.linalg.norm(x.v) for x in vectors.collect()}
        return np.mean([v[k] @ v[k + 1] for k in range(159) if k % 10 < 9])

    assert separated(joint, themes) > 0.95 and apart(joint) > apart(plain) + 0.02


def test_pull_and_anchor_end_where_retrofitting_ends(spark):
    values = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0]), (0, 3, [1.0, 1.0]), (0, 9, [5.0, 5.0])], "g long, id long, v array<double>")
    edges = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0)], "g long, a long, b long, weight double")
    want = {x.id: x.v for x in graphs.retrofit_groups(values, edges, 80).collect()}
    rows = values.select(learners.sentence_row(F.col("id")).alias("row"), "v")
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = both.select(*[learners.sentence_row(F.col(c)).alias(c) for c in "ab"], "weight")
    sentences = values.select("id", F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("tokens"))
    s = Settings(dims=2, negative=0, alpha=0.5, epochs=60, pull=1.0, anchor=1.0, sample=0, batch=1)
    s = replace(s, epochs=8)
    got = {x.id: x.v for x in learners.sentence_vectors(learners.learn(sentences.withColumn("tokens", F.array_repeat(F.lit("x"), 40)), s, edges=both, init=rows, anchors=rows), "long").collect()}
    assert all(np.allclose(got[k], want[k], atol=0.03) for k in want)


def test_labels_help_and_given_vectors_are_checked(spark):
    sentences, themes = two_themes(spark)
    labels = sentences.filter("doc % 4 < 3").select("id", F.concat(F.lit("theme"), "theme").alias("label"))
    state = learners.learn(sentences, replace(SMALL, epochs=3), labels=labels)
    assert separated(learners.sentence_vectors(state, "long"), themes) > 0.95
    heads = {x.row: np.array(x.v) for x in state.filter("row like 'l%'").collect()}
    v = {x.id: np.array(x.v) for x in learners.sentence_vectors(state, "long").collect()}
    held = [k for k in v if k // 10 % 4 == 3]
    assert np.mean([(v[k] @ heads["ltheme1"] > v[k] @ heads["ltheme0"]) == bool(themes[k]) for k in held]) > 0.9
    with pytest.raises(ValueError):
        learners.learn(sentences, SMALL, init=spark.createDataFrame([("s1", [1.0])], "row string, v array<double>"))


def test_adjacent_sentences_are_predicted(spark):
    sentences, themes = two_themes(spark)
    context = {x.id: x.context for x in learners.adjacent(sentences).collect()}
    own = {x.id: x.tokens for x in sentences.collect()}
    assert context[0] == own[1] and context[5] == own[4] + own[6] and context[9] == own[8]
    state = learners.learn_adjacent(sentences, replace(SMALL, epochs=8))
    loss = [x.loss for x in learners.losses(state).orderBy("epoch").collect()]
    assert loss[-1] < loss[0]
    words = {x.term: np.array(x.v) for x in learners.word_vectors(state).collect()}
    v = {k: sum(words[w] for w in ws) for k, ws in own.items()}
    unit = {k: x / np.linalg.norm(x) for k, x in v.items()}
    near = np.mean([unit[k] @ unit[k + 1] for k in range(159) if k % 10 < 9])
    far = np.mean([unit[k] @ unit[(k * 37 + 11) % 160] for k in range(160)])
    assert near > far + 0.1


def test_pools_follow_the_power_of_counts(spark):
    counts = spark.createDataFrame([(f"r{i}", 1 + i * i) for i in range(60)], "row string, n long")
    got = learners.drawn_pool(counts, blocks=8, size=400, seed=1, epoch=0).groupBy("row").agg(F.sum("share").alias("s")).collect()
    power = {f"r{i}": (1 + i * i) ** 0.75 for i in range(60)}
    assert all(abs(x.s - 3200 * power[x.row] / sum(power.values())) <= 1 for x in got)
    assert sum(x.s for x in got) == pytest.approx(3200, abs=60)


def test_nulls_and_an_empty_table(spark):
    rows = [(1, ["a", None, "b"]), (None, ["c"]), (2, None), (2, ["a"])]
    state = learners.learn(spark.createDataFrame(rows, "id long, tokens array<string>"), replace(SMALL, epochs=1))
    assert sorted(x.id for x in learners.sentence_vectors(state, "long").collect()) == [1, 2]
    assert sorted(x.term for x in learners.word_vectors(state).collect()) == ["a", "b"]
    assert learners.learn(spark.createDataFrame([], "id long, tokens array<string>"), replace(SMALL, epochs=1)).count() == 0
