"""Recurrent layers against plain loops, finite differences and enumeration; learning, generation and scores on Spark."""

import itertools
import math

import numpy as np
import pytest

from textloom.operators import recurrent as rec

S = rec.Settings(word_dims=5, dims=6, words=9, steps=3, seed=1)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(7)
    return {k: (x + rng.normal(0, 0.3, x.shape)).astype(np.float64) for k, x in rec.first_model(S, 9).items()}


def one_by_one(m, name, words, h):
    """A gated layer, number by number."""
    n, states = len(h), []
    for x in words:
        gate = [1 / (1 + math.exp(-(sum(x[i] * m[f"{name}_W"][i, j] for i in range(len(x))) + m[f"{name}_b"][j] + sum(h[i] * m[f"{name}_U"][i, j] for i in range(n))))) for j in range(2 * n)]
        new = []
        for j in range(n):
            c = math.tanh(gate[j] * sum(h[i] * m[f"{name}_Ux"][i, j] for i in range(n)) + sum(x[i] * m[f"{name}_Wx"][i, j] for i in range(len(x))) + m[f"{name}_bx"][j])
            new.append(gate[n + j] * h[j] + (1 - gate[n + j]) * c)
        h = new
        states.append(h)
    return states


def share(m, h):
    x = [math.exp(sum(h[i] * m["out"][i, w] for i in range(len(h))) + m["out_b"][w]) for w in range(m["out"].shape[1])]
    return [y / sum(x) for y in x]


def plain_log_p(m, name, context, words):
    h = [math.tanh(sum(context[i] * m[f"{name}_F"][i, j] for i in range(len(context))) + m[f"{name}_f"][j]) for j in range(len(context))]
    before = [np.zeros(m["words"].shape[1]), *(m["words"][w] for w in words)]
    return sum(math.log(share(m, h)[w]) for h, w in zip(one_by_one(m, name, before, h), [*words, 0]))


def test_layer_equals_plain_loop_and_padding_changes_nothing(model):
    rows = [[2, 3, 4, 8], [5], [7, 7, 1]]
    got = rec._last_states(model, "encoder", rows, False, True)
    for r, v in zip(rows, got):
        assert np.allclose(v, one_by_one(model, "encoder", [model["words"][w] for w in [*r, 0]], [0.0] * 6)[-1], atol=1e-6)
        assert np.allclose(v, rec._last_states(model, "encoder", [r], False, True)[0], atol=1e-6)
    assert np.allclose(np.linalg.norm(rec._last_states(model, "encoder", rows, True, True), axis=1), 1, atol=1e-6)


def test_gradient_equals_finite_differences(model):
    rows, others = [[2, 3], [4], [5, 6, 7]], {"next": [[3, 4, 8], None, [2]], "last": [None, [6], []]}
    g = {k: np.zeros_like(x) for k, x in model.items()}
    loss = rec.loss_gradient(model, rows, others, g)
    contexts = rec._last_states(model, "encoder", rows, False, True)
    plain = sum(plain_log_p(model, name, contexts[k], r) for name, some in others.items() for k, r in enumerate(some) if r is not None)
    assert loss == pytest.approx(-plain, rel=1e-5)
    rng, none = np.random.default_rng(5), {k: np.zeros_like(x) for k, x in model.items()}
    for key, x in model.items():
        for at in rng.choice(x.size, min(5, x.size), replace=False):
            sides = []
            for by in (1e-5, -1e-5):
                moved = {k: y.copy() for k, y in model.items()}
                moved[key].ravel()[at] += by
                sides.append(rec.loss_gradient(moved, rows, others, {k: y.copy() for k, y in none.items()}))
            assert g[key].ravel()[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-6), key


def test_beams_are_greedy_at_one_and_everything_when_wide(model):
    contexts, longest = np.random.default_rng(2).normal(size=(4, 6)), 3
    for k, context in enumerate(contexts):
        every = []
        for n in range(longest + 1):
            for words in itertools.product([w for w in range(9) if w > 1], repeat=n):
                full = plain_log_p(model, "next", context, list(words)) if n < longest else None
                if full is not None:
                    every.append((-full, list(words)))
                else:  # unfinished: without its end
                    h = rec.first_state(model, "next", context[None])
                    cost, x = 0.0, np.zeros((1, 5))
                    for w in words:
                        h = rec.gated_step(model, "next", x, h)[0]
                        cost, x = cost - math.log(share(model, h[0])[w]), model["words"][[w]]
                    every.append((cost, list(words)))
        wide = rec.beams(model, "next", contexts, 1_000, longest)[k]
        assert [w for _, w in wide] == [w for _, w in sorted(every)]
        assert np.allclose([c for c, _ in wide], [c for c, _ in sorted(every)], atol=1e-6)
        ((cost, words),) = rec.beams(model, "next", contexts, 1, longest)[k]
        h, x, greedy = rec.first_state(model, "next", context[None]), np.zeros((1, 5)), []
        for _ in range(longest):
            h = rec.gated_step(model, "next", x, h)[0]
            p = share(model, h[0])
            p[1] = 0
            if np.argmax(p) == 0:
                break
            greedy.append(int(np.argmax(p)))
            x = model["words"][greedy[-1:]]
        assert words == greedy


def test_drawn_sentences_follow_the_shares_and_their_seed(model):
    context = np.random.default_rng(3).normal(size=(1, 6))
    some = rec.drawn(model, "next", np.repeat(context, 4_000, axis=0), list(range(4_000)), 1)
    p = share(model, one_by_one(model, "next", [np.zeros(5)], rec.first_state(model, "next", context)[0])[0])
    seen = np.bincount([w[0] if w else 0 for _, w in some], minlength=9)
    assert ((seen - 4_000 * np.array(p)) ** 2 / (4_000 * np.array(p))).sum() < 30  # chi-square, 8 degrees
    assert rec.drawn(model, "next", np.repeat(context, 5, axis=0), list(range(5)), 6)[3] == rec.drawn(model, "next", context, [3], 6)[0]


def test_learning_encoding_generation_and_scores(spark):
    pairs = [("red hot sun", "one two"), ("cold blue sea", "three four"), ("green old tree", "five six"), ("loud grey crow", "seven eight")]
    rows = [(2 * d + k, d, k, side.split()) for d in range(80) for k, side in enumerate(pairs[d % 4])] + [(900, 900, 0, []), (901, 901, 0, None), (902, 902, 0, ["red", None, "never"])]
    sentences = spark.createDataFrame(rows, "id long, doc long, pos int, tokens array<string>")
    s = rec.Settings(word_dims=16, dims=24, words=100, epochs=50, steps=1, rate=0.05)
    m, words, losses = rec.learn(sentences, s)
    assert words.count() == len({w for p in pairs for side in p for w in side.split()}) + 1 and losses[-1] < 0.5 * losses[0]
    vectors = rec.encode(sentences, m, words, unit=False).persist()
    found = {r["id"]: r["v"] for r in vectors.collect()}
    assert len(found) == len(rows) and not any(found[900]) and not any(found[901]) and any(found[902])
    assert np.allclose(found[0], found[8]) and len(found[0]) == 24
    best = {r["id"]: r for r in rec.generate(vectors.filter("id < 8"), m, words, k=3).filter("place = 0").collect()}
    assert [best[2 * d]["tokens"] for d in range(4)] == [p[1].split() for p in pairs]
    following = sentences.filter("pos = 1").selectExpr("id - 1 as id", "tokens")
    scored = rec.reconstruction(vectors, following.filter("id < 8"), m, words)
    got = {r["id"]: (r["n"], r["log_p"]) for r in scored.collect()}
    assert got[0][0] == 3 and got[0][1] == pytest.approx(-best[0]["cost"], rel=1e-3)
    whole = rec.perplexity(scored).first()
    assert whole["n"] == 12 and whole["perplexity"] == pytest.approx(math.exp(-sum(x for _, x in got.values()) / 12))
    again = [rec.generate(vectors.filter("id < 8"), m, words, draw=5).orderBy("id").collect() for _ in range(2)]
    assert again[0] == again[1] and len(again[0]) == 8
    assert rec.encode(sentences.limit(0), m, words).count() == 0
    vectors.unpersist()


def test_summed_gradient_equals_one_pass(spark):
    m = rec.first_model(S, 9)
    rows = [([2, 3], [4, 5], None), ([6], None, [7, 8, 2]), ([5, 5, 5], [3], []), ([8], [2], [4])]
    g, loss, n = rec.summed_gradient(spark.createDataFrame(rows * 5, "ids array<int>, next array<int>, last array<int>").repartition(3), m)
    want = {k: np.zeros_like(x) for k, x in m.items()}
    one = rec.loss_gradient(m, [r[0] for r in rows], {"next": [r[1] for r in rows], "last": [r[2] for r in rows]}, want)
    assert n == 20 and loss == pytest.approx(5 * one, rel=1e-5)
    assert all(np.allclose(g[k], 5 * want[k], rtol=1e-3, atol=1e-5) for k in want)
    none, zero, rows = rec.summed_gradient(spark.createDataFrame([], "ids array<int>, next array<int>, last array<int>"), m)
    assert rows == 0 and zero == 0 and not any(x.any() for x in none.values())
