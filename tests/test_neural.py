"""Neural classifiers against plain loops and finite differences; learning, choice of settings, and denoising encoders on Spark."""

import math

import numpy as np
import pytest

from textloom.operators import neural, recurrent, tokens
from textloom.operators.tuning import grid

ROWS = [[2, 3, 4, 8, 5], [], [7, 7], [1, 6, 2, 3], [5]]
LABELS = np.array([0, 1, 2, 1, 0])


def model(kind):
    rng = np.random.default_rng(7)
    s = neural.Settings(kind, word_dims=4, units=5, width=3, hidden=6)
    return s, {k: (x + rng.normal(0, 0.4, x.shape)).astype(np.float64) for k, x in neural.first_model(s, 9, 3).items()}


def sig(x):
    return 1 / (1 + math.exp(-x))


def plain(kind, m, words):
    """``log p``, number by number."""
    v = [m["words"][w] for w in words]
    if kind == "convolution":
        if not v:
            pooled = [0.0] * 5
        else:
            v = v + [np.zeros(4)] * (3 - len(v))
            pooled = [max(0.0, *(m["filters_b"][u] + sum(v[p + w][d] * m["filters"][w, d, u] for w in range(3) for d in range(4)) for p in range(len(v) - 2))) for u in range(5)]
        last = [max(0.0, m["hidden_b"][j] + sum(pooled[u] * m["hidden"][u, j] for u in range(5))) for j in range(6)]
    else:
        last, c = [0.0] * 5, [0.0] * 5
        for x in v:
            z = [m["b"][j] + sum(x[d] * m["W"][d, j] for d in range(4)) + sum(last[u] * m["U"][u, j] for u in range(5)) for j in range(20)]
            c = [sig(z[5 + u]) * c[u] + sig(z[u]) * math.tanh(z[15 + u]) for u in range(5)]
            last = [sig(z[10 + u]) * math.tanh(c[u]) for u in range(5)]
    out = [m["out_b"][k] + sum(last[j] * m["out"][j, k] for j in range(len(last))) for k in range(3)]
    total = math.log(sum(map(math.exp, out)))
    return [x - total for x in out]


@pytest.mark.parametrize("kind", list(neural.LAYERS))
def test_layers_equal_plain_loops(kind):
    _, m = model(kind)
    got = neural.LAYERS[kind](m, ROWS, None, None)
    assert np.allclose(got, [plain(kind, m, r) for r in ROWS])
    for r, logs in zip(ROWS, got):
        assert np.allclose(neural.LAYERS[kind](m, [r], None, None)[0], logs)


@pytest.mark.parametrize("kind", list(neural.LAYERS))
@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradient_equals_finite_differences(kind, dropout):
    s, m = model(kind)
    keep, layer = neural._kept(range(5), ROWS, neural.replace(s, dropout=dropout), 6 if kind == "convolution" else 5) if dropout else (None, None)
    loss = lambda x: -float(neural.LAYERS[kind](x, ROWS, keep, layer)[np.arange(5), LABELS].sum())
    g = {k: np.zeros_like(x) for k, x in m.items()}
    neural.LAYERS[kind](m, ROWS, keep, layer, LABELS, g)
    rng = np.random.default_rng(5)
    for key, x in m.items():
        for at in rng.choice(x.size, min(x.size, 12), replace=False):
            sides = []
            for by in (1e-6, -1e-6):
                moved = {k: y.copy() for k, y in m.items()}
                moved[key].ravel()[at] += by
                sides.append(loss(moved))
            assert g[key].ravel()[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, rel=1e-3, abs=1e-6), key


def test_dropout_follows_the_row_and_keeps_the_mean():
    s = neural.Settings(dropout=0.25)
    words, layer = neural._kept(range(400), [[1] * 30] * 400, s, 50)
    assert np.mean(words) == pytest.approx(1, abs=0.03) and layer.mean() == pytest.approx(1, abs=0.03) and np.unique(layer) == pytest.approx([0, 4 / 3])
    again, same = neural._kept([7], [[1] * 30], s, 50)
    assert (again[0] == words[7]).all() and (same[0] == layer[7]).all()


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(1)
    fill = "one two three four five six".split()
    rows = []
    for k in range(400):
        said = list(rng.choice(fill, rng.integers(2, 9)))
        at = rng.integers(0, len(said))
        said[at:at] = [["not", "good"], ["good", "not"]][k % 2]  # the order tells
        rows.append((k, said, ["bad", "fine"][k % 2]))
    return spark.createDataFrame(rows + [(900, [], None), (901, None, None), (902, ["never", None], None)], "id long, tokens array<string>, label string")


@pytest.mark.parametrize("kind,epochs", [("convolution", 25), ("memory", 60)])
def test_learning_tells_word_order(texts, kind, epochs):
    s = neural.Settings(kind, word_dims=8, units=12, hidden=8, epochs=epochs, steps=1, rate=0.03, dropout=0.1)
    c, losses = neural.learn(texts.filter("id < 300 or id >= 900"), s)
    assert c.labels == ["bad", "fine"] and losses[-1] < 0.6 * losses[0]
    found = {r["id"]: r for r in neural.classify(texts, c).collect()}
    assert len(found) == 403 and all(0 < r["p"] <= 1 for r in found.values())
    assert np.mean([found[k]["predicted"] == ["bad", "fine"][k % 2] for k in range(300, 400)]) > 0.9
    assert found[900]["predicted"] == found[901]["predicted"] and found[900]["p"] == pytest.approx(found[901]["p"])
    assert neural.macro_f1(texts.filter("id >= 300"), c) > 0.9
    assert neural.classify(texts.limit(0), c).count() == 0


def test_settings_are_chosen_by_macro_f1(spark, texts):
    s = neural.Settings(word_dims=8, units=12, hidden=8, steps=1, rate=0.03, dropout=0.0)
    found = neural.search(texts.filter("id < 300"), texts.filter("id between 300 and 399"), s, grid(epochs=[0, 20]))
    assert found.best == {"epochs": 20} and [p for p, _ in found.tried] == [{"epochs": 0}, {"epochs": 20}] and found.table(spark).count() == 2


def test_no_labels_is_an_error(texts):
    with pytest.raises(ValueError, match="labels"):
        neural.learn(texts.filter("label is null"), neural.Settings())


def test_denoising_encoder_finds_sentences_again(spark):
    said = ["red hot sun", "cold blue sea", "green old tree", "loud grey crow"]
    rows = [(k, said[k % 4].split()) for k in range(120)] + [(900, []), (901, None)]
    sentences = spark.createDataFrame(rows, "id long, tokens array<string>")
    s = recurrent.Settings(word_dims=24, dims=32, words=100, epochs=60, steps=1, rate=0.03)
    seen = []

    def noise(ids, key):
        seen.append(1)
        return tokens.removed(tokens.swapped(tokens.masked(ids, 0.34, key, recurrent.UNKNOWN), 0.5, key), 0.1, key)

    m, words, losses = recurrent.learn_denoising(sentences, s, noise)
    assert len(seen) == len(losses) == 60 and losses[-1] < 0.5 * losses[0]
    vectors = recurrent.encode(sentences.filter("id < 4"), m, words, unit=False)
    best = {r["id"]: r["tokens"] for r in recurrent.generate(vectors, m, words, k=3).filter("place = 0").collect()}
    assert best == {k: x.split() for k, x in enumerate(said)}
    corrupted = spark.createDataFrame([(k, ["never", *x.split()[1:]]) for k, x in enumerate(said)], "id long, tokens array<string>")
    found = recurrent.generate(recurrent.encode(corrupted, m, words, unit=False), m, words, k=3).filter("place = 0").collect()
    assert sum(r["tokens"] == said[r["id"]].split() for r in found) >= 3
    assert recurrent.learn_denoising(sentences, recurrent.Settings(word_dims=4, dims=4, words=20, steps=1))[2]
