"""The class-factored model against plain loops, finite differences and sums to one; bigrams, scores, draws and choices by brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import language as lm
from textloom.operators import optimisers

S = lm.Settings(dims=5, words=12, classes=3, order=3, cells=64)
BOUNDS = np.array([0, 2, 5, 9])
ROWS = [[2, 3, 8], [], [4, -1, 7, 5, 1], [1]]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(7)
    return {k: (x + rng.normal(0, 0.5, x.shape)).astype(np.float64) for k, x in lm.first_model(S, 9, 3).items()}


def plain_shares(m, h, history):
    """Probability of every word, number by number."""
    def softmax(part, table, lo, hi, key):
        cells = lm.first_cells(np.array([history]), np.array([key]), 3, 64)[0]
        x = []
        for c in range(lo, hi):
            x.append(sum(h[i] * m[part][i, c] for i in range(5)) + sum(m[table][(cell + c - lo) % 64] for cell in cells if cell >= 0))
        top = [math.exp(v) for v in x]
        return [v / sum(top) for v in top]

    groups = softmax("classes", "class_cells", 0, 3, 0)
    return [groups[c] * p for c in range(3) for p in softmax("out", "word_cells", BOUNDS[c], BOUNDS[c + 1], c + 1)]


def plain_logs(m, words):
    h, last, history, out = [1.0] * 5, 0, [0, 0], []
    for w in [*words, 0]:
        h = [1 / (1 + math.exp(-((m["words"][last, j] if last >= 0 else 0) + sum(h[i] * m["again"][i, j] for i in range(5))))) for j in range(5)]
        p = plain_shares(m, h, history)
        assert sum(p) == pytest.approx(1)
        out.append(math.log(p[w]) if w >= 0 else math.nan)
        last, history = w, [w, history[0]]
    return out


def test_model_equals_plain_loop(model):
    got, loss, n = lm.run(model, BOUNDS, 3, ROWS)
    want = [plain_logs(model, r) for r in ROWS]
    assert all(np.allclose(a, b, equal_nan=True) for a, b in zip(got, want)) and [len(a) for a in got] == [4, 1, 6, 2]
    assert loss == pytest.approx(-np.nansum(np.concatenate(want))) and n == 12
    assert lm.run(model, BOUNDS, 3, [])[1:] == (0.0, 0)


def test_unknown_words_end_features():
    cells = lm.first_cells(np.array([[3, 4], [3, -1], [-1, 4]]), np.zeros(3, np.int64), 3, 1000)
    assert (cells[:, 0] >= 0).all() and cells[0, 0] == cells[2, 0] and cells[0, 1] == cells[1, 1]
    assert cells[1, 2] == cells[2, 1] == cells[2, 2] == -1 and cells[0, 2] >= 0


def test_gradient_equals_finite_differences(model):
    g = {k: np.zeros_like(x) for k, x in model.items()}
    lm.run(model, BOUNDS, 3, ROWS, g)
    rng = np.random.default_rng(5)
    for key, x in model.items():
        for at in rng.choice(x.size, 12, replace=False):
            sides = []
            for by in (1e-5, -1e-5):
                moved = {k: y.copy() for k, y in model.items()}
                moved[key].ravel()[at] += by
                sides.append(lm.run(moved, BOUNDS, 3, ROWS)[1])
            assert g[key].ravel()[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-6), key


def test_classes_share_the_roots():
    counts = np.array([400, 100, 100, 25, 25, 25, 25, 4, 4, 4, 1])
    bounds = lm.class_bounds(counts, 4)
    roots = np.sqrt(counts)
    assert bounds[0] == 0 and bounds[-1] == len(counts) and (np.diff(bounds) > 0).all() and len(bounds) <= 5
    for k, cut in enumerate(bounds[1:-1]):
        assert roots[:cut].sum() / roots.sum() > (k + 1) / 4 and roots[: cut - 1].sum() / roots.sum() <= (k + 1) / 4 + roots[cut - 1] / roots.sum()
    assert lm.class_bounds(np.array([5.0]), 100).tolist() == [0, 1] and lm.class_bounds(np.zeros(3), 2)[-1] == 3


@pytest.mark.parametrize("rule", list(optimisers.RULES))
def test_rules_go_down(rule):
    m, state = {"x": np.array([3.0, -2.0])}, {}
    f = lambda: float((m["x"] ** 2).sum())
    first = f()
    for _ in range(400):
        optimisers.RULES[rule](m, {"x": 2 * m["x"]}, state, 0.01)
    assert f() < (0.95 if rule == "adadelta" else 0.2) * first
    assert np.linalg.norm(optimisers.shortened({"a": np.array([3.0]), "b": np.array([4.0])}, 1.0)["b"]) == pytest.approx(0.8)


def test_rules_equal_their_formulas():
    g = np.array([0.5, -2.0])
    for rule, want in (("sgd", -0.1 * g), ("adam", -0.1 * np.sign(g)), ("adadelta", -g * np.sqrt(1e-6 / (0.05 * g * g + 1e-6))),
                       ("rmsprop", -0.1 * g / np.sqrt(0.05 * g * g - (0.05 * g) ** 2 + 1e-4))):
        m = {"x": np.zeros(2)}
        optimisers.RULES[rule](m, {"x": g}, {}, 0.1)
        assert np.allclose(m["x"], want, atol=1e-6), rule


TEXTS = ["red hot sun", "cold blue sea", "red hot sun", "green old tree", "red old sea"]


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(k, TEXTS[k % 5].split()) for k in range(300)] + [(900, []), (901, None), (902, ["red", None, "never"])]
    sentences = spark.createDataFrame(rows, "id long, tokens array<string>")
    return sentences, *lm.learn(sentences, lm.Settings(dims=8, words=50, classes=3, cells=1 << 10, epochs=12, steps=1, rate=0.05, held=10))


def test_learning_and_scores(spark, taught):
    sentences, language, seen = taught
    assert seen[-1] > seen[0] and seen[-1] > -1.2
    each = lm.word_probabilities(sentences, language).collect()
    by = {}
    for r in each:
        by.setdefault(r["id"], {})[r["pos"]] = r["p"]
    assert len(by) == 303 and len(by[0]) == 4 and len(by[900]) == len(by[901]) == 1 and len(by[902]) == 4
    ids = {r["term"]: r["id"] - 1 for r in language.words.collect()}
    m = language.m
    want = lm.run(m, language.bounds, 3, [[ids[w] for w in "red hot sun".split()]])[0][0]
    assert np.allclose([math.log(by[0][k]) for k in range(4)], want, atol=1e-4)
    total = lm.score(lm.word_probabilities(sentences, language)).first()
    ps = [r["p"] for r in each if r["p"] is not None]
    assert total["words"] == len(ps) and total["perplexity"] == pytest.approx(10 ** (-sum(map(math.log10, ps)) / len(ps)))
    assert lm.word_probabilities(sentences.limit(0), language).count() == 0


def test_summed_gradient_equals_one_pass(spark, taught):
    _, language, _ = taught
    rows, bounds = [[1, 2, 3], [], [4, -1], [5]] * 10, language.bounds

    def teach(m, batch, g):
        _, loss, n = lm.run(m, bounds, 3, batch.column(0).to_pylist(), g)
        return loss, n

    frame = spark.createDataFrame([(r,) for r in rows], "ids array<int>").repartition(3)
    g, loss, n = lm.recurrent.summed(frame, language.m, teach)
    want = {k: np.zeros_like(x) for k, x in language.m.items()}
    _, one, some = lm.run(language.m, language.bounds, 3, rows, want)
    assert n == some and loss == pytest.approx(one, rel=1e-5) and all(np.allclose(g[k], want[k], atol=1e-3) for k in want)


def test_mixed_scores(spark):
    rows = [(1, 0.5, 0.25), (1, None, 0.1), (1, None, None), (2, 0.2, None), (2, None, 0.0)]
    words = spark.createDataFrame(rows, "id int, p double, other double")
    got = {r["id"]: r for r in lm.score(words, ["id"], 0.75).collect()}
    assert got[1]["words"] == 2 and got[1]["log_p"] == pytest.approx(math.log10(0.5) - 8)
    assert got[1]["other_log_p"] == pytest.approx(math.log10(0.025)) and got[1]["mixed_log_p"] == pytest.approx(math.log10(0.4375 * 0.025))
    assert got[2]["words"] == 1 and got[2]["other_log_p"] == -math.inf and got[2]["mixed_log_p"] == pytest.approx(math.log10(0.15))
    assert lm.score(words).first()["words"] == 2 and got[1]["mixed_perplexity"] == pytest.approx(10 ** (-got[1]["mixed_log_p"] / 2))


def test_bigrams_equal_brute_force(spark):
    taught = [["a", "b", "a"], ["b", "b"], [], None, ["a", None, "c"]]
    asked = [["a", "c", "z"], ["b", "a"], ["b", "a"], None]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, tokens array<string>")
    pairs = lambda rows: [(x, y) for r in rows for s in [["", *(w for w in r or [] if w is not None), ""]] for x, y in zip(s, s[1:])]
    n = Counter(pairs(taught))
    total = Counter(x for x, _ in pairs(taught))
    size = len({y for _, y in n})
    want = {(x, y): ((n[x, y] + 0.5) / (total[x] + 0.5 * size) if y in {b for _, b in n} else None, k) for (x, y), k in Counter(pairs(asked)).items()}
    found = lm.bigram_probabilities(frame(asked), frame(taught), 0.5)
    got = {(r["before"], r["term"]): (r["p"], r["times"]) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == (pytest.approx(want[k][0]) if want[k][0] else None) for k in want)
    at = {(r["id"], r["pos"]): r["other"] for r in lm.with_bigrams(frame(asked), found).collect()}
    assert len(at) == len(pairs(asked)) and at[0, 1] == pytest.approx(want["a", "c"][0]) and at[0, 2] is None and at[3, 0] == pytest.approx(want["", ""][0])


def test_choices_and_draws(spark, taught):
    _, language, _ = taught
    rows = [(1, 0, ["sun", "hot", "red"], None), (1, 1, ["red", "hot", "sun"], -1.0), (2, 0, ["never"], 0.0), (2, 1, ["never"], 0.0), (2, 2, None, -90.0)]
    choices = spark.createDataFrame(rows, "item int, choice int, tokens array<string>, other double")
    got = {(r["item"], r["choice"]): r for r in lm.rescored(choices, language, 0.5).collect()}
    assert got[1, 1]["place"] == 1 and [got[2, k]["place"] for k in range(3)] == [1, 2, 3]
    ids = {r["term"]: r["id"] - 1 for r in language.words.collect()}
    own = sum(lm.run(language.m, language.bounds, 3, [[ids[w] for w in "red hot sun".split()]])[0][0]) / math.log(10)
    assert got[1, 1]["log_p"] == pytest.approx(0.5 * own - 0.5, abs=1e-4)
    numbers = spark.range(3_000)
    some = {r["id"]: r["tokens"] for r in lm.drawn(numbers, language, 8).collect()}
    assert some == {r["id"]: r["tokens"] for r in lm.drawn(numbers, language, 8).collect()} and len(some) == 3_000
    p = {"": 0.0} | {t: 0.0 for t in ids}
    h = lm.sigmoid(language.m["words"][[0]] + np.ones((1, 8)) @ language.m["again"])
    for t, w in ({"": 0} | ids).items():
        p[t] = float(np.exp(lm.likelihoods(language.m, language.bounds, 3, h, np.zeros((1, 2), np.int64), np.array([w]))[0][0]))
    assert sum(p.values()) == pytest.approx(1, abs=1e-5)
    seen = Counter(r[0] if r else "" for r in some.values())
    assert sum((seen[t] - 3_000 * x) ** 2 / (3_000 * x) for t, x in p.items() if 3_000 * x > 5) < 40


def test_printed_probabilities(spark):
    lines = ["\tp( red | <s> ) \t= [2gram] 0.0125 [ -1.90309 ]", "\tp( </s> | sun ...) \t= [3gram] 1.5e-05 [ -4.8 ]", "1 sentences, 2 words", "", None]
    got = lm.printed_probabilities(spark.createDataFrame([(x,) for x in lines], "value string")).select(F.sort_array(F.collect_list("p"))).first()[0]
    assert got == [1.5e-05, 0.0125]
