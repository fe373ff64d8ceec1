"""Classifiers of texts by neural layers over word vectors: a convolution with the greatest value over all places, or long short-term memory.

Texts are read whole, whatever their length.  The model's size is set by ``Settings`` and the number of labels; it alone is held by the driver and
broadcast.  In a step of learning the tasks add up their texts' gradients (``recurrent.summed``).

Null tokens count as none; a text without words has a zero vector before the last layers, and so the label that the model gives to nothing.  A row
without a label does not teach; repeated rows teach as often.  Without any labelled row learning fails with a message; an empty table to classify gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import models, optimisers, recurrent, sgd
from textloom.operators.recurrent import CELLS, Model, log_softmax, orthogonal, sigmoid, weights
from textloom.operators.shared import Tables
from textloom.operators.tuning import Search

#: Labels that a model may have: each is a column of its last layer.
LABELS = 100_000


@dataclass(frozen=True)
class Settings:
    kind: str = "convolution"  # or "memory"
    word_dims: int = 64
    units: int = 64  # filters, or the size of the memory
    width: int = 3  # words under a filter
    hidden: int = 64  # of the layer between filters and labels
    words: int = 20_000
    dropout: float = 0.2  # of words, and of the hidden layer
    epochs: int = 5
    steps: int = 4  # of an epoch, each over another part of the texts
    rule: str = "adam"
    rate: float = 0.01
    clip: float = 5.0
    seed: int = 42


@dataclass(frozen=True)
class Classifier:
    m: Model
    words: DataFrame
    labels: list[str]
    settings: Settings


def first_model(s: Settings, words: int, labels: int) -> Model:
    rng = np.random.default_rng(s.seed)
    zeros = lambda n: np.zeros(n, np.float32)
    layer = lambda rows, columns: weights(rng, rows, columns, float(np.sqrt(6 / (rows + columns))))
    m = {"words": weights(rng, words, s.word_dims, 0.05)}
    if s.kind == "convolution":
        m |= {"filters": np.stack([weights(rng, s.word_dims, s.units, float(np.sqrt(6 / (s.width * s.word_dims + s.units)))) for _ in range(s.width)]), "filters_b": zeros(s.units)}
        return m | {"hidden": layer(s.units, s.hidden), "hidden_b": zeros(s.hidden), "out": layer(s.hidden, labels), "out_b": zeros(labels)}
    bias = zeros(4 * s.units)
    bias[s.units : 2 * s.units] = 1  # the gate that keeps the memory is open at first
    m |= {"W": layer(s.word_dims, 4 * s.units), "U": np.hstack([orthogonal(rng, s.units) for _ in range(4)]), "b": bias}
    return m | {"out": layer(s.units, labels), "out_b": zeros(labels)}


def _vectors(m: Model, ids: np.ndarray, on: np.ndarray) -> np.ndarray:
    x = m["words"].take(ids, axis=0)
    x *= on[..., None]
    return x


def _padded(rows: list[list[int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.zeros((len(rows), max([least, *map(len, rows)])), np.int64)
    lengths = np.array([len(r) for r in rows])
    for k, r in enumerate(rows):
        ids[k, : len(r)] = r
    return ids, lengths


def convolved(m: Model, rows: list[list[int]], keep: list[np.ndarray] | None, hidden_keep: np.ndarray | None, labels: np.ndarray | None = None, g: Model | None = None) -> np.ndarray:
    """``log p`` of each label; with ``g`` the gradient of the given labels' loss is added.

    ``keep`` weighs the words of each row (0: left out), ``hidden_keep`` the hidden layer.
    A filter stands at every place where it covers words only; over a text shorter than it, at the first.
    """
    width, dims, units = m["filters"].shape
    dtype = m["words"].dtype
    ids, lengths = _padded(rows, width)
    on = (np.arange(ids.shape[1]) < lengths[:, None]).astype(dtype)
    for k, w in enumerate(keep or []):
        on[k, : len(w)] *= w.astype(dtype)
    x, places = _vectors(m, ids, on), ids.shape[1] - width + 1
    y = m["filters"].transpose(0, 2, 1).reshape(width * units, dims) @ x.transpose(0, 2, 1)  # places lie side by side, for the search along them
    z = sum(y[:, w * units : (w + 1) * units, w : w + places] for w in range(width)) + m["filters_b"][:, None]
    for k, n in enumerate(np.maximum(lengths - width + 1, 1)):
        z[k, :, n:] = -np.inf
    at = z.argmax(axis=2)
    top = np.take_along_axis(z, at[:, :, None], axis=2)[:, :, 0]
    best = np.where(lengths[:, None] > 0, np.maximum(top, 0), 0).astype(dtype)
    a = best @ m["hidden"] + m["hidden_b"]
    b = a if hidden_keep is None else a * hidden_keep
    h = np.maximum(b, 0)
    logs = log_softmax(h @ m["out"] + m["out_b"])
    if g is None:
        return logs
    d = np.exp(logs)
    d[np.arange(len(rows)), labels] -= 1
    g["out"] += h.T @ d
    g["out_b"] += d.sum(axis=0)
    d = (d @ m["out"].T) * (b > 0)
    d = d if hidden_keep is None else d * hidden_keep
    g["hidden"] += best.T @ d
    g["hidden_b"] += d.sum(axis=0)
    d = (d @ m["hidden"].T) * (best > 0)
    g["filters_b"] += d.sum(axis=0)
    who = np.arange(len(rows))[:, None]
    for w in range(width):
        g["filters"][w] += np.einsum("bud,bu->du", x[who, at + w], d)
        sgd.add_rows(g["words"], ids[who, at + w].reshape(-1), (d * on[who, at + w])[..., None] * m["filters"][w].T)
    return logs


def remembered(m: Model, rows: list[list[int]], keep: list[np.ndarray] | None, hidden_keep: np.ndarray | None, labels: np.ndarray | None = None, g: Model | None = None) -> np.ndarray:
    """As ``convolved``, by the last state of a long short-term memory over the words; gates in, keep, out and the candidate."""
    dtype, n, units = m["words"].dtype, len(rows), m["U"].shape[0]
    ids, lengths = _padded(rows, 0)
    weigh = np.ones(ids.shape, dtype)
    for k, w in enumerate(keep or []):
        weigh[k, : len(w)] = w
    x = _vectors(m, ids, weigh)
    h, c, held = np.zeros((n, units), dtype), np.zeros((n, units), dtype), []
    for t in range(ids.shape[1]):
        on = (t < lengths)[:, None].astype(dtype)
        z = x[:, t] @ m["W"] + h @ m["U"] + m["b"]
        i, f, o = (sigmoid(z[:, k * units : (k + 1) * units]) for k in range(3))
        u = np.tanh(z[:, 3 * units :])
        new = f * c + i * u
        tanh = np.tanh(new)
        if g is not None:
            held.append((on, i, f, o, u, tanh, c, h))
        c, h = on * new + (1 - on) * c, on * (o * tanh) + (1 - on) * h
    last = h if hidden_keep is None else h * hidden_keep
    logs = log_softmax(last @ m["out"] + m["out_b"])
    if g is None:
        return logs
    d = np.exp(logs)
    d[np.arange(n), labels] -= 1
    g["out"] += last.T @ d
    g["out_b"] += d.sum(axis=0)
    dh, dc = d @ m["out"].T, np.zeros_like(c)
    dh = dh if hidden_keep is None else dh * hidden_keep
    for t in range(ids.shape[1] - 1, -1, -1):
        on, i, f, o, u, tanh, c, h = held[t]
        up, at = dh * on, dc * on
        at = at + up * o * (1 - tanh * tanh)
        dz = np.hstack([at * u * i * (1 - i), at * c * f * (1 - f), up * tanh * o * (1 - o), at * i * (1 - u * u)])
        g["W"] += x[:, t].T @ dz
        g["U"] += h.T @ dz
        g["b"] += dz.sum(axis=0)
        np.add.at(g["words"], ids[:, t], (dz @ m["W"].T) * weigh[:, t][:, None])
        dh, dc = dh * (1 - on) + dz @ m["U"].T, dc * (1 - on) + at * f
    return logs


LAYERS = {"convolution": convolved, "memory": remembered}


def _batches(rows: list[list[int]], m: Model, s: Settings, backward: bool) -> Iterator[list[int]]:
    a_word = s.word_dims + s.units * ((10 if backward else 3) if s.kind == "memory" else s.width + 2)
    return recurrent._batches([len(r) for r in rows], max(1, CELLS // a_word))


def _kept(seeds: Iterable[int], rows: list[list[int]], s: Settings, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Which words and numbers of the hidden layer a step keeps, weighed so that the mean stays; a row's seed alone decides."""
    words, layer = [], np.empty((len(rows), size), np.float32)
    for k, (seed, r) in enumerate(zip(seeds, rows)):
        rng = np.random.default_rng(seed % (1 << 63))
        layer[k] = (rng.random(size) >= s.dropout) / (1 - s.dropout)
        words.append((rng.random(len(r)) >= s.dropout) / (1 - s.dropout))
    return words, layer


def learn(texts: DataFrame, s: Settings) -> tuple[Classifier, list[float]]:
    """A classifier taught by ``id, tokens, label``, and the mean loss of each step."""
    tables = Tables(texts.sparkSession, "neural")
    taught = tables.put(texts.filter("label is not null").select("id", "tokens", F.col("label").cast("string").alias("label")), "taught")
    names = sorted(r["label"] for r in taught.select("label").distinct().limit(LABELS + 1).collect())
    if not 0 < len(names) <= LABELS:
        raise ValueError(f"labels must be 1 to {LABELS}, each is a part of the model")
    words = tables.put(recurrent.vocabulary(taught, s.words), "words")
    rows = recurrent.numbered_words(taught.withColumn("part", F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.lit(s.steps))), words)
    known = texts.sparkSession.createDataFrame(list(enumerate(names)), "y int, label string")
    rows = tables.put(rows.join(F.broadcast(known), "label").select("part", "id", "ids", "y"), "ids", "part")
    m, state, losses = first_model(s, words.count() + 2, len(names)), {}, []
    layers, size = LAYERS[s.kind], s.hidden if s.kind == "convolution" else s.units

    def teach(model: Model, batch: pa.RecordBatch, g: Model) -> tuple[float, int]:
        ids, y, seeds, loss = recurrent.lists(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_pylist(), 0.0
        for at in _batches(ids, model, s, True):
            some = [ids[k] for k in at]
            keep, layer = _kept([seeds[k] for k in at], some, s, size) if s.dropout else (None, None)
            logs = layers(model, some, keep, layer, y[at], g)
            loss -= float(logs[np.arange(len(at)), y[at]].sum())
        return loss, len(ids)

    for epoch in range(s.epochs):
        for k in range(s.steps):
            g, loss, n = recurrent.summed(rows.filter(F.col("part") == k).select("ids", "y", F.xxhash64(F.lit(s.seed + 1 + epoch), "id")), m, teach)
            if n:
                optimisers.RULES[s.rule](m, optimisers.shortened({key: x / n for key, x in g.items()}, s.clip), state, s.rate)
                losses.append(loss / n)
    return Classifier(m, words, names, s), losses


def classify(texts: DataFrame, c: Classifier) -> DataFrame:
    """``id, predicted, p`` of ``id, tokens``: the likeliest label (the first in order among equals) and its share."""
    shared, s, labels = texts.sparkSession.sparkContext.broadcast(c.m), c.settings, pa.array(c.labels)
    layers = LAYERS[s.kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = recurrent.lists(batch.column(1))
            best, p = np.zeros(len(ids), np.int64), np.zeros(len(ids))
            for at in _batches(ids, shared.value, s, False):
                logs = layers(shared.value, [ids[k] for k in at], None, None)
                best[at], p[at] = logs.argmax(axis=1), np.exp(logs.max(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), labels.take(pa.array(best)), pa.array(p)], names=["id", "predicted", "p"])

    rows = recurrent.numbered_words(texts.select("id", "tokens"), c.words).select("id", "ids")
    return rows.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, predicted string, p double")


def macro_f1(texts: DataFrame, c: Classifier) -> float:
    """The labels' mean F1 over labelled texts (``id`` unique)."""
    met = classify(texts, c).join(texts.filter("label is not null").select("id", F.col("label").cast("string").alias("label")), "id")
    each = models.classification_report(met.select(*(F.concat(F.lit("="), c).alias(c) for c in ("label", "predicted"))))
    return float(each.filter("label = 'macro'").first()["f1"] or 0.0)


def search(train: DataFrame, valid: DataFrame, s: Settings, tried: list[dict]) -> Search:
    """Settings in turn (of ``tuning.grid``), scored by macro F1 on ``valid``; ``best`` is the first of the highest."""
    found = Search(lambda **values: macro_f1(valid, learn(train, replace(s, **values))[0]))
    found.run(tried)
    return found
