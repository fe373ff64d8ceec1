"""Recurrent encoders and decoders of sentences: adjacent sentences teach them, and they encode, generate and score.

Words are numbered, 0 ending a sentence and 1 standing for every word beyond the vocabulary.  A model is a dictionary of float32 arrays whose
size the vocabulary's size and the dimensions set, never the corpus; it alone is held by the driver and broadcast.  In a step of learning, the tasks
add up the gradients of their sentences, pieces of them are summed in two rounds of shuffles, and Adam moves the model.

Null tokens count as none, a sentence without words has a zero vector, repeated rows give repeated results, and an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from textloom.operators import relational
from textloom.operators.shared import Tables

END, UNKNOWN = 0, 1
#: Adam's decays and smallest divisor (fixed values).
DECAYS, LEAST = (0.1, 0.001), 1e-8
#: Numbers of a gradient in one row.
PIECE = 1 << 16
#: Numbers of a batch's states and word shares held at once.
CELLS = 1 << 22

Model = dict[str, np.ndarray]


@dataclass(frozen=True)
class Settings:
    word_dims: int = 32
    dims: int = 64
    words: int = 20_000  # of the vocabulary, the end and the unknown word among them
    longest: int = 30  # words of a sentence that teaches; longer ones do not
    epochs: int = 1
    steps: int = 20  # of an epoch, each over another part of the sentences
    rate: float = 0.001
    clip: float = 5.0  # the gradient's norm at most
    seed: int = 42


def orthogonal(rng: np.random.Generator, n: int) -> np.ndarray:
    return np.linalg.svd(rng.standard_normal((n, n)))[0].astype(np.float32)


def weights(rng: np.random.Generator, rows: int, columns: int, scale: float = 0.1) -> np.ndarray:
    return rng.uniform(-scale, scale, (rows, columns)).astype(np.float32)


def first_gates(rng: np.random.Generator, name: str, below: int, dims: int) -> Model:
    """Parameters of a gated layer: ``W, b, U`` of the gates (reset before update), ``Wx, bx, Ux`` of the candidate."""
    zeros = lambda n: np.zeros(n, np.float32)
    return {
        f"{name}_W": np.hstack([weights(rng, below, dims) for _ in range(2)]), f"{name}_b": zeros(2 * dims), f"{name}_U": np.hstack([orthogonal(rng, dims) for _ in range(2)]),
        f"{name}_Wx": weights(rng, below, dims), f"{name}_bx": zeros(dims), f"{name}_Ux": orthogonal(rng, dims),
    }


def first_model(s: Settings, words: int) -> Model:
    """An encoder and the decoders of the sentence after (``next``) and before (``last``), which share words and word shares."""
    rng = np.random.default_rng(s.seed)
    model = {"words": weights(rng, words, s.word_dims)} | first_gates(rng, "encoder", s.word_dims, s.dims)
    for name in ("next", "last"):
        model |= {f"{name}_F": weights(rng, s.dims, s.dims), f"{name}_f": np.zeros(s.dims, np.float32)} | first_gates(rng, name, s.word_dims, s.dims)
    return model | {"out": weights(rng, s.dims, words), "out_b": np.zeros(words, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def gated_step(m: Model, name: str, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state, and what its gradient needs: reset, update, candidate, and the state's part of the candidate."""
    r, u = np.split(sigmoid(x @ m[f"{name}_W"] + m[f"{name}_b"] + h @ m[f"{name}_U"]), 2, axis=1)
    q = h @ m[f"{name}_Ux"]
    c = np.tanh(r * q + x @ m[f"{name}_Wx"] + m[f"{name}_bx"])
    return u * h + (1 - u) * c, r, u, c, q


def gated_run(m: Model, name: str, xs: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[list[np.ndarray], list[tuple]]:
    """States after each step (steps, rows, dims of ``xs``); where ``mask`` is 0 the state is carried on."""
    states, kept = [h], []
    for x, on in zip(xs, mask[:, :, None]):
        new, *parts = gated_step(m, name, x, h)
        h = on * new + (1 - on) * h
        states.append(h)
        kept.append(parts)
    return states, kept


def gated_gradient(m: Model, name: str, xs: np.ndarray, mask: np.ndarray, states: list, kept: list, above: np.ndarray, g: Model) -> tuple[np.ndarray, np.ndarray]:
    """Adds to ``g``; ``above`` is the loss's gradient at the state after each step.  Returns those at the first state and at ``xs``."""
    below, dh = np.zeros_like(xs), np.zeros_like(states[0])
    for t in range(len(xs) - 1, -1, -1):
        h, x, on, (r, u, c, q) = states[t], xs[t], mask[t][:, None], kept[t]
        dh = dh + above[t]
        moved = dh * on
        dc = moved * (1 - u) * (1 - c * c)
        gates = np.hstack([dc * q * r * (1 - r), moved * (h - c) * u * (1 - u)])
        dq = dc * r
        for key, left, right in (("W", x, gates), ("U", h, gates), ("Wx", x, dc), ("Ux", h, dq)):
            g[f"{name}_{key}"] += left.T @ right
        g[f"{name}_b"] += gates.sum(axis=0)
        g[f"{name}_bx"] += dc.sum(axis=0)
        below[t] = gates @ m[f"{name}_W"].T + dc @ m[f"{name}_Wx"].T
        dh = dh * (1 - on) + moved * u + dq @ m[f"{name}_Ux"].T + gates @ m[f"{name}_U"].T
    return dh, below


def padded(rows: list[list[int]], end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and mask, a step a row; with ``end`` each sentence's end is one of its words."""
    steps = max(map(len, rows), default=0) + end if len(rows) else 0
    ids, mask = np.full((steps, len(rows)), END, np.int64), np.zeros((steps, len(rows)), np.float32)
    for k, r in enumerate(rows):
        ids[: len(r), k], mask[: len(r) + end, k] = r, 1
    return ids, mask


def _before(m: Model, ids: np.ndarray) -> np.ndarray:
    """Vectors of the words before each place, zeros at the first."""
    xs = np.zeros((*ids.shape, m["words"].shape[1]), m["words"].dtype)
    xs[1:] = m["words"][ids[:-1]]
    return xs


def first_state(m: Model, name: str, contexts: np.ndarray) -> np.ndarray:
    return np.tanh(contexts @ m[f"{name}_F"] + m[f"{name}_f"])


def log_likelihoods(m: Model, name: str, contexts: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    """Per sentence, the log of its probability (its end's included) given its context."""
    ids, mask = padded(rows, True)
    states, _ = gated_run(m, name, _before(m, ids), mask, first_state(m, name, contexts))
    logs = [log_softmax(h @ m["out"] + m["out_b"])[np.arange(len(rows)), i] for h, i in zip(states[1:], ids)]
    return (np.array(logs) * mask).sum(axis=0)


def loss_gradient(m: Model, rows: list[list[int]], others: dict[str, list[list[int] | None]], g: Model) -> float:
    """Adds the gradient of ``- log p`` of the sentences next to each one (None: there is none) to ``g``; returns the loss."""
    ids, mask = padded(rows, True)
    xs = m["words"][ids]
    zero = np.zeros((len(rows), m["encoder_U"].shape[0]), xs.dtype)
    states, kept = gated_run(m, "encoder", xs, mask, zero)
    at_context, loss = np.zeros_like(zero), 0.0
    for name, targets in others.items():
        here = [k for k, r in enumerate(targets) if r is not None]
        if not here:
            continue
        tids, tmask = padded([targets[k] for k in here], True)
        contexts, txs = states[-1][here], _before(m, tids)
        start = first_state(m, name, contexts)
        after, parts = gated_run(m, name, txs, tmask, start)
        above = np.zeros_like(np.array(after[1:]))
        for t, h in enumerate(after[1:]):
            logs = log_softmax(h @ m["out"] + m["out_b"])
            loss -= float((logs[np.arange(len(here)), tids[t]] * tmask[t]).sum())
            d = np.exp(logs)
            d[np.arange(len(here)), tids[t]] -= 1
            d *= tmask[t][:, None]
            g["out"] += h.T @ d
            g["out_b"] += d.sum(axis=0)
            above[t] = d @ m["out"].T
        dh, below = gated_gradient(m, name, txs, tmask, after, parts, above, g)
        np.add.at(g["words"], tids[:-1], below[1:])
        dh = dh * (1 - start * start)
        g[f"{name}_F"] += contexts.T @ dh
        g[f"{name}_f"] += dh.sum(axis=0)
        at_context[here] += dh @ m[f"{name}_F"].T
    above = np.zeros_like(np.array(states[1:]))
    above[-1] = at_context
    below = gated_gradient(m, "encoder", xs, mask, states, kept, above, g)[1]
    np.add.at(g["words"], ids, below)
    return loss


def adam(m: Model, g: Model, moments: tuple[Model, Model], step: int, rate: float, clip: float) -> None:
    """One step of the model, in place; a gradient longer than ``clip`` is shortened to it."""
    norm = float(np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values())))
    scale = clip / norm if clip and norm > clip else 1.0
    first, second = moments
    rate *= np.sqrt(1 - (1 - DECAYS[1]) ** step) / (1 - (1 - DECAYS[0]) ** step)
    for key, x in g.items():
        x = x * scale
        first[key] += DECAYS[0] * (x - first[key])
        second[key] += DECAYS[1] * (x * x - second[key])
        m[key] -= (rate * first[key] / (np.sqrt(second[key]) + LEAST)).astype(m[key].dtype)


def vocabulary(sentences: DataFrame, words: int) -> DataFrame:
    """``id, term``: the most frequent words from number 2 on (ties by the word; null is none), at most ``words - 2`` of them."""
    counts = sentences.select(F.explode("tokens").alias("term")).filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    most = Tables(sentences.sparkSession, "vocabulary").put(counts.orderBy(F.desc("n"), "term").limit(words - 2), "most")  # numbering reads it twice
    return relational.numbered(most, [F.desc("n"), "term"], 2).select("id", "term")


def _known(sentences: DataFrame, words: DataFrame) -> Broadcast:
    return sentences.sparkSession.sparkContext.broadcast(pa.array([r["term"] for r in words.orderBy("id").collect()], pa.string()))


def _numbers(column: pa.Array, known: pa.Array) -> pa.ListArray:
    """The numbers of a column's words; null is none."""
    tokens = column.cast(pa.list_(pa.string()))
    place = pc.index_in(pc.list_flatten(tokens), value_set=known, skip_nulls=True)
    flat = pc.fill_null(pc.add(place, 2), UNKNOWN).cast(pa.int32())
    ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def numbered_words(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """The sentences with ``ids``, their words' numbers in place of ``tokens``; the vocabulary's size is bounded by the settings, so tasks hold it."""
    known = _known(sentences, words)
    keys = [c for c in sentences.columns if c != "tokens"]
    out = StructType([*(sentences.schema[c] for c in keys), StructField("ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], _numbers(batch.column(len(keys)), known.value)], names=[*keys, "ids"])

    return sentences.select(*keys, "tokens").mapInArrow(run, out)


def lists(column: pa.ListArray, null: bool = False) -> list[np.ndarray]:
    """The lists of whole numbers of a column, as parts of its own memory; null is an empty one, or None with ``null``."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[lo:hi] if on else None if null else values[:0] for lo, hi, on in zip(ends[:-1].tolist(), ends[1:].tolist(), known.tolist())]


def _flat(m: Model) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in sorted(m)])


def _shaped(flat: np.ndarray, like: Model) -> Model:
    out, at = {}, 0
    for key in sorted(like):
        out[key] = flat[at : at + like[key].size].reshape(like[key].shape)
        at += like[key].size
    return out


def _batches(lengths: list[int], cells: int) -> Iterator[list[int]]:
    """Rows of like length together, of at most so many cells a batch (or one row)."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * (lengths[order[end]] + 1) <= cells:
            end += 1
        yield order[at:end]
        at = end


def summed(rows: DataFrame, m: Model, teach: Callable[[Model, pa.RecordBatch, Model], tuple[float, int]]) -> tuple[Model, float, int]:
    """The gradient over all rows, the loss and the number taught; ``teach`` adds a batch's gradient and returns its loss and number.

    Tasks send pieces of their sums, which two rounds of shuffles add up.
    """
    sc, size = rows.sparkSession.sparkContext, sum(x.size for x in m.values())
    shared = sc.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, loss, n = shared.value, 0.0, 0
        g = {k: np.zeros_like(x) for k, x in model.items()}
        for batch in batches:
            more, some = teach(model, batch, g)
            loss, n = loss + more, n + some
        if n:
            flat = np.concatenate([_flat(g).astype(np.float64), [loss, n]])
            cut = [flat[k : k + PIECE] for k in range(0, len(flat), PIECE)]
            for k, part in enumerate(cut):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part], pa.list_(pa.float64()))], names=["piece", "g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = row.values.to_numpy()
                totals[k] = totals[k] + part if k in totals else part.copy()
        for k, part in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part], pa.list_(pa.float64()))], names=["piece", "g"])

    kind = "piece long, g array<double>"
    once = rows.mapInArrow(run, kind).repartition("piece", F.pmod(F.spark_partition_id(), F.lit(32))).mapInArrow(add, kind)
    pieces = once.repartition("piece").mapInArrow(add, kind).collect()  # the model's size
    shared.unpersist()
    flat = np.concatenate([np.array(r["g"]) for r in sorted(pieces, key=lambda r: r["piece"])]) if pieces else np.zeros(size + 2)
    return _shaped(flat[:-2], m), float(flat[-2]), int(flat[-1])


def summed_gradient(triples: DataFrame, m: Model) -> tuple[Model, float, int]:
    """The gradient over all rows (``ids, next, last``), the loss, and the number of rows."""
    cells = max(1, CELLS // (m["out"].shape[1] + 8 * m["out"].shape[0]))

    def teach(model: Model, batch: pa.RecordBatch, g: Model) -> tuple[float, int]:
        ids, after, before = (lists(batch.column(k), null=k > 0) for k in range(3))
        loss = 0.0
        for at in _batches([max(len(x) for x in r if x is not None) for r in zip(ids, after, before)], cells):
            loss += loss_gradient(model, [ids[k] for k in at], {"next": [after[k] for k in at], "last": [before[k] for k in at]}, g)
        return loss, len(ids)

    return summed(triples.select("ids", "next", "last"), m, teach)


def learn(sentences: DataFrame, s: Settings) -> tuple[Model, DataFrame, list[float]]:
    """An encoder whose vectors predict the adjacent sentences (``id, doc, pos, tokens``); its vocabulary, and the mean loss of each step.

    A sentence and its neighbours teach if none of them is longer than ``s.longest`` words and the sentence has a neighbour.
    """
    tables = Tables(sentences.sparkSession, "recurrent")
    words = tables.put(vocabulary(sentences, s.words), "words")
    rows = tables.put(numbered_words(sentences.select("id", "doc", "pos", "tokens"), words), "ids").filter(F.size("ids") <= s.longest)
    near = {name: rows.select("doc", (F.col("pos") - by).alias("pos"), F.col("ids").alias(name)) for name, by in (("next", 1), ("last", -1))}
    met = rows.join(near["next"], ["doc", "pos"], "left").join(near["last"], ["doc", "pos"], "left").filter("next is not null or last is not null")
    part = F.pmod(F.xxhash64(F.lit(s.seed), "doc", "pos"), F.lit(s.steps))
    teaching = tables.put(met.select(part.alias("part"), "ids", "next", "last"), "teaching")
    m = first_model(s, words.count() + 2)
    return m, words, _taken(m, s, lambda epoch, k: teaching.filter(F.col("part") == k))


def _taken(m: Model, s: Settings, part: Callable[[int, int], DataFrame]) -> list[float]:
    """The steps of learning over each epoch's parts, which move the model; the mean loss of each."""
    losses, step = [], 0
    moments = tuple({k: np.zeros(x.shape) for k, x in m.items()} for _ in range(2))
    for epoch in range(s.epochs):
        for k in range(s.steps):
            g, loss, n = summed_gradient(part(epoch, k), m)
            if not n:
                continue
            step += 1
            adam(m, {key: x / n for key, x in g.items()}, moments, step, s.rate, s.clip)
            losses.append(loss / n)
    return losses


def learn_denoising(sentences: DataFrame, s: Settings, corrupt: Callable[[Column, Column], Column] | None = None) -> tuple[Model, DataFrame, list[float]]:
    """An encoder from whose vector of a corrupted sentence (``id, tokens``) the decoder ``next`` finds the sentence itself; as ``learn`` returns it.

    ``corrupt`` is given the words' numbers and a key, as ``tokens.masked`` (with the mask ``UNKNOWN``), ``tokens.swapped`` and ``tokens.removed`` take them;
    each epoch corrupts anew.  Without it the encoder sees the sentences as they are.  Those longer than ``s.longest`` or without words do not teach.
    """
    tables = Tables(sentences.sparkSession, "denoising")
    words = tables.put(vocabulary(sentences, s.words), "words")
    rows = numbered_words(sentences.select("id", "tokens"), words).filter(F.size("ids").between(1, s.longest))
    rows = tables.put(rows.withColumn("part", F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.lit(s.steps))), "ids", "part")
    m = first_model(s, words.count() + 2)

    def part(epoch: int, k: int) -> DataFrame:
        seen = corrupt(F.col("ids"), F.concat_ws("-", F.lit(str(s.seed)), F.lit(str(epoch)), F.col("id").cast("string"))) if corrupt else F.col("ids")
        return rows.filter(F.col("part") == k).select(seen.alias("ids"), F.col("ids").alias("next"), F.lit(None).cast("array<int>").alias("last"))

    return m, words, _taken(m, s, part)


def encode(sentences: DataFrame, m: Model, words: DataFrame, names: tuple[str, ...] = ("encoder",), unit: bool = True, end: bool = True) -> DataFrame:
    """``id, v``: the last states of the named layers side by side, each brought to length 1 with ``unit``.

    A layer whose name ends in ``_back`` reads sentences from the right.  Sentences of like length share a batch; a mask carries the shorter ones' states on.
    A task numbers the words itself, so that it has one Python worker and not two.
    """
    shared = sentences.sparkSession.sparkContext.broadcast({k: x for k, x in m.items() if k == "words" or k.rsplit("_", 1)[0] in names})
    dims = sum(m[f"{n}_U"].shape[0] for n in names)
    known = _known(sentences, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, out = lists(_numbers(batch.column(1), known.value)), np.zeros((batch.num_rows, dims), np.float32)
            for at in _batches([len(r) for r in ids], max(1, CELLS // (model["words"].shape[1] + 8 * dims))):
                out[at] = np.hstack([_last_states(model, n, [ids[k] for k in at], unit, end) for n in names])
            out[[k for k, r in enumerate(ids) if not len(r)]] = 0
            flat = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dims).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["id", "v"])

    return sentences.select("id", "tokens").mapInArrow(run, f"id {sentences.schema['id'].dataType.simpleString()}, v array<float>")


def _last_states(m: Model, name: str, rows: list[list[int]], unit: bool, end: bool) -> np.ndarray:
    rows = [r[::-1] for r in rows] if name.endswith("_back") else rows
    ids, mask = padded(rows, end)
    h = np.zeros((len(rows), m[f"{name}_U"].shape[0]), np.float32)
    for i, on in zip(ids, mask[:, :, None]):
        h = on * gated_step(m, name, m["words"][i], h)[0] + (1 - on) * h
    if unit:
        norm = np.sqrt((h * h).sum(axis=1, keepdims=True))
        h = h / np.where(norm > 0, norm, 1)
    return h


def beams(m: Model, name: str, contexts: np.ndarray, k: int, longest: int, unknown: bool = False) -> list[list[tuple[float, list[int]]]]:
    """Per context, up to ``k`` sentences of least cost (``- log p``, then word numbers in order), as ``cost, words``.

    All contexts go on together.  In each step as many are kept of a context's unfinished ones and their next words as it has sentences
    still to finish; those left unfinished after ``longest`` words come too.  Without ``unknown`` that word is never chosen.
    """
    n, words = len(contexts), m["out"].shape[1]
    done: list[list[tuple[float, list[int]]]] = [[] for _ in range(n)]
    owner, cost, said = np.arange(n), np.zeros(n), [[] for _ in range(n)]
    h, x = first_state(m, name, contexts), np.zeros((n, m["words"].shape[1]), m["words"].dtype)
    for _ in range(longest):
        if not len(owner):
            break
        h = gated_step(m, name, x, h)[0]
        total = cost[:, None] - log_softmax((h @ m["out"] + m["out_b"]).astype(np.float64))
        if not unknown:
            total[:, UNKNOWN] = np.inf
        keep = []
        edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            flat, want = total[lo:hi].ravel(), min(k - len(done[owner[lo]]), total[lo:hi].size)
            within = np.flatnonzero(flat <= np.partition(flat, want - 1)[want - 1])
            best = within[np.argsort(flat[within], kind="stable")[:want]]
            keep += [(lo + b // words, b % words, flat[b]) for b in best if np.isfinite(flat[b])]
        live = []
        for parent, word, price in keep:
            if word == END:
                done[owner[parent]].append((float(price), said[parent]))
            else:
                live.append((parent, word, price))
        live = [row for row in live if len(done[owner[row[0]]]) < k]
        parents = np.array([p for p, _, _ in live], np.int64)
        said = [said[p] + [int(w)] for p, w, _ in live]
        owner, h, cost = owner[parents], h[parents], np.array([c for _, _, c in live])
        x = m["words"][np.array([w for _, w, _ in live], np.int64)]
    for o, c, w in zip(owner.tolist(), cost.tolist(), said):
        done[o].append((c, w))
    return [sorted(rows) for rows in done]


def drawn(m: Model, name: str, contexts: np.ndarray, seeds: list[int], longest: int) -> list[tuple[float, list[int]]]:
    """Per context one sentence drawn word by word in proportion to the words' shares, as ``cost, words``; equal seeds draw alike."""
    rngs, n = [np.random.default_rng(abs(s)) for s in seeds], len(contexts)
    h, x = first_state(m, name, contexts), np.zeros((n, m["words"].shape[1]), m["words"].dtype)
    cost, said, on = np.zeros(n), [[] for _ in range(n)], np.ones(n, bool)
    for _ in range(longest):
        h = gated_step(m, name, x, h)[0]
        logs = log_softmax((h @ m["out"] + m["out_b"]).astype(np.float64))
        word = np.zeros(n, np.int64)
        for r in np.flatnonzero(on):
            word[r] = min(np.searchsorted(np.cumsum(np.exp(logs[r])), rngs[r].random(), "right"), logs.shape[1] - 1)
            cost[r] -= logs[r, word[r]]
            if word[r] != END:
                said[r].append(int(word[r]))
        on &= word != END
        if not on.any():
            break
        x = m["words"][word]
    return list(zip(cost.tolist(), said))


def generate(vectors: DataFrame, m: Model, words: DataFrame, name: str = "next", k: int = 5, longest: int = 30, draw: int | None = None) -> DataFrame:
    """``id, place, cost, tokens``: the sentences that a decoder gives for vectors (``id, v``), best first; with ``draw`` (a seed) one drawn for each.

    A vector that is null has no sentence.
    """
    terms = {int(r["id"]): r["term"] for r in words.collect()} | {END: "", UNKNOWN: "UNK"}  # the vocabulary, bounded by the settings
    shared = vectors.sparkSession.sparkContext.broadcast((m, terms))
    kind = vectors.schema["id"].dataType.simpleString()
    seeds = F.xxhash64(F.lit(draw or 0), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = shared.value
        step = max(1, CELLS // (model["out"].shape[1] * (1 if draw is not None else k)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                contexts = np.array(part.column(1).to_pylist(), np.float32)
                found = [[row] for row in drawn(model, name, contexts, part.column(2).to_pylist(), longest)] if draw is not None else beams(model, name, contexts, k, longest)
                rows = [(r, at, c, [names[w] for w in said]) for r, some in enumerate(found) for at, (c, said) in enumerate(some)]
                columns = [part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
                columns += [pa.array([r[j] for r in rows], t) for j, t in ((1, pa.int32()), (2, pa.float64()), (3, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "place", "cost", "tokens"])

    return vectors.filter(F.col("v").isNotNull()).select("id", "v", seeds).mapInArrow(run, f"id {kind}, place int, cost double, tokens array<string>")


def reconstruction(vectors: DataFrame, sentences: DataFrame, m: Model, words: DataFrame, name: str = "next") -> DataFrame:
    """``id, n, log_p``: how likely a decoder finds a sentence (``id, tokens``) given the vector of that id; ``n`` words with the end."""
    shared = vectors.sparkSession.sparkContext.broadcast(m)
    rows = numbered_words(sentences.select("id", "tokens"), words).join(vectors.filter(F.col("v").isNotNull()).select("id", "v"), "id")
    kind = sentences.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = [r or [] for r in batch.column(1).to_pylist()]
            contexts, logs = np.array(batch.column(2).to_pylist(), np.float32), np.zeros(len(ids))
            for at in _batches([len(r) for r in ids], max(1, CELLS // (model["out"].shape[1] + 8 * model["out"].shape[0]))):
                logs[at] = log_likelihoods(model, name, contexts[at], [ids[k] for k in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) + 1 for r in ids], pa.int64()), pa.array(logs)], names=["id", "n", "log_p"])

    return rows.select("id", "ids", "v").mapInArrow(run, f"id {kind}, n long, log_p double")


def perplexity(scored: DataFrame) -> DataFrame:
    """``n, perplexity`` of all rows of ``reconstruction``."""
    return scored.agg(F.sum("n").alias("n"), F.exp(-F.sum("log_p") / F.sum("n")).alias("perplexity"))
