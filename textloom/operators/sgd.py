"""Stochastic gradient steps on one block of sentences: word windows, neighbours, labels and anchors, in numpy.

A block has its own numbering of rows (words, sentence tokens, tree nodes, labels).  Each row has an input and
an output vector.  Steps are taken in batches: within a batch all gradients are taken at the values before it
and added up, so a batch of one is the plain sequential rule.  Parts follow in this order: the text's pairs, predicted
neighbours, labels, the pull towards neighbours, the pull towards anchors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Inner products beyond which a logistic gain counts as 0 or 1 (fixed value).
MAX_EXP = 6.0
#: The least share of the first step size (fixed value).
LEAST_STEP = 1e-4
#: Tokens whose windows are laid out at once.
CHUNK = 4_096
#: Cells that guide the search of a drawn row, for each row of a pool.
CELLS_A_ROW = 8


@dataclass(frozen=True)
class Settings:
    dims: int = 100
    window: int = 10
    negative: int = 5
    alpha: float = 0.025
    epochs: int = 20
    #: Mean of the words to the left and the sentence token predicts a word, in place of each word near it.
    bag: bool = False
    #: Each sentence begins with a token of its own, which also predicts every word of the sentence.
    sentence_token: bool = True
    #: Frequent words are left out at random, the more so the further their share is above this; 0: none.
    sample: float = 1e-4
    min_count: int = 1
    #: Codes of a Huffman tree are predicted, not words against drawn ones.
    tree: bool = False
    #: Neighbours that an input predicts at each step: "" none, "one" drawn, "all" dealt over the sentence's words.
    predict: str = ""
    #: Strengths of the pull towards the neighbours' mean and towards the anchor.
    pull: float = 0.0
    anchor: float = 0.0
    batch: int = 256
    block_words: int = 200_000
    pool: int = 1 << 14
    seed: int = 1


@dataclass
class Lists:
    """Lists of variable length, one for each row: list i is ``items[at[i]:at[i + 1]]``."""

    at: np.ndarray
    items: np.ndarray
    more: np.ndarray | None = None

    @classmethod
    def of(cls, n: int, owner: np.ndarray, items: np.ndarray, more: np.ndarray | None = None) -> Lists:
        order = np.argsort(owner, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]) if n else np.zeros(1, np.int64)
        return cls(at, items[order], None if more is None else more[order])

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.at[rows + 1] - self.at[rows]

    def laid_out(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all lists of ``rows`` one after the other: which row of ``rows``, and the place in ``items``."""
        sizes = self.sizes(rows)
        owner = np.repeat(np.arange(len(rows)), sizes)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.at[rows][owner]


@dataclass
class Pool:
    """Rows of a weight above 0, drawn in proportion to it by the running totals ``upto``."""

    rows: np.ndarray
    upto: np.ndarray
    #: The range of weights in equal cells, some for each row: of a cell, how many totals lie in cells before it, and in those up to it.
    before: np.ndarray
    through: np.ndarray

    @classmethod
    def of(cls, weights: np.ndarray) -> Pool:
        rows = np.flatnonzero(weights > 0)
        upto, cells = np.cumsum(weights[rows]), np.arange(CELLS_A_ROW * len(rows) + 1)
        own = (upto * (cells[-1] / upto[-1])).astype(np.int64) if len(rows) else rows
        return cls(rows, upto, np.searchsorted(own, cells, "left"), np.searchsorted(own, cells, "right"))

    def places(self, uniform: np.ndarray) -> np.ndarray:
        """The place of the first total above each share of the last one; looked for only where its cell has totals."""
        value = uniform * self.upto[-1]
        cell = np.minimum((value * ((len(self.before) - 1) / self.upto[-1])).astype(np.int64), len(self.before) - 1)
        found = self.before.take(cell)
        open_ = found != self.through.take(cell)
        found[open_] = np.searchsorted(self.upto, value[open_], "right")
        return np.minimum(found, len(self.rows) - 1)


@dataclass
class Block:
    inputs: np.ndarray
    outputs: np.ndarray
    #: Tokens of all sentences one after the other, and where each begins (and the last ends).
    tokens: np.ndarray
    begins: np.ndarray
    #: By row: the chance to be kept, the weights to be drawn as a wrong word and as a wrong neighbour.
    keep: np.ndarray
    pool: np.ndarray
    near_pool: np.ndarray
    near: Lists | None = None
    codes: Lists | None = None
    #: By row: the number of its label's row among ``label_rows``, or -1; its anchor, as far as it has one.
    label: np.ndarray | None = None
    label_rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    anchors: np.ndarray | None = None
    anchored: np.ndarray | None = None
    #: Tokens that each sentence predicts, where it is the sum of its words that predicts.
    context: Lists | None = None

    def __post_init__(self) -> None:
        n = len(self.inputs)
        self.input_steps, self.output_steps = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.loss, self.pairs = 0.0, 0
        self._pools = {name: Pool.of(w) for name, w in (("pool", self.pool), ("near_pool", self.near_pool))}

    def drawn(self, which: str, uniform: np.ndarray) -> np.ndarray:
        pool = self._pools[which]
        return pool.rows[pool.places(uniform)] if len(pool.rows) else np.zeros(uniform.shape, np.int64)


def add_rows(matrix: np.ndarray, rows: np.ndarray, delta: np.ndarray) -> None:
    """Adds each delta to its row in turn; rows may repeat.

    Numpy adds fast to places of one dimension; two numbers side by side are added as one complex number, which halves the places.
    """
    flat, delta, dims = matrix.reshape(-1, copy=False), delta.astype(matrix.dtype, copy=False).reshape(-1), matrix.shape[1]
    if matrix.dtype == np.float32 and dims % 2 == 0:
        flat, delta, dims = flat.view(np.complex64), delta.view(np.complex64), dims // 2
    np.add.at(flat, (rows[:, None] * dims + np.arange(dims)).reshape(-1), delta)


def gains(products: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Label less the logistic function, which beyond MAX_EXP is 0 or 1."""
    logistic = 1 / (1 + np.exp(-np.clip(products, -MAX_EXP, MAX_EXP)))
    return labels - np.where(products > MAX_EXP, 1.0, np.where(products < -MAX_EXP, 0.0, logistic))


def predicted(block: Block, hidden: np.ndarray, targets: np.ndarray, labels: np.ndarray, used: np.ndarray, alpha: float) -> np.ndarray:
    """One logistic step of each hidden vector with its targets (a row of each); returns the errors for the hidden vectors."""
    rows = block.outputs.take(targets, axis=0)
    products = np.matmul(rows, hidden[:, :, None])[:, :, 0]
    gain = np.where(used, gains(products, labels), 0.0)
    block.loss += float(np.where(used, np.logaddexp(0, np.where(labels > 0, -products, products)), 0.0).sum())
    block.pairs += len(hidden)
    gain = (alpha * gain).astype(hidden.dtype)
    error = np.matmul(gain[:, None, :], rows)[:, 0, :]
    add_rows(block.outputs, targets.reshape(-1), gain[:, :, None] * hidden[:, None, :])  # those not used gain nothing
    np.add.at(block.output_steps, targets[used], 1)
    return error


def against_drawn(block: Block, hidden: np.ndarray, right: np.ndarray, which: str, s: Settings, rng: np.random.Generator, alpha: float) -> np.ndarray:
    """The right rows against rows drawn from a pool; a draw that hits the right one is not used."""
    wrong = block.drawn(which, rng.random((len(right), s.negative)))
    targets = np.concatenate([right[:, None], wrong], axis=1)
    used = np.concatenate([np.ones((len(right), 1), bool), wrong != right[:, None]], axis=1)
    labels = np.zeros(targets.shape)
    labels[:, 0] = 1
    return predicted(block, hidden, targets, labels, used, alpha)


def along_codes(block: Block, hidden: np.ndarray, words: np.ndarray, alpha: float) -> np.ndarray:
    """The nodes above each word in the tree; a bit of 0 is the label 1.  Products beyond MAX_EXP teach nothing here."""
    sizes = block.codes.sizes(words)
    width = int(sizes.max(initial=0))
    if not width:
        return np.zeros_like(hidden)
    place = np.arange(width)[None] + block.codes.at[words][:, None]
    used = np.arange(width)[None] < sizes[:, None]
    place = np.where(used, place, 0)
    return predicted(block, hidden, block.codes.items[place], 1.0 - block.codes.more[place], used, alpha)


def windows(begins: np.ndarray, reach: np.ndarray, token: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (near, at): from each place at, first those up to ``reach`` around it in order, then its sentence's first."""
    n, sizes = len(reach), np.diff(begins)
    first, last = np.repeat(begins[:-1], sizes), np.repeat(begins[1:], sizes)
    near, at = [], []
    for step in range(1, int(reach.max(initial=0)) + 1):
        here = np.flatnonzero(reach >= step)
        left, right = here[here - step >= first[here]], here[here + step < last[here]]
        near += [left - step, right + step]
        at += [left, right]
    near, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (near, at))
    order = np.lexsort((near, at))
    near, at = near[order], at[order]
    if token:  # after the other pairs of its place
        ends = np.searchsorted(at, np.arange(n), "right")
        near, at = np.insert(near, ends, first), np.insert(at, ends, np.arange(n))
    return near, at


def _times(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(rows, return_counts=True)


def _after_pairs(block: Block, rows: np.ndarray, place: np.ndarray, length: np.ndarray, s: Settings, rng: np.random.Generator, alpha: float) -> None:
    """What follows each step of an input: its neighbours, its label, its pulls."""
    vectors = block.inputs
    if s.predict and block.near is not None:
        have = np.flatnonzero(block.near.sizes(rows) > 0)
        own, n = rows[have], block.near.sizes(rows[have])
        if s.predict == "one":
            owner, at = np.arange(len(own)), block.near.at[own] + np.minimum((rng.random(len(own)) * n).astype(np.int64), n - 1)
        else:
            share = n // np.maximum(length[have], 1)
            low = np.where(share > 0, share * place[have], place[have])
            high = np.where(share > 0, np.where(place[have] == length[have] - 1, n, share * (place[have] + 1)), place[have] + 1)
            low, high = np.minimum(low, n), np.minimum(high, n)
            owner = np.repeat(np.arange(len(own)), high - low)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + (block.near.at[own] + low)[owner]
        if len(owner) and s.negative:
            hidden = vectors[own[owner]]
            add_rows(vectors, own[owner], against_drawn(block, hidden, block.near.items[at], "near_pool", s, rng, alpha))
    if block.label is not None and len(block.label_rows):
        have = np.flatnonzero(block.label[rows] >= 0)
        if len(have):
            own, heads = vectors[rows[have]], block.outputs[block.label_rows]
            scores = own @ heads.T
            scores -= scores.max(axis=1, keepdims=True)
            share = np.exp(scores)
            share /= share.sum(axis=1, keepdims=True)
            gain = -share
            gain[np.arange(len(have)), block.label[rows[have]]] += 1
            gain = (alpha * gain).astype(own.dtype)
            block.outputs[block.label_rows] = heads + gain.T @ own
            block.output_steps[block.label_rows] += len(have)
            add_rows(vectors, rows[have], gain @ heads)
    if s.pull > 0 and block.near is not None:
        own, times = _times(rows[block.near.sizes(rows) > 0])
        if len(own):
            owner, at = block.near.laid_out(own)
            weight = block.near.more[at]
            starts = np.searchsorted(owner, np.arange(len(own)))
            total = np.add.reduceat(weight, starts)
            sums = np.add.reduceat(weight[:, None] * vectors[block.near.items[at]], starts, axis=0)
            # Each step moves by alpha * pull / n * sum of w (v_j - v); so many steps at once, neighbours held still.
            left = (1 - alpha * s.pull * total / block.near.sizes(own)) ** times
            mean = sums / np.where(total, total, 1)[:, None]
            vectors[own] = np.where(total[:, None] != 0, mean + left[:, None] * (vectors[own] - mean), vectors[own])
    if s.anchor > 0 and block.anchors is not None:
        own, times = _times(rows[block.anchored[rows]])
        left = (1 - alpha * s.anchor) ** times
        vectors[own] = block.anchors[own] + left[:, None] * (vectors[own] - block.anchors[own])


def _text_step(block: Block, hidden: np.ndarray, words: np.ndarray, s: Settings, rng: np.random.Generator, alpha: float) -> np.ndarray:
    error = np.zeros_like(hidden)
    if s.tree:
        error += along_codes(block, hidden, words, alpha)
    elif s.negative:
        error += against_drawn(block, hidden, words, "pool", s, rng, alpha)
    return error


def _pairs(block: Block, tokens: np.ndarray, begins: np.ndarray, s: Settings, rng: np.random.Generator, alpha: float) -> None:
    reach = s.window - rng.integers(0, s.window, len(tokens))
    near, at = windows(begins, reach, s.sentence_token)
    sentence = np.searchsorted(begins, at, "right") - 1
    for k in range(0, len(at), s.batch):
        part = slice(k, k + s.batch)
        rows, words = tokens[near[part]], tokens[at[part]]
        add_rows(block.inputs, rows, _text_step(block, block.inputs.take(rows, axis=0), words, s, rng, alpha))
        np.add.at(block.input_steps, rows, 1)
        own = sentence[part]
        _after_pairs(block, rows, at[part] - begins[own], begins[own + 1] - begins[own], s, rng, alpha)


def _bags(block: Block, tokens: np.ndarray, begins: np.ndarray, s: Settings, rng: np.random.Generator, alpha: float) -> None:
    """Words to the left only, at a distance from ``skip`` to ``window - skip`` for a drawn skip, and the sentence token."""
    skip = rng.integers(0, s.window, len(tokens))
    first = np.repeat(begins[:-1], np.diff(begins))
    steps = np.arange(s.window, 0, -1)
    for k in range(0, len(tokens), s.batch):
        here = np.arange(k, min(k + s.batch, len(tokens)))
        near = here[:, None] - steps[None]
        used = (steps[None] >= np.maximum(skip[here], 1)[:, None]) & (steps[None] <= (s.window - skip[here])[:, None])
        used &= near >= first[here][:, None] + int(s.sentence_token)
        if s.sentence_token:
            near, used = np.concatenate([near, first[here][:, None]], axis=1), np.concatenate([used, np.ones((len(here), 1), bool)], axis=1)
        some = used.any(axis=1)
        here, near, used = here[some], near[some], used[some]
        owner, place = np.nonzero(used)
        rows = tokens[near[owner, place]]
        if not len(rows):
            continue
        starts, count = np.searchsorted(owner, np.arange(len(here))), used.sum(axis=1)
        hidden = np.add.reduceat(block.inputs[rows], starts, axis=0) / count[:, None].astype(block.inputs.dtype)
        error = _text_step(block, hidden, tokens[here], s, rng, alpha)
        add_rows(block.inputs, rows, error[owner])
        np.add.at(block.input_steps, rows, 1)


def _sums(block: Block, first: int, last: int, s: Settings, rng: np.random.Generator, alpha: float, mean: bool) -> None:
    """The sum (or mean) of a sentence's words predicts each word of its context; its words share the error."""
    for k in range(first, last):
        words = block.tokens[block.begins[k] : block.begins[k + 1]]
        words = words[rng.random(len(words)) < block.keep[words]]
        near = block.context.items[block.context.at[k] : block.context.at[k + 1]]
        near = near[rng.random(len(near)) < block.keep[near]]
        if not len(words) or not len(near):
            continue
        hidden = block.inputs[words].sum(axis=0)
        if mean:
            hidden = hidden / len(words)
        for at in range(0, len(near), s.batch):
            part = near[at : at + s.batch]
            error = _text_step(block, np.broadcast_to(hidden, (len(part), len(hidden))), part, s, rng, alpha).sum(axis=0)
            add_rows(block.inputs, words, np.broadcast_to(error if mean else error / len(words), (len(words), len(hidden))))
            np.add.at(block.input_steps, words, len(part))


def train(block: Block, s: Settings, epoch: int, rng: np.random.Generator, mean: bool = False) -> None:
    """One pass over the block's sentences; the step size falls in proportion to the words still to come in all epochs."""
    sizes, total = np.diff(block.begins), max(len(block.tokens), 1)
    k = 0
    while k < len(sizes):
        upto = max(k + 1, int(np.searchsorted(block.begins, block.begins[k] + CHUNK, "right")) - 1)
        alpha = s.alpha * max(LEAST_STEP, 1 - (epoch + block.begins[k] / total) / s.epochs)
        if block.context is not None:
            _sums(block, k, upto, s, rng, alpha, mean)
        else:
            tokens = block.tokens[block.begins[k] : block.begins[upto]]
            kept = rng.random(len(tokens)) < block.keep[tokens]
            own = np.repeat(np.arange(upto - k), sizes[k:upto])[kept]
            begins = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=upto - k))])
            (_bags if s.bag else _pairs)(block, tokens[kept], begins, s, rng, alpha)
        k = upto
