"""Language models: a recurrent one whose words are found by class, counted bigrams, their mixture, and their scores.

The recurrent model's state follows from the word before and the state before; the state, and hashed features of the last words, give a share to each
class of words and to each word in its class.  Words are numbered by frequency from 0, a sentence's end; classes are stretches of that order with like
sums of the roots of frequencies.  A word beyond the vocabulary is -1: it has no probability, moves no state by itself, and stands in no feature.
Sentences do not depend on each other, so tasks share the work; a gradient goes back to a sentence's start.

``Settings`` bound the model, which the driver holds and broadcasts.  Null tokens count as none, a sentence without words has its end alone,
repeated rows give repeated results, and an empty table gives none.  Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import optimisers, recurrent
from textloom.operators.recurrent import CELLS, Model, log_softmax, sigmoid, weights
from textloom.operators.shared import Tables, near

#: What an unknown word costs in a mixture, as a logarithm to base 10 (fixed value).
UNKNOWN_COST = -8.0
#: The odd multiplier of the features' hash.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    dims: int = 32
    words: int = 20_000  # of the vocabulary, a sentence's end among them
    classes: int = 100
    order: int = 3  # features of none, one and two words before; 0 for no features
    cells: int = 1 << 16  # of each table of features
    longest: int = 60  # words of a sentence that teaches; all are scored whole
    epochs: int = 5
    steps: int = 4  # of an epoch, each over another part of the sentences
    rule: str = "adam"
    rate: float = 0.01
    clip: float = 5.0
    held: int = 20  # one sentence in so many does not teach but tells when the rate is halved
    gain: float = 1.003  # of the held sentences' log likelihood; below it the rate is halved from then on, below it again learning ends
    seed: int = 42


@dataclass(frozen=True)
class Language:
    m: Model
    bounds: np.ndarray  # the first word of each class, and the number of words
    words: DataFrame  # id, term: the vocabulary without the end
    order: int


def class_bounds(counts: np.ndarray, classes: int) -> np.ndarray:
    """Classes of words in their order: a new one begins behind the word that takes the roots' running share over the next of ``classes`` equal steps."""
    roots = np.sqrt(np.maximum(counts, 0))
    share = np.minimum(np.cumsum(roots / max(roots.sum(), 1e-300)), 1)
    starts, at = [0], 0
    for word, upto in enumerate(share[:-1]):
        if at < classes - 1 and upto > (at + 1) / classes:
            at += 1
            starts.append(word + 1)
    return np.array([*starts, len(counts)])


def first_model(s: Settings, words: int, classes: int) -> Model:
    rng = np.random.default_rng(s.seed)
    m = {"words": weights(rng, words, s.dims), "again": weights(rng, s.dims, s.dims), "classes": weights(rng, s.dims, classes), "out": weights(rng, s.dims, words)}
    return m | ({"class_cells": np.zeros(s.cells, np.float32), "word_cells": np.zeros(s.cells, np.float32)} if s.order else {})


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * SPREAD
    return (x ^ (x >> np.uint64(29))) * SPREAD


def first_cells(history: np.ndarray, group: np.ndarray, order: int, cells: int) -> np.ndarray:
    """Rows by order: the cell at which the features of the last words (nearest first) begin, -1 where one of them is unknown."""
    key, known = _mixed(group.astype(np.uint64) + np.uint64(1)), np.ones(len(history), bool)
    out = np.empty((len(history), order), np.int64)
    for a in range(order):
        if a:
            known = known & (history[:, a - 1] >= 0)
            key = _mixed(key ^ (history[:, a - 1] + 2).astype(np.uint64))
        out[:, a] = np.where(known, (key >> np.uint64(17)) % np.uint64(cells), -1)
    return out


def shares(m: Model, part: str, lo: int, hi: int, h: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Logarithms of the shares of columns ``lo`` to ``hi`` of ``part`` (classes or out), a row per state."""
    x = (h @ m[part][:, lo:hi]).astype(np.float64)
    table = m.get("class_cells" if part == "classes" else "word_cells")
    for a in range(cells.shape[1]):
        on = np.flatnonzero(cells[:, a] >= 0)
        x[on] += table[(cells[on, a][:, None] + np.arange(hi - lo)) % len(table)]
    return log_softmax(x)


def _slopes(m: Model, g: Model, part: str, lo: int, hi: int, h: np.ndarray, cells: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Adds the gradient of the scores' slopes ``d`` to ``g``; returns that at the states."""
    name = "class_cells" if part == "classes" else "word_cells"
    g[part][:, lo:hi] += h.T @ d
    for a in range(cells.shape[1]):
        on = np.flatnonzero(cells[:, a] >= 0)
        np.add.at(g[name], (cells[on, a][:, None] + np.arange(hi - lo)) % len(g[name]), d[on])
    return d @ m[part][:, lo:hi].T


def likelihoods(m: Model, bounds: np.ndarray, order: int, h: np.ndarray, history: np.ndarray, words: np.ndarray, g: Model | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """``log p`` of known words after the states and histories; with ``g`` also the loss's gradient at the states."""
    group = np.searchsorted(bounds, words, "right") - 1
    size = len(m["class_cells"]) if order else 1
    logs, dh = np.zeros(len(words)), None if g is None else np.zeros_like(h)
    jobs = [("classes", 0, len(bounds) - 1, np.arange(len(words)), group, np.zeros(len(words), np.int64))] if len(words) else []
    by = np.argsort(group, kind="stable")
    for rows in np.split(by, np.flatnonzero(np.diff(group[by])) + 1) if len(words) else []:
        lo, hi = bounds[group[rows[0]]], bounds[group[rows[0]] + 1]
        jobs.append(("out", lo, hi, rows, words[rows] - lo, group[rows] + 1))
    for part, lo, hi, rows, right, key in jobs:
        cells = first_cells(history[rows], key, order, size)
        some = shares(m, part, lo, hi, h[rows], cells)
        logs[rows] += some[np.arange(len(rows)), right]
        if g is not None:
            d = np.exp(some)
            d[np.arange(len(rows)), right] -= 1
            dh[rows] += _slopes(m, g, part, lo, hi, h[rows], cells, d.astype(h.dtype))
    return logs, dh


def run(m: Model, bounds: np.ndarray, order: int, rows: list[list[int]], g: Model | None = None) -> tuple[list[np.ndarray], float, int]:
    """Per sentence ``log p`` of its words and its end (NaN: unknown), and the loss with the number of known words; with ``g`` the gradient is added."""
    n, steps, dims = len(rows), max(map(len, rows), default=-1) + 1, m["again"].shape[0]
    said, asked, on = (np.zeros((steps, n), kind) for kind in (np.int64, np.int64, bool))
    for k, r in enumerate(rows):
        said[1 : len(r) + 1, k], asked[: len(r), k], on[: len(r) + 1, k] = r, r, True
    states = [np.ones((n, dims), m["words"].dtype)]
    for i in said:
        states.append(sigmoid(m["words"][np.maximum(i, 0)] * (i >= 0)[:, None] + states[-1] @ m["again"]).astype(states[0].dtype))
    behind = [np.vstack([np.zeros((min(a, steps), n), np.int64), said[: max(steps - a, 0)]]) for a in range(max(order - 1, 0))]
    history = np.stack(behind, axis=-1) if behind else np.zeros((steps, n, 0), np.int64)
    known = on & (asked >= 0)
    h = np.stack(states[1:]) if steps else np.zeros((0, n, dims), states[0].dtype)
    logs = np.full((steps, n), np.nan)
    logs[known], dh = likelihoods(m, bounds, order, h[known], history[known], asked[known], g)
    if g is not None and steps:
        above, back = np.zeros_like(h), np.zeros((n, dims), h.dtype)
        above[known] = dh
        for t in range(steps - 1, -1, -1):
            d = (above[t] + back) * h[t] * (1 - h[t])
            g["again"] += states[t].T @ d
            here = said[t] >= 0
            np.add.at(g["words"], said[t][here], d[here])
            back = d @ m["again"].T
    return [logs[: len(r) + 1, k] for k, r in enumerate(rows)], float(-logs[known].sum()), int(known.sum())


def _cut(lengths: list[int], m: Model, bounds: np.ndarray) -> Iterator[list[int]]:
    widest = max(int(np.diff(bounds).max()), len(bounds))
    return recurrent._batches(lengths, max(1, CELLS // (widest + 4 * m["again"].shape[0])))


def _numbered(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """``ids`` in place of ``tokens``, -1 for unknown words: one below the numbers of the recurrent encoders, whose 1 is the unknown word."""
    rows = recurrent.numbered_words(sentences, words)
    return rows.withColumn("ids", F.transform("ids", lambda w: F.when(w == recurrent.UNKNOWN, F.lit(-1)).otherwise(w - 1)))


def learn(sentences: DataFrame, s: Settings) -> tuple[Language, list[float]]:
    """A model of the sentences (``id, tokens``), and after each epoch the held sentences' mean ``log p`` of a word (none held: none).

    The rate is halved as ``Settings.gain`` says; an epoch that makes the held sentences less likely is taken back.
    """
    tables = Tables(sentences.sparkSession, "language")
    words = tables.put(recurrent.vocabulary(sentences, s.words + 1), "words")
    rows = tables.put(_numbered(sentences.select("id", "tokens"), words), "ids")
    found = rows.select(F.explode(F.concat("ids", F.array(F.lit(0)))).alias("w")).filter("w >= 0").groupBy("w").count().collect()  # one row a word of the vocabulary
    counts = np.zeros(words.count() + 1)
    for w, n in found:
        counts[w] = n
    bounds = class_bounds(counts, s.classes)
    fold = F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.lit(s.held))
    part = F.pmod(F.xxhash64(F.lit(s.seed + 1), "id"), F.lit(s.steps))
    teaching = tables.put(rows.filter(F.size("ids") <= s.longest).select(fold.alias("fold"), part.alias("part"), "ids"), "teaching")
    order, m, state, seen, rate, halving = s.order, first_model(s, len(counts), len(bounds) - 1), {}, [], s.rate, False

    def teach(model: Model, batch: pa.RecordBatch, g: Model) -> tuple[float, int]:
        ids, loss, n = batch.column(0).to_pylist(), 0.0, 0
        for at in _cut([len(r) for r in ids], model, bounds):
            _, more, some = run(model, bounds, order, [ids[k] for k in at], g)
            loss, n = loss + more, n + some
        return loss, n

    def held(batch_rows: DataFrame) -> float | None:
        logs = _logs(batch_rows, Language(m, bounds, words, order)).select(F.explode("logs").alias("p")).filter("not isnan(p)")
        return logs.agg(F.avg("p")).first()[0]

    before = held(teaching.filter("fold = 0").select(F.lit(0).alias("id"), "ids"))
    for _ in range(s.epochs):
        old = {k: x.copy() for k, x in m.items()}
        for k in range(s.steps):
            g, _, n = recurrent.summed(teaching.filter((F.col("part") == k) & (F.col("fold") > 0)).select("ids"), m, teach)
            if n:
                optimisers.RULES[s.rule](m, optimisers.shortened({key: x / n for key, x in g.items()}, s.clip), state, rate)
        now = held(teaching.filter("fold = 0").select(F.lit(0).alias("id"), "ids"))
        if now is None:
            continue
        seen.append(now)
        small = now * s.gain < before
        if now < before:
            m = old
        before = max(now, before)
        if small and halving:
            break
        halving = halving or small
        rate = rate / 2 if halving else rate
    return Language(m, bounds, words, order), seen


def _logs(rows: DataFrame, language: Language) -> DataFrame:
    """``id, logs`` of ``id, ids``."""
    shared = rows.sparkSession.sparkContext.broadcast(language.m)
    bounds, order = language.bounds, language.order

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [r or [] for r in batch.column(1).to_pylist()]
            out: list[np.ndarray | None] = [None] * len(ids)
            for at in _cut([len(r) for r in ids], shared.value, bounds):
                for k, logs in zip(at, run(shared.value, bounds, order, [ids[k] for k in at])[0]):
                    out[k] = logs
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "logs"])

    return rows.select("id", "ids").mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, logs array<double>")


def word_probabilities(sentences: DataFrame, language: Language) -> DataFrame:
    """``id, pos, p``: of every word of ``id, tokens`` and of the sentence's end, which comes last; an unknown word's is null."""
    logs = _logs(_numbered(sentences.select("id", "tokens"), language.words), language)
    each = logs.select("id", F.posexplode("logs").alias("pos", "log_p"))
    return each.select("id", "pos", F.when(~F.isnan("log_p"), F.exp("log_p")).alias("p"))


def bigram_counts(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``before, term, n`` of words that follow each other, and ``before, total``; a sentence's end, "", stands before and behind its words."""
    pairs = _pairs(sentences).groupBy("before", "term").agg(F.count(F.lit(1)).alias("n"))
    return pairs, pairs.groupBy("before").agg(F.sum("n").alias("total"))


def _present() -> Column:
    return F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda w: w.isNotNull())


def _behind(tokens: Column) -> Column:
    """What stands behind each word and the sentence's beginning."""
    return F.concat(tokens, F.array(F.lit("")))


def _pairs(sentences: DataFrame) -> DataFrame:
    tokens = _present()
    after = _behind(tokens)
    both = F.arrays_zip(F.concat(F.array(F.lit("")), tokens).alias("before"), after.alias("term"))
    return sentences.select("id", F.posexplode(both).alias("pos", "x")).select("id", "pos", "x.before", "x.term")


def bigram_probabilities(sentences: DataFrame, taught: DataFrame, k: float = 1.0) -> DataFrame:
    """``before, term, times, p`` of each pair of following words in ``sentences``, by the counts of ``taught`` with ``k`` added to each.

    The vocabulary is that of ``taught``, the end among it; the probability of a word outside it is null.  Pairs are counted before they are joined,
    so that a frequent one is one row.  Each word is followed by one, so words' own counts are the totals, and the pairs are counted once.
    """
    asked = _pairs(sentences).groupBy("before", "term").agg(F.count(F.lit(1)).alias("times"))
    pairs = bigram_counts(taught)[0]
    words = taught.select(F.explode(_behind(_present())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    words = Tables(taught.sparkSession, "bigrams").put(words, "words")
    size = words.count()
    known, totals = near(words.select("term", F.lit(True).alias("known"))), near(words.select(F.col("term").alias("before"), "total"))
    met = asked.join(known, "term", "left").join(pairs, ["before", "term"], "left").join(totals, "before", "left")
    p = (F.coalesce("n", F.lit(0)) + F.lit(k)) / (F.coalesce("total", F.lit(0)) + F.lit(k) * F.lit(size))
    return met.select("before", "term", "times", F.when(F.col("known"), p).alias("p"))


def with_bigrams(sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, pos, other``: what ``bigram_probabilities`` gives, at each place of the sentences; a frequent pair's rows are split by AQE's skew join."""
    return _pairs(sentences).join(pairs.select("before", "term", F.col("p").alias("other")), ["before", "term"], "left").select("id", "pos", "other")


def score(words: DataFrame, by: list[str] = (), weight: float | None = None) -> DataFrame:
    """``words`` scored, ``log_p`` (base 10) and ``perplexity``, of all rows (``p``) or by the columns ``by``.

    Unknown words (p null) are not counted.  With ``weight`` also those of the other model (``other``; null as 0) and of the mixture
    ``weight * p + (1 - weight) * other``; then an unknown word counts if the other model knows it, at 10^-8 in ``log_p``.
    """
    p, times = F.col("p"), F.col("times") if "times" in words.columns else F.lit(1)
    if weight is None:
        rows = words.filter(p.isNotNull()).withColumn("a", F.log10(p))
        names = {"log_p": "a"}
    else:
        other = F.coalesce("other", F.lit(0.0))
        rows = words.filter(p.isNotNull() | (other > 0)).withColumn("a", F.when(p.isNull(), UNKNOWN_COST).otherwise(F.log10(p)))
        log = lambda x: F.when(x > 0, F.log10(x)).otherwise(F.lit(float("-inf")))
        rows = rows.withColumn("b", log(other)).withColumn("c", log(weight * F.coalesce(p, F.lit(0.0)) + (1 - weight) * other))
        names = {"log_p": "a", "other_log_p": "b", "mixed_log_p": "c"}
    sums = rows.groupBy(*by).agg(F.sum(times).alias("words"), *(F.sum(F.col(c) * times).alias(name) for name, c in names.items()))
    return sums.select(*by, "words", *names, *(F.pow(10.0, -F.col(n) / F.col("words")).alias(n.replace("log_p", "perplexity")) for n in names))


def rescored(choices: DataFrame, language: Language, weight: float = 1.0) -> DataFrame:
    """``item, choice, log_p, place`` of ``item, choice, tokens, other``: sentences to choose from and their log probability (base 10) by another model.

    ``log_p`` is the weighted mean of both models' (null ``other`` as 0), unknown words at 10^-8; the best of an item has place 1, ties by ``choice``.
    Equal sentences are scored once, so that they tie.
    """
    rows = choices.select("item", "choice", F.coalesce("other", F.lit(0.0)).alias("other"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    texts = Tables(choices.sparkSession, "choices").put(rows.select("tokens").distinct().select(F.monotonically_increasing_id().alias("id"), "tokens"), "texts")
    own = F.aggregate("logs", F.lit(0.0), lambda t, x: t + F.when(F.isnan(x), UNKNOWN_COST).otherwise(x / np.log(10)))
    logs = _logs(_numbered(texts, language.words), language).select("id", own.alias("own")).join(texts, "id")
    mixed = rows.join(logs, "tokens").select("item", "choice", (weight * F.col("own") + (1 - weight) * F.col("other")).alias("log_p"))
    return mixed.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("log_p"), "choice")))


def drawn(ids: DataFrame, language: Language, longest: int = 60, seed: int = 42) -> DataFrame:
    """``id, tokens``: for each id a sentence drawn class by class and word by word; equal ids and seeds draw alike."""
    terms = ["", *(r["term"] for r in language.words.orderBy("id").collect())]  # the vocabulary, bounded by the settings
    shared = ids.sparkSession.sparkContext.broadcast((language.m, terms))
    bounds, order = language.bounds, language.order

    def pick(logs: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.minimum((np.cumsum(np.exp(logs), axis=1) <= at[:, None]).sum(axis=1), logs.shape[1] - 1)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, names = shared.value
        size = len(m["class_cells"]) if order else 1
        for batch in batches:
            n = batch.num_rows
            rngs, said = [np.random.default_rng(x % (1 << 63)) for x in batch.column(1).to_pylist()], [[] for _ in range(n)]
            h, history, live = np.ones((n, m["again"].shape[0]), np.float32), np.zeros((n, max(order - 1, 1)), np.int64), np.arange(n)
            for _ in range(longest):
                if not len(live):
                    break
                h[live] = sigmoid(m["words"][history[live, 0]] + h[live] @ m["again"])
                chance = np.array([rngs[r].random(2) for r in live])
                group = pick(shares(m, "classes", 0, len(bounds) - 1, h[live], first_cells(history[live], np.zeros(len(live), np.int64), order, size)), chance[:, 0])
                word = np.zeros(len(live), np.int64)
                for c in np.unique(group):
                    on = np.flatnonzero(group == c)
                    cells = first_cells(history[live[on]], group[on] + 1, order, size)
                    word[on] = bounds[c] + pick(shares(m, "out", bounds[c], bounds[c + 1], h[live[on]], cells), chance[on, 1])
                history[live, 1:] = history[live, :-1]
                history[live, 0] = word
                for r, w in zip(live[word > 0], word[word > 0]):
                    said[r].append(names[w])
                live = live[word > 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.list_(pa.string()))], names=["id", "tokens"])

    kind = f"id {ids.schema['id'].dataType.simpleString()}, tokens array<string>"
    return ids.select("id", F.xxhash64(F.lit(seed), "id")).mapInArrow(draw, kind)


def printed_probabilities(lines: DataFrame) -> DataFrame:
    """``p`` of each line (``value``) that another tool printed as ``p( word | before ...) = [kind] p [ log p ]``; other lines, and null ones, give none."""
    p = F.regexp_extract("value", r"^\s*p\(.*\)\s*=\s*\[[^\]]*\]\s+([-+0-9.eE]+)", 1)
    return lines.withColumn("p", p.try_cast("double")).filter("p is not null")
