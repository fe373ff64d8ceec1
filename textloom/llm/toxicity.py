"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import BROADCAST_ROWS, free_names, pieces, release_memory, short_batches, text_or_empty, worker_state

#: Punctuation and white space that parts words (fixed values).
SEPARATORS = "\t\n\x0b\x0c\r !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANK = {ord(c): " " for c in SEPARATORS}

#: Words whose hash a worker remembers.
MEMO_WORDS = 1 << 17


@dataclass(frozen=True)
class Settings:
    """Hyper-parameters. ``sample_rows`` bounds the labelled rows that are fitted."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 4
    sample_rows: int = 8_000
    threshold: float = 0.3
    seed: int = 11


class Features:
    """Hashed features of a text: words, pairs of neighbours, and pairs with one word between."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.memo: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        memo, found = self.memo, text.lower().translate(_BLANK).split()
        if len(memo) > MEMO_WORDS:
            memo.clear()
        values = []
        for w in found:
            h = memo.get(w)
            if h is None:
                h = memo[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1
            values.append(h)
        return np.array(values, np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        w = self.words(text)
        with np.errstate(over="ignore"):
            a, b, c = w * np.uint64(0x9E3779B97F4A7C15), w * np.uint64(0xC2B2AE3D27D4EB4F), w * np.uint64(0x165667B19E3779F9)
            keys = np.concatenate([a, (a[:-1] ^ b[1:]) * np.uint64(0xFF51AFD7ED558CCD), (a[:-2] ^ c[2:]) * np.uint64(0xC4CEB9FE1A85EC53)])
        return (keys >> self.shift).astype(np.int64)


class Ftrl:
    """FTRL-proximal: a learning rate for each coordinate and sparsity by L1."""

    def __init__(self, settings: Settings):
        self.s = settings
        size = 1 << settings.bits
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z, n = self.s, self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, s.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def learn(self, features: np.ndarray, label: float) -> None:
        """One step; features are distinct."""
        at = np.append(features, len(self.z) - 1)
        n, w = self.n[at], self.weights(at)
        p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w.sum())))))
        g = p - label
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero weights: (coordinates, values, bias).

    Learns from at most ``settings.sample_rows`` ids of ``labels`` (more than BROADCAST_ROWS
    are refused), those that a seeded hash of the id puts first; of several labels for an id the
    largest, of several texts the one with the smallest hash, so an id teaches once however often
    it is repeated.  Rows with a null id or label, or an id that ``docs`` lacks, teach nothing.
    One task reads this bounded sample; without any row the bias is 0 and all scores 0.5.
    """
    if settings.sample_rows > BROADCAST_ROWS:
        raise ValueError(f"sample_rows is at most {BROADCAST_ROWS}")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna()
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("o", F.xxhash64("doc_id", F.lit(settings.seed)))
    chosen = chosen.orderBy("o", "doc_id").limit(settings.sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id")  # bounded by sample_rows
    sample = sample.groupBy("o", "y", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("o", "y", F.col("t.text").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings.bits)
        for batch in pieces(batches):
            rows = [np.unique(features(t)).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["o", "y", "f"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(o, y, f) for b in batches for o, y, f in zip(*(b.column(i).to_pylist() for i in range(3)))]
        rows.sort()
        model = Ftrl(settings)
        for epoch in range(settings.epochs if rows else 0):
            order = np.random.Generator(np.random.PCG64([settings.seed, epoch])).permutation(len(rows))
            for i in order:
                model.learn(np.frombuffer(rows[i][2], "<i4").astype(np.int64), float(rows[i][1]))
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["at", "w"])

    with short_batches(docs.sparkSession):
        found = sample.mapInArrow(hashed, "o long, y int, f binary").repartition(1).mapInArrow(fit, "at long, w double").collect()
    at, w = np.array([r["at"] for r in found], np.int64), np.array([r["w"] for r in found])
    end = 1 << settings.bits
    return at[at < end], w[at < end], float(w[at == end].sum())


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], settings: Settings, text_col: str, name: str, below: float | None = None) -> DataFrame:
    """docs with a column ``name``: the score from 0 to 1, higher for likelier toxic; a null text counts as empty.

    With ``below`` only rows of a lower score come.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # non-zero weights, 2**bits at most
    key, at_text = uuid.uuid4().hex, docs.columns.index(text_col)
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def total(features: Features, dense: np.ndarray, bias: float, text: str) -> float:
        at = features(text)
        w = dense[at]
        hit = np.flatnonzero(w)
        if not len(hit):
            return bias
        _, first = np.unique(at[hit], return_index=True)  # each feature counts once
        return float(w[hit[first]].sum(dtype=np.float64)) + bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("toxicity")
        if state.get("id") != key:
            at, w, bias = shared.value
            dense = np.zeros(1 << settings.bits, np.float32)
            dense[at] = w
            state |= {"id": key, "dense": dense, "bias": bias, "features": state.get("features") or Features(settings.bits)}
        dense, bias, features = state["dense"], state["bias"], state["features"]
        for batch in pieces(batches):
            totals = [total(features, dense, bias, t or "") for t in batch.column(at_text).to_pylist()]
            score = 1.0 / (1.0 + np.exp(-np.clip(np.array(totals, float), -35, 35)))
            rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=out.names)
            yield rows if below is None else rows.filter(pa.array(score < below))
        release_memory()

    return docs.mapInArrow(run, out)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Learns from labelled rows that are not held out.  Null and empty texts get
    the bias' score, a null id is not held out, repeated rows score alike, an empty
    table gives none; other columns are not read.
    """
    model = train(docs, labels.filter(~held_out(id_col)), settings, id_col, text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return scored(own, model, settings, "text", "score").select("doc_id", "held_out", "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float | None = None) -> DataFrame:
    """The rows of docs, all columns, whose score stays below the threshold. Columns may have any names."""
    model = train(docs, labels.filter(~held_out()), settings)
    name = free_names(docs, "score")[0]
    return scored(docs, model, settings, "text", name, settings.threshold if threshold is None else threshold).drop(name)
