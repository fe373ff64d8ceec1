"""Overlap scores of peer summaries against model summaries, their averages and bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.relational import numbered

#: Exponent of the weight of consecutive matches.
RUN_WEIGHT = 1.2


def hits(peers: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """``key, hit, peer, model``: clipped common units and the units of each side, from counts ``key, gram, n``."""
    p, m = peers.withColumnRenamed("n", "p"), models.withColumnRenamed("n", "m")
    both = p.join(m, [key, "gram"]).groupBy(key).agg(F.sum(F.least("p", "m")).alias("hit"))
    sizes = p.groupBy(key).agg(F.sum("p").alias("peer")).join(m.groupBy(key).agg(F.sum("m").alias("model")), key)
    return sizes.join(both, key, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def common_units(peers: DataFrame, models: DataFrame, key: str, units: Column) -> DataFrame:
    """As ``hits``, of the ``units`` of each row's ``tokens``: the tokens of both sides are shuffled by ``key``, their many units are not."""
    p, m = (side.select(key, "tokens", F.lit(k).alias("side")) for k, side in enumerate((peers, models)))
    each = p.unionByName(m).filter(F.col(key).isNotNull()).repartition(key).select(key, "side", F.explode(units).alias("gram"))
    counts = each.groupBy(key, "gram").agg(*[F.sum(F.when(F.col("side") == k, 1).otherwise(0)).alias(c) for k, c in enumerate("pm")])
    sums = counts.groupBy(key).agg(F.sum(F.least("p", "m")).alias("hit"), F.sum("p").alias("peer"), F.sum("m").alias("model"))
    return sums.filter("peer > 0 and model > 0").select(key, "peer", "model", "hit")


def best_model(scored: DataFrame, key: str, model: str) -> DataFrame:
    """Of several models of a peer the one with the best recall (ties: the smallest name); the other mode sums hits and sizes over models."""
    order = F.struct(F.col("hit") / F.col("model"), F.col(model))
    return scored.groupBy(key).agg(F.max_by(F.struct("hit", "peer", "model"), order).alias("b")).select(key, "b.*")


def scores(counted: DataFrame, alpha: float = 0.5, digits: int = 5) -> DataFrame:
    """Adds ``recall, precision, f1`` to ``hit, peer, model``."""
    r = F.when(F.col("model") > 0, F.col("hit") / F.col("model")).otherwise(0.0)
    p = F.when(F.col("peer") > 0, F.col("hit") / F.col("peer")).otherwise(0.0)
    f = F.when((1 - alpha) * p + alpha * r > 0, r * p / ((1 - alpha) * p + alpha * r)).otherwise(0.0)
    return counted.withColumns({"recall": F.round(r, digits), "precision": F.round(p, digits), "f1": F.round(f, digits)})


def averages(counted: DataFrame) -> DataFrame:
    """One row: the means of the scores, the scores of the summed counts, and those sums."""
    each = scores(counted)
    total = each.agg(*[F.sum(c).alias(c) for c in ("hit", "peer", "model")], *[F.avg(c).alias(f"mean_{c}") for c in ("recall", "precision", "f1")])
    return scores(total).select(*[F.round(f"mean_{c}", 5).alias(f"mean_{c}") for c in ("recall", "precision", "f1")], "recall", "precision", "f1", "hit", "peer", "model")


def bootstrap(values: DataFrame, value: str, order: str, resamples: int = 1000, confidence: float = 0.95) -> DataFrame:
    """One row ``mean, low, high``: the mean of the resamples' means and their interpolated quantiles.

    Each resample draws as many rows as there are, by a hash of its number and the draw; ``order`` is a unique number of each row.
    """
    n = values.count()
    placed = numbered(values.select(F.col(order).alias("o"), F.col(value).alias("x")), ["o"]).select(F.col("id").alias("place"), "x")
    draws = values.sparkSession.range(resamples * n).select(F.floor(F.col("id") / max(n, 1)).alias("resample"), F.col("id"))
    draws = draws.withColumn("place", F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long") % max(n, 1) + 1)
    means = draws.join(placed, "place").groupBy("resample").agg(F.avg("x").alias("m"))
    tail = (1 - confidence) / 2
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


def be_units(lines: Column, mode: str = "HM") -> Column:
    """Units of ``head|modifier|relation`` lines: the parts that the mode's letters name."""
    parts = {"H": 0, "M": 1, "R": 2}
    return F.transform(lines, lambda x: F.concat_ws("|", *[F.get(F.split(x, r"\|"), F.lit(parts[m])) for m in mode]))


def _matched(model: list[str], peer: list[str], power: float) -> np.ndarray:
    """Which of the model's words lie on a longest common subsequence with the peer; runs weigh ``length ** power``."""
    score = np.zeros((len(model) + 1, len(peer) + 1))
    run = np.zeros((len(model) + 1, len(peer) + 1), int)
    for i, x in enumerate(model, 1):
        for j, y in enumerate(peer, 1):
            if x == y:
                k = run[i - 1, j - 1]
                score[i, j] = score[i - 1, j - 1] + (k + 1) ** power - k**power
                run[i, j] = k + 1
            elif score[i - 1, j] >= score[i, j - 1]:
                score[i, j] = score[i - 1, j]
            else:
                score[i, j] = score[i, j - 1]
    found, i, j = np.zeros(len(model), bool), len(model), len(peer)
    while i and j:
        if run[i, j]:
            found[i - 1] = True
            i, j = i - 1, j - 1
        elif score[i - 1, j] >= score[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return found


def sequence_hits(model: list[list[str]], peer: list[list[str]], power: float = 1.0) -> tuple[float, float, float]:
    """(hit, peer, model) weights: each model sentence's words that match any peer sentence, each word used as often as both sides hold it.

    With ``power`` above 1, runs of matched words weigh more than single ones.  A run ends before a word that no peer sentence
    matches; a matched word that is used up neither ends nor adds to it, and ends the sentence without its run being counted.
    The model's weight is the power of the sum of its sentences' weights.
    """
    left = [{}, {}]
    for side, text in zip(left, (model, peer)):
        for word in (w for s in text for w in s):
            side[word] = side.get(word, 0) + 1
    hit = base = 0.0
    for sentence in model:
        marks = np.zeros(len(sentence), bool)
        for other in peer:
            marks |= _matched(sentence, other, power)
        run = 0
        for k, (word, mark) in enumerate(zip(sentence, marks)):
            if not mark or left[0].get(word, 0) <= 0 or left[1].get(word, 0) <= 0:
                continue
            left[0][word] -= 1
            left[1][word] -= 1
            run += 1
            if power == 1:
                hit += 1
            elif k + 1 == len(sentence) or not marks[k + 1]:
                hit += run**power
                run = 0
        base += len(sentence) ** power
    return hit, float(sum(map(len, peer))) ** power, base**power


def sequence_scores(pairs: DataFrame, power: float = 1.0) -> DataFrame:
    """Adds ``recall, precision, f1`` of longest common subsequences to rows with ``peer`` and ``model`` (arrays of sentences of tokens).

    With ``power`` the weighted variant; its ratios are brought back by the inverse power.  A null side has no sentences,
    a null sentence no words; both give scores of 0.
    """

    def run(model: pd.Series, peer: pd.Series) -> pd.DataFrame:
        out = []
        for m, p in zip(model, peer):
            hit, of_peer, of_model = sequence_hits(*([[] if s is None else list(s) for s in ([] if x is None else x)] for x in (m, p)), power)
            r, q = ((hit / x) ** (1 / power) if x else 0.0 for x in (of_model, of_peer))
            out.append((r, q, 2 * r * q / (r + q) if r + q else 0.0))
        return pd.DataFrame(out, columns=["recall", "precision", "f1"])

    kind = "struct<recall:double,precision:double,f1:double>"
    scored = pairs.withColumn("s", F.pandas_udf(run, kind)("model", "peer"))
    return scored.select(*[c for c in pairs.columns if c not in ("peer", "model")], *[F.round(f"s.{c}", 5).alias(c) for c in ("recall", "precision", "f1")])
