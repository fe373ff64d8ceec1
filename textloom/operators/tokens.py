"""Operators on token arrays and vocabularies."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import stem
from textloom.operators.relational import numbered, running_total


def encoded(rows: DataFrame, vocabulary: DataFrame, keys: list[str], unknown: int | None = 1) -> DataFrame:
    """``keys, ids``: tokens as ids of ``vocabulary`` (``term, id``); unknown ones become ``unknown`` or, if that is None, go."""
    words = rows.select(*keys, F.posexplode_outer("tokens").alias("place", "term")).join(vocabulary.select("term", "id"), "term", "left")
    known = F.when(F.col("term").isNotNull(), F.coalesce("id", F.lit(unknown)) if unknown is not None else F.col("id"))
    pairs = F.array_sort(F.collect_list(F.when(known.isNotNull(), F.struct("place", known.cast("long").alias("id")))))
    return words.groupBy(*keys).agg(F.transform(pairs, lambda p: p["id"]).alias("ids"))


def without_shared(target: Column, source: Column) -> Column:
    """The target's tokens that the source does not hold, repeats kept."""
    return F.filter(target, lambda x: ~F.array_contains(source, x))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def evaluation_tokens(text: Column, stop_words: Sequence[str] = (), stems: bool = False, exceptions: dict[str, str] | None = None) -> Column:
    """Tokens for overlap scores: hyphens stand alone, anything but letters, digits and hyphens parts words, only ASCII letters are lower-cased.

    Stop words go first, then what begins with neither letter nor digit; with ``stems``, words of more than three letters become
    what ``exceptions`` says, else their stem.
    """
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.regexp_replace(F.regexp_replace(lower, "-", " - "), "[^a-z0-9-]", " ")
    words = F.split(plain, " +")
    if stop_words:
        words = F.filter(words, lambda x: ~x.isin(*stop_words))
    words = F.filter(words, lambda x: x.rlike("^[a-z0-9$]"))
    return stem.stemmed(words, exceptions, 3) if stems else words


def _chosen(tokens: Column, share: float, key: Column) -> Column:
    """The places (from 0) of the round(share * n) tokens that a hash of key and place puts first."""
    places = F.transform(tokens, lambda x, i: F.struct(F.md5(F.concat(key, F.lit("-"), i.cast("string"))).alias("h"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(places), F.lit(1), F.round(F.size(tokens) * share).cast("int")), lambda p: p["i"])


def _with(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def masked(tokens: Column, share: float, key: Column, mask: str = "<unk>") -> Column:
    return _with(_chosen(tokens, share, key), lambda c: F.transform(tokens, lambda x, i: F.when(F.array_contains(c, i), F.lit(mask)).otherwise(x)))


def removed(tokens: Column, share: float, key: Column) -> Column:
    return _with(_chosen(tokens, share, key), lambda c: F.filter(tokens, lambda x, i: ~F.array_contains(c, i)))


def swapped(tokens: Column, share: float, key: Column) -> Column:
    """Neighbours exchanged in the chosen of the pairs (first and second, third and fourth, ...), so that no token moves twice."""
    pairs = F.slice(tokens, F.lit(1), F.floor(F.size(tokens) / 2).cast("int"))  # one entry a pair

    def moved(chosen: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            inside = F.array_contains(chosen, F.floor(i / 2).cast("int"))
            return F.when(inside, F.get(tokens, F.when(i % 2 == 0, i + 1).otherwise(i - 1))).otherwise(x)

        return F.transform(tokens, at)

    return _with(_chosen(pairs, share, key), moved)


class _Merges:
    """A Huffman tree over classes of nodes of one weight: whole classes are paired at once, so its size follows the distinct counts, not the words.

    ``parts[c]`` are stretches of class c: (first place, last place + 1, parent class, parent's first place, bit), where bit None
    means pairs: places 2k and 2k + 1 become place k of the parent, with the bits 0 and 1.
    """

    def __init__(self, counts: list[tuple[int, int]]):
        self.parts: list[list[tuple]] = [[] for _ in counts]
        heap = [(n, k, 0, m) for k, (n, m) in enumerate(counts)]  # weight, class, first place, members
        heapq.heapify(heap)
        while heap:
            n, c, first, m = heapq.heappop(heap)
            if m > 1:
                pairs = m // 2
                up = self._new()
                self.parts[c].append((first, first + 2 * pairs, up, 0, None))
                heapq.heappush(heap, (2 * n, up, 0, pairs))
                if m % 2:
                    heapq.heappush(heap, (n, c, first + m - 1, 1))
            elif heap:
                n2, c2, first2, m2 = heapq.heappop(heap)
                up = self._new()
                self.parts[c].append((first, first + 1, up, 0, "0"))
                self.parts[c2].append((first2, first2 + 1, up, 0, "1"))
                heapq.heappush(heap, (n + n2, up, 0, 1))
                if m2 > 1:
                    heapq.heappush(heap, (n2, c2, first2 + 1, m2 - 1))

    def _new(self) -> int:
        self.parts.append([])
        return len(self.parts) - 1

    def code(self, c: int, place: int) -> str:
        bits = []
        while True:
            part = next((p for p in self.parts[c] if p[0] <= place < p[1]), None)
            if part is None:
                return "".join(reversed(bits))
            first, _, up, at, bit = part
            bits.append(bit or str((place - first) % 2))
            c, place = up, at + (0 if bit else (place - first) // 2)


def huffman_codes(vocabulary: DataFrame) -> DataFrame:
    """``term, code``: binary codes of shortest mean length by ``term, n``; one term alone has the empty code.

    The tree is built from how many words have each count (at most the root of twice the total of counts); every
    word then reads its code off by its place among the words of its count.
    """
    by_count = sorted((r["n"], r["count"]) for r in vocabulary.groupBy("n").count().collect())  # distinct counts
    merges, first, before = _Merges(by_count), {}, 0
    for k, (n, m) in enumerate(by_count):
        first[n], before = (k, before), before + m
    placed = numbered(vocabulary.select("term", "n"), ["n", "term"], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merges.code(first[n][0], at - first[n][1]) for n, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["term", "code"])

    return placed.select("term", "n", "id").mapInArrow(run, "term string, code string")


def word_breaks(text: Column, ranked: list[str]) -> Column:
    """Texts without blanks, cut into words at the least total cost ln((rank + 1) ln N) of the list's N words; a character of no word costs more than all of them."""
    cost = {w: math.log((i + 1) * math.log(max(len(ranked), 2))) for i, w in reversed(list(enumerate(ranked)))}
    longest, dear = max(map(len, cost), default=1), 1e6

    def cut(line: str) -> str:
        best, back = [0.0], [0]
        for end in range(1, len(line) + 1):
            options = [(best[begin] + (cost[line[begin:end]] if line[begin:end] in cost else dear), begin) for begin in range(max(0, end - longest), end) if line[begin:end] in cost or begin == end - 1]
            value, begin = min(options)
            best.append(value)
            back.append(begin)
        words, at = [], len(line)
        while at:
            words.append(line[back[at] : at])
            at = back[at]
        return " ".join(reversed(words))

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else cut(t))

    return F.pandas_udf(run, "string")(text)


def sample_with_replacement(rows: DataFrame, id_col: str, draws: int, seed: int = 2000) -> DataFrame:
    """``draw`` and the columns of rows: ``draws`` rows chosen by hash, each from all rows in the order of the id (unique)."""
    n = rows.count()
    hashed = F.conv(F.substring(F.md5(F.concat(F.col("draw").cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("long")
    chosen = rows.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn("place", hashed % max(n, 1) + 1)
    placed = running_total(rows, [id_col], F.lit(1).cast("long")).withColumnRenamed("upto", "place")
    return chosen.join(placed, "place").select("draw", *rows.columns)
