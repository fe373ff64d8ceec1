"""Document fingerprints by a randomised edit embedding.

The embedding walks over a text's characters: at each step ``j`` it writes the
character it stands on, and a random bit shared by all texts, which depends on
``j`` and the character, says whether it moves on.  Texts a few edits apart soon
walk in step again, so edit distance becomes Hamming distance of what was written.
A fingerprint samples the written characters at shared steps.  Finer samples
contain the coarser ones, so texts of unlike lengths remain comparable.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import Scratch, text_or_empty, worker_state
from textloom.llm.components import connected_components

CLASSES = 256
PERIOD = 4096
#: A fingerprint has between this many samples and twice as many, but for short texts.
SAMPLES = 96
SEED = 7
#: Characters walked over at once.
CELLS = 4 << 20
#: Fingerprints of a bucket that meet in one task at once, and those meant for one task.
PART = 4_096
TASK_PRINTS = 50_000
#: Ranges that ``compare_with_next`` deals documents into, at most; the driver holds a few numbers of each.
RANGES = 16_384


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply, constants of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walker:
    """The shared randomness: how long a walk stays on a character, and which steps are sampled."""

    def __init__(self, seed: int = SEED):
        with np.errstate(over="ignore"):
            grid = np.arange(CLASSES * PERIOD, dtype=np.uint64) + np.uint64(seed * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)
            bits = (_mix(grid) >> np.uint64(40)).astype(np.int64) & 1
        bits = bits.reshape(CLASSES, PERIOD)
        bits[:, -1] = 1
        # stay[c, j]: steps from j until the bit of (c, step) is 1, that step included.
        stay = np.empty((CLASSES, PERIOD), np.int64)
        stay[:, -1] = 1
        for j in range(PERIOD - 2, -1, -1):
            stay[:, j] = np.where(bits[:, j] == 1, 1, stay[:, j + 1] + 1)
        self.stay = stay.ravel().astype(np.int32)
        self.seed = seed
        self.steps: dict[int, np.ndarray] = {}

    def sampled(self, level: int, n: int) -> np.ndarray:
        """Sampled steps below n: of every 2**level steps one, a subset of those of lower levels."""
        known = self.steps.get(level)
        if known is None or (len(known) and known[-1] < n) or not len(known):
            upto = max(2 * n, 4 * SAMPLES << level)
            with np.errstate(over="ignore"):
                h = _mix(np.arange(upto, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))
            known = np.flatnonzero((h & np.uint64((1 << level) - 1)) == 0)
            known = np.append(known, upto)
            self.steps[level] = known
        return known[: np.searchsorted(known, n)]


def level_of(steps: int) -> int:
    """The level that leaves SAMPLES up to twice as many of this many steps."""
    level = 0
    while steps >> (level + 1) >= SAMPLES:
        level += 1
    return level


HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(walker: Walker, codes: list[np.ndarray], starts: list[int] | None = None) -> list[np.ndarray]:
    """Per text, the step at which the walk leaves each character; all texts walk at once.

    ``starts`` are the steps at which the walks begin.
    """
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    left: list = [None] * len(codes)
    at = 0
    while at < len(order):
        longest = len(codes[order[at]])
        if not longest:
            for i in order[at:]:
                left[i] = np.zeros(0, np.int32)
            break
        take = order[at : at + max(1, CELLS // longest)]
        at += len(take)
        lengths = np.array([len(codes[i]) for i in take])
        matrix = np.zeros((longest, len(take)), np.int32)
        for k, i in enumerate(take):
            matrix[: len(codes[i]), k] = (codes[i] & (CLASSES - 1)).astype(np.int32) * PERIOD
        step = np.array([starts[i] if starts else 0 for i in take], np.int32)
        active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
        stay = walker.stay
        for row, m in enumerate(active.tolist()):
            now = step[:m]
            cell = matrix[row, :m]
            cell += now & (PERIOD - 1)
            now += stay.take(cell)
            cell[:] = now
        for k, i in enumerate(take):
            left[i] = matrix[: lengths[k], k].copy()
    return left


def render(walker: Walker, codes: np.ndarray, left: np.ndarray) -> str:
    """``level:samples``; a sample is one hexadecimal digit, a hash of the character written at that step."""
    if not len(codes):
        return "0:"
    steps = int(left[-1])
    level = level_of(steps)
    at = walker.sampled(level, steps)
    written = codes[np.searchsorted(left, at, side="right")]
    with np.errstate(over="ignore"):
        digits = _mix(written.astype(np.uint64) + np.uint64(walker.seed * 31 + 1)) & np.uint64(15)
    return f"{level:x}:" + HEX[digits.astype(np.int64)].tobytes().decode()


def likeness(walker: Walker, a: str, b: str) -> float:
    """Share of the sampled steps, of either text, at which both wrote alike (1.0 for two empty texts)."""
    if a == b:
        return 1.0
    (la, _, sa), (lb, _, sb) = a.partition(":"), b.partition(":")
    la, lb = int(la, 16), int(lb, 16)
    level = max(la, lb)
    x, y = _coarser(walker, sa, la, level), _coarser(walker, sb, lb, level)
    n, most = min(len(x), len(y)), max(len(x), len(y))
    return float((x[:n] == y[:n]).sum()) / most if most else 1.0


def _coarser(walker: Walker, digits: str, level: int, to: int) -> np.ndarray:
    values = np.frombuffer(digits.encode(), np.uint8)
    if level == to or not len(values):
        return values
    fine = walker.sampled(level, _upto(walker, level, len(values)))[: len(values)]
    return values[np.isin(fine, walker.sampled(to, int(fine[-1]) + 1))]


def _upto(walker: Walker, level: int, count: int) -> int:
    """A step below which there are at least ``count`` samples of the level."""
    n = max(64, 2 * count << level)
    while len(walker.sampled(level, n)) < count:
        n *= 2
    return n


def _walker() -> Walker:
    state = worker_state("edit-embedding")
    if "walker" not in state:
        state["walker"] = Walker()
    return state["walker"]


def fingerprint_texts(texts: list[str]) -> list[str]:
    walker = _walker()
    codes = [codes_of(t) for t in texts]
    return [render(walker, c, j) for c, j in zip(codes, walk(walker, codes))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every whole text; null texts count as empty."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(fingerprint_texts(texts))], names=out.names)

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).mapInArrow(run, out)


def _band_picks(bands: int, digits: int, width: int) -> np.ndarray:
    """Shared places of the samples that each band takes."""
    return np.random.Generator(np.random.PCG64([SEED, bands])).integers(0, width, (bands, digits))


def band_keys(walker: Walker, fingerprint: str, bands: int, digits: int) -> list[tuple[int, int]]:
    """(level, key) of the buckets of a fingerprint: its bands at its own level and at the next coarser one, as lengths of near-copies differ."""
    level, _, s = fingerprint.partition(":")
    level, found = int(level, 16), []
    for to in (level, level + 1):
        values = _coarser(walker, s, level, to)
        if not len(values):
            continue
        picks = _band_picks(bands, digits, SAMPLES // 2)
        picks = picks[(picks < len(values)).all(axis=1)] if len(values) < SAMPLES // 2 else picks
        parts = [(b, values[p].tobytes()) for b, p in enumerate(picks)] or [(-1, values.tobytes())]
        found += [(to, int.from_bytes(hashlib.blake2b(b"%d:%d:" % (to, b) + x, digest_size=8).digest(), "big", signed=True)) for b, x in parts]
    return sorted(set(found))


def linked(walker: Walker, prints: list[str], level: int, least: float, first: int | None = None) -> list[tuple[int, int]]:
    """Links (places in prints) enough to join all that are at least so alike, comparing at ``level``, the coarser of the two prints'.

    Prints one after the other meet all that are not yet joined to them, so a large group of near-copies costs little more than its size.
    With ``first`` only pairs of one of the first so many prints and one of the rest are compared.
    """
    levels = np.array([int(p.partition(":")[0], 16) for p in prints])
    values = [_coarser(walker, p.partition(":")[2], int(k), level) for p, k in zip(prints, levels)]
    sizes = np.array([len(v) for v in values])
    matrix = np.zeros((len(prints), max(int(sizes.max(initial=0)), 1)), np.uint8)
    for row, v in zip(matrix, values):
        row[: len(v)] = v
    root, place, found = np.arange(len(prints)), np.arange(len(prints)), []
    for k in range(len(prints) if first is None else first):
        # Two finer prints meet at their own level, not here.
        other = (root != root[k]) & ((levels == level) | (levels[k] == level)) & (place > k if first is None else place >= first)
        at = np.flatnonzero(other)
        if not len(at):
            continue
        n = np.minimum(sizes[at], sizes[k])
        alike = ((matrix[at] == matrix[k]) & (np.arange(matrix.shape[1])[None] < n[:, None])).sum(axis=1)
        at = at[alike >= least * np.maximum(np.maximum(sizes[at], sizes[k]), 1) - 1e-12]
        if len(at):
            found += [(k, int(x)) for x in at]
            joined = np.unique(np.append(root[at], root[k]))
            root[np.isin(root, joined)] = joined[0]
    return found


def near_classes(docs: DataFrame, least: float = 0.8, bands: int = 12, digits: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, class_id`` of every row: classes of near-copies by their sampled embeddings.

    Bands of a few shared samples put distinct fingerprints in buckets; within a bucket those of a likeness of at least
    ``least`` are linked, and the smallest id reachable names the class.  A pair of likeness 0.8 shares a bucket with a chance of
    0.94 (one of 0.9 always but for 0.2 %); every link made is verified.  Buckets of more than PART fingerprints are dealt into parts that
    meet two by two.  Only keys are shuffled for all fingerprints; the fingerprints themselves only for buckets of several.

    Empty and null texts are one class.  Null ids stay null and name a class only without any other; repeated
    rows give repeated results, an empty table none; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-classes")
    prints = scratch.put(fingerprints(docs, id_col, text_col), "prints")
    own = scratch.put(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("p", F.xxhash64("fingerprint")), "distinct")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walker, rows = _walker(), []
            for p, fingerprint in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(p, to, key) for to, key in band_keys(walker, fingerprint, bands, digits)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.int64()))], names=["p", "level", "key"])

    keys = own.select("p", "fingerprint").mapInArrow(keyed, "p long, level int, key long")
    keys = scratch.put(keys, "keys")
    sizes = keys.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keys.join(sizes, ["level", "key"]).join(own.select("p", "fingerprint"), "p").withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("fingerprint"), "parts").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    met = met.select("level", "key", "fingerprint", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    tasks = max(1, docs.sparkSession.sparkContext.defaultParallelism, -(-own.count() // TASK_PRINTS))
    met = met.withColumn("task", F.pmod(F.xxhash64("level", "key", "i", "j"), F.lit(tasks)))

    def join(rows: pa.Table) -> pa.Table:
        walker, a, b = _walker(), [], []
        rows = rows.sort_by([(c, "ascending") for c in ("level", "key", "i", "j", "part", "fingerprint")])
        level, key, i, j, part = (rows.column(c).to_numpy() for c in ("level", "key", "i", "j", "part"))
        new = np.ones(rows.num_rows + 1, bool)
        new[1:-1] = np.any([x[1:] != x[:-1] for x in (level, key, i, j)], axis=0)
        at = np.flatnonzero(new)
        texts = rows.column("fingerprint")
        for lo, hi in zip(at, at[1:]):
            own = texts.slice(lo, hi - lo).to_pylist()
            first = None if i[lo] == j[lo] else int((part[lo:hi] == i[lo]).sum())
            for x, y in linked(walker, own, int(level[lo]), least, first):
                a.append(own[x])
                b.append(own[y])
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    links = met.groupBy("task").applyInArrow(join, "a string, b string")
    roots = connected_components(scratch.put(links, "links"), scratch).withColumnRenamed("node", "fingerprint")
    of = own.join(roots, "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("fingerprint", "class_id")
    return prints.select("doc_id", "fingerprint").join(scratch.put(named, "classes"), "fingerprint").select("doc_id", "fingerprint", "class_id")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next document's are.

    Documents are ordered by descending id (nulls last), rows of one id by their
    text's hash.  The next of the last is the first; of a lone document, itself.
    The edited text is the text with its last ``floor(n_chars / 3)`` code points
    replaced by as many of the next document's first ones, or all of them.

    A null text counts as empty: its fingerprint is ``0:``.  Columns: ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Texts are dealt once, by ranges of the order with bounds taken from a bounded
    sample of ids (RANGES ranges at most, which a task sorts and reads in pieces); the first document of a range also goes to the range before, so
    each task has all the neighbours it needs and no window spans the table.  Ids must be whole numbers.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    # Ascending keys for the descending order: ~id reverses 64-bit numbers; nulls come last.
    own = own.withColumn("last", F.col("doc_id").isNull().cast("int")).withColumn("k", F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")))
    n, total = own.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long") + 64)).first()
    ranges = min(RANGES, max(1, -(-(total or 0) // bucket_bytes)))
    bounds: list[tuple] = []
    if ranges > 1:
        keys = own.select("last", "k", "h")
        each = 200 if ranges <= 512 else 20
        sample = sorted(tuple(r) for r in keys.sample(min(1.0, each * ranges / n), seed=SEED).limit(2 * each * ranges).collect())
        bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    def place(last: pd.Series, k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, x) for x in zip(last.tolist(), k.tolist(), h.tolist())], dtype="int32")

    ranged = own.withColumn("r", F.pandas_udf(place, T.IntegerType())("last", "k", "h")) if bounds else own.withColumn("r", F.lit(0))
    # The first of each range: one row a range.
    firsts = {x["r"]: tuple(x["f"]) for x in ranged.groupBy("r").agg(F.min(F.struct("last", "k", "h")).alias("f")).collect()}
    filled = sorted(firsts)
    before = {firsts[r]: filled[i - 1] for i, r in enumerate(filled)}  # also the first of all, to the last range
    heads = spark.createDataFrame([(*f, r) for f, r in before.items()] or [], "last int, k long, h long, to int")
    nexts = (
        ranged.join(F.broadcast(heads), ["last", "k", "h"]).dropDuplicates(["last", "k", "h"])
        .select("doc_id", "text", "h", "last", "k", F.col("to").alias("r"), F.lit(1).alias("extra"))
    )
    dealt = ranged.select("doc_id", "text", "h", "last", "k", "r", F.lit(0).alias("extra")).unionByName(nexts)
    out = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    )

    def block(rows: list[tuple], following: str) -> pa.RecordBatch:
        """Results of rows in order; ``following`` is the text after the last of them."""
        walker = _walker()
        codes = [codes_of(t) for _, t in rows] + [codes_of(following)]
        left = walk(walker, codes)
        prints = [render(walker, c, j) for c, j in zip(codes, left)]
        cut = [len(c) - len(c) // 3 for c in codes[:-1]]
        tails = [codes[i + 1][: len(codes[i]) // 3] for i in range(len(rows))]
        more = walk(walker, tails, [int(left[i][c - 1]) if c else 0 for i, c in enumerate(cut)])
        columns: list[list] = [[] for _ in out.fields]
        for i, (doc_id, _) in enumerate(rows):
            edited = np.concatenate([codes[i][: cut[i]], tails[i]])
            mark = render(walker, edited, np.concatenate([left[i][: cut[i]], more[i]]))
            text = edited.tobytes().decode("utf-32-le", "surrogatepass")
            values = (doc_id, len(codes[i]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), prints[i], mark, likeness(walker, prints[i], mark), likeness(walker, prints[i], prints[i + 1]))
            for column, v in zip(columns, values):
                column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range and order; the extra row of a range is its last."""
        held: list[tuple] = []
        size, now = 0, None
        for batch in batches:
            for doc_id, text, r, extra in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if r != now:
                    assert not held, "a range lacks the text after its last"
                    now = r
                if extra or size > CELLS:
                    if held:
                        yield block(held, text)
                    held, size = [], 0
                if not extra:
                    held.append((doc_id, text))
                    size += len(text)
        assert not held, "a range lacks the text after its last"

    # The extra row sorts behind all others of its range.
    sorted_rows = dealt.repartition(max(len(filled), 1), "r").sortWithinPartitions("r", "extra", "last", "k", "h").select("doc_id", "text", "r", "extra")
    return sorted_rows.mapInArrow(run, out)
