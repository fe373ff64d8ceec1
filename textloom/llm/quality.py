"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The symbols are the texts' characters as they are, nothing is folded, so the
tables of n-grams, contexts and probabilities grow with the trusted texts.  They
are sharded by n-gram and joined with each other.  To score, the rows of each
partition are cut into blocks.  A block is written once, compressed, in a table
bucketed by block, beside its distinct n-grams, packed by shard.  The shards'
distinct n-grams are joined with the count tables, and each block gets back one
number for each of its own; the texts are not moved for it.

An n-gram is kept as binary, three bytes a symbol, so equality is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import Scratch, bucketed, free_names, maybe_broadcast, pieces, release_memory, short_batches, text_or_empty, worker_state

ORDER = 5
#: Bytes of a symbol in an n-gram.
WIDE = 3
#: Symbols: every code point, and the text's beginning.
CLASSES = 0x110001
#: Share of the held-out trusted texts of a language whose perplexity stays below its threshold.
QUANTILE = 0.995
#: One of so many trusted texts is held out for the thresholds: texts that the model has read look better than others.
HELD_OUT = 5
#: Characters whose n-grams are in memory at a time.
STRETCH = 1 << 18
#: Distinct n-grams of stretches that wait before they are merged with those of the block.
WAITING = 1 << 19
#: Characters of text in a block of documents that is scored together.
BLOCK_CHARS = 16 << 20
#: Bytes of text for each shard of the n-grams, beyond one shard a shuffle partition.
SHARD_BYTES = 1 << 32
#: n-grams of a shard that wait before they are merged.
MERGE = 1 << 20


def class_of(code: int) -> int:
    """Symbol of a code point. 0 is kept for the text's beginning."""
    return code + 1


def class_table() -> np.ndarray:
    return np.arange(1, CLASSES, dtype=np.int64)


def stretches(texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
    """All characters of the texts in groups of (text, from, to), each group of STRETCH characters at most."""
    group, held = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), STRETCH):
            end = min(len(text), at + STRETCH)
            if held + end - at > STRETCH:
                yield group
                group, held = [], 0
            group.append((i, at, end))
            held += end - at
    if group:
        yield group


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams_of(texts: list[str], group: list[tuple[int, int, int]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of a group, as a number, and the characters of each member.

    ``table`` numbers the code points from 1; numbers too long for 64 bits are Python's.
    """
    before = ORDER - 1  # characters read ahead of each member; at a text's beginning their class is 0
    joined = "".join("\0" * before + texts[i][:end] if at == 0 else texts[i][at - before : end] for i, at, end in group)
    classes = table[codes_of(joined)]
    lengths = np.array([end - at for _, at, end in group], np.int64)
    starts = np.cumsum(lengths + before) - lengths
    begins = starts[[at == 0 for _, at, _ in group]]
    for k in range(1, ORDER):
        classes[begins - k] = 0
    base = int(table.max()) + 1
    code = np.zeros(len(classes) - before, np.int64 if base**ORDER < 1 << 63 else object)
    for k in range(ORDER):
        code *= base
        code += classes[k : len(classes) - before + k]
    return code[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)) * before, lengths)], lengths


def alphabet(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A table that numbers the texts' characters from 1, and the symbol of each number."""
    seen = np.zeros(CLASSES - 1, bool)
    for group in stretches(texts):
        for i, at, end in group:
            seen[codes_of(texts[i][at:end])] = True
    symbols = np.flatnonzero(seen)
    table = np.zeros(CLASSES - 1, np.int64)
    table[symbols] = np.arange(1, len(symbols) + 1)
    return table, np.append(0, symbols + 1)


def distinct(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' n-grams in order, and how often each occurs. Does not depend on the order of the texts."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        every, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return every, np.bincount(at.ravel(), weights=np.concatenate([p[1] for p in parts]), minlength=len(every)).astype(np.int64)

    parts, held = [], 0
    for group in stretches(texts):
        parts.append(np.unique(grams_of(texts, group, table)[0], return_counts=True))
        held += len(parts[-1][0])
        if held > WAITING:
            parts, held = [merged(parts)], 0
    return merged(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def cells_of(codes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """n-grams as rows of ORDER * WIDE bytes, the first symbol first and its highest byte first."""
    cells = np.zeros((len(codes), ORDER * WIDE), np.uint8)
    for k in range(ORDER - 1, -1, -1):
        symbol = symbols[(codes % len(symbols)).astype(np.int64)]
        codes = codes // len(symbols)
        for j in range(WIDE):
            cells[:, k * WIDE + j] = (symbol >> (8 * (WIDE - 1 - j))) & 255
    return cells


def as_binary(cells: np.ndarray) -> pa.Array:
    width = cells.shape[1]
    offsets = np.arange(len(cells) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cells).tobytes())])


def as_keys(cells: np.ndarray) -> np.ndarray:
    """Rows of bytes as fixed-width strings, which sort and compare like them."""
    return np.ascontiguousarray(cells).view(f"S{cells.shape[1]}").ravel()


def shards_of(cells: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(cells), np.uint64)
        for k in range(cells.shape[1]):
            h = (h ^ cells[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h % np.uint64(shards)).astype(np.int64)


def by_shard(cells: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its rows), shards and places ascending."""
    shard = shards_of(cells, shards)
    order = np.argsort(shard, kind="stable")
    found, at = np.unique(shard[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, at[1:]))


def squeezed(data: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(data).tobytes(), codec="zstd", asbytes=True)


def packed_cells(cells: np.ndarray) -> bytes:
    """Compressed, byte by byte of all rows, which suits sorted rows."""
    return len(cells).to_bytes(8, "little") + squeezed(cells.T)


def unpacked_cells(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], n * ORDER * WIDE, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(ORDER * WIDE, n).T)


def unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def shard_count(spark: SparkSession, text_bytes: int) -> int:
    """One shard a shuffle partition, more for more text than SHARD_BYTES each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // SHARD_BYTES))


def merged_shards(cells: DataFrame, shards: int) -> DataFrame:
    """``shard, gram, n``: the distinct n-grams of ``shard, cells, counts``, with the sum of their counts.

    A task reads the cells of its shards one after the other and holds one shard's distinct n-grams;
    null counts stand for ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("kneser-ney")
        now, waiting, held = None, [], 0

        def merge() -> None:
            nonlocal waiting, held
            keys, at = np.unique(np.concatenate([k for k, _ in waiting]), return_inverse=True)
            n = np.bincount(at.ravel(), weights=np.concatenate([c for _, c in waiting]), minlength=len(keys)).astype(np.int64)
            waiting, held = [(keys, n)], 0

        def result() -> pa.RecordBatch:
            merge()
            keys, n = waiting[0]
            cells = np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), -1)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), now, np.int32)), as_binary(cells), pa.array(n)], names=["shard", "gram", "n"])

        for batch in pieces(batches, 64):
            for shard, data, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if shard != now:
                    if waiting:
                        yield result()
                    now, waiting, held = shard, [], 0
                keys = as_keys(unpacked_cells(data))
                waiting.append((keys, np.ones(len(keys), np.int64) if counts is None else unpacked(counts, len(keys), "<i8")))
                held += len(keys)
                if held > MERGE + len(waiting[0][0]):
                    merge()
        if waiting:
            yield result()
        release_memory()

    return cells.select("shard", "cells", "counts").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, gram binary, n long")


def cut_blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[list[pa.RecordBatch], list[str]]]:
    """The rows in blocks of BLOCK_CHARS characters or so, with their texts (null: empty)."""
    rows, texts, held = [], [], 0
    for batch in pieces(batches, 64):
        own = [t or "" for t in batch.column(text_at).to_pylist()]
        rows.append(batch)
        texts += own
        held += sum(map(len, own))
        if held >= BLOCK_CHARS:
            yield rows, texts
            rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def count_grams(texts: DataFrame, shards: int | None = None) -> DataFrame:
    """``gram, n``: counts over all texts (column ``text``). Each block of texts sends its distinct n-grams once, packed by shard."""
    shards = shards or shard_count(texts.sparkSession, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("kneser-ney")  # frees what an operator before has kept
        for _, block in cut_blocks(batches, 0):
            table, symbols = alphabet(block)
            codes, n = distinct(block, table)
            cells = cells_of(codes, symbols)
            found = [(s, packed_cells(cells[at]), squeezed(n[at].astype("<i8"))) for s, at in by_shard(cells, shards)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), *(pa.array([f[k] for f in found], pa.binary()) for k in (1, 2))], names=["shard", "cells", "counts"])
        release_memory()

    return merged_shards(texts.select("text").mapInArrow(run, "shard int, cells binary, counts binary"), shards).select("gram", "n")


def _discounted(table: DataFrame) -> tuple[DataFrame, list[float]]:
    """Adds ``d``, the modified Kneser-Ney discount of each count; also returns the discounts of 1, 2 and 3+."""
    n = [0.0] + list(table.agg(*[F.sum((F.col("n") == k).cast("double")) for k in range(1, 5)]).first())
    n = [x or 0.0 for x in n]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    d = [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] else 0.5 for k in (1, 2, 3)]
    return table.withColumn("d", F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])), d


class Model:
    """``probabilities[k]`` (``key, p``) and ``weights[k]`` (``context, gamma``) of the order k, as sharded tables."""

    def __init__(self, counts: DataFrame, scratch: Scratch):
        tables = {ORDER: counts}
        for k in range(ORDER - 1, 0, -1):  # lower orders count in how many contexts a suffix was seen
            shorter = tables[k + 1].groupBy(F.expr(f"substring(gram, {WIDE + 1})").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
            tables[k] = scratch.put(shorter, f"counts{k}")
        #: What a symbol has that no trusted text holds.
        self.least = 1.0 / (tables[1].count() + 1)
        self.probabilities, self.weights = {}, {}
        for k in range(1, ORDER + 1):
            table, _ = _discounted(tables[k])
            table = table.withColumn("context", F.expr(f"substring(gram, 1, {WIDE * (k - 1)})"))
            context = table.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma"))
            context = self.weights[k] = scratch.put(context, f"contexts{k}")
            joined, below = table.join(context, "context"), F.lit(self.least)
            if k > 1:
                lower = self.probabilities[k - 1].select(F.col("key").alias("suffix"), F.col("p").alias("below"))
                joined, below = joined.withColumn("suffix", F.expr(f"substring(gram, {WIDE + 1})")).join(lower, "suffix"), F.col("below")
            p = (F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * below
            self.probabilities[k] = scratch.put(joined.select(F.col("gram").alias("key"), p.alias("p")), f"p{k}")

    def logs(self, wanted: DataFrame, scratch: Scratch) -> DataFrame:
        """``shard, gram, log`` of distinct n-grams (``shard, gram``); those an order lacks go on to the next lower one."""
        left, found = wanted.select("shard", "gram", F.col("gram").alias("key"), F.lit(0.0).alias("w")), []
        for k in range(ORDER, 0, -1):
            joined = scratch.put(left.join(self.probabilities[k], "key", "left"), f"order{k}")
            found.append(joined.filter("p is not null").select("shard", "gram", (F.col("w") + F.log("p")).alias("log")))
            missed = joined.filter("p is null").withColumn("context", F.expr(f"substring(key, 1, {WIDE * (k - 1)})"))
            weights = self.weights[k] if k > 1 else F.broadcast(self.weights[k])  # one row: the empty context
            left = missed.join(weights.select("context", "gamma"), "context", "left")
            left = left.select("shard", "gram", F.expr(f"substring(key, {WIDE + 1})").alias("key"), (F.col("w") + F.log(F.coalesce("gamma", F.lit(1.0)))).alias("w"))
        found.append(left.select("shard", "gram", (F.col("w") + F.log(F.lit(self.least))).alias("log")))
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        return every


def with_perplexity(docs: DataFrame, model: Model, name: str = "perplexity", text_col: str = "text") -> DataFrame:
    """docs with a column ``name``: each text's perplexity, null for a text without characters."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "blocks")
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)).cast("long"))).first()[0] or 0
    shards, text_at = shard_count(spark, size), docs.columns.index(text_col)
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_CHARS)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("kneser-ney")
        first, names = TaskContext.get().partitionId() << 32, ["block", "chunk", "shard", "cells"]
        for k, (rows, texts) in enumerate(cut_blocks(batches, text_at)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(pa.Table.from_batches(rows).combine_chunks())
            rows.clear()  # the texts alone are needed from here on
            chunk = sink.getvalue()
            chunk = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, chunk.size], np.int32)), chunk])
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), chunk, pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names=names)
            del sink, chunk
            table, symbols = alphabet(texts)
            cells = cells_of(distinct(texts, table)[0], symbols)
            texts.clear()
            parts = [(s, packed_cells(cells[at])) for s, at in by_shard(cells, shards)]
            yield pa.RecordBatch.from_arrays([pa.array([first + k] * len(parts), pa.int64()), pa.nulls(len(parts), pa.binary()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=names)
        release_memory()

    with short_batches(spark):
        blocks = bucketed(docs.mapInArrow(gather, "block long, chunk binary, shard int, cells binary"), scratch, "blocks", buckets)
    wanted = blocks.filter("cells is not null")
    grams = merged_shards(wanted.select("shard", "cells", F.lit(None).cast("binary").alias("counts")), shards)
    logs = model.logs(scratch.put(grams.select("shard", "gram"), "grams"), scratch)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's logarithms come first, in the order of its n-grams; then the blocks that ask for them."""
        worker_state("kneser-ney")
        now, keys, values, every, known = None, [], [], None, None
        for batch in pieces(batches, 4096):
            shard, block = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for s in dict.fromkeys(shard.tolist()):
                if s != now:
                    now, keys, values, every = s, [], [], None
                own = shard == s
                given = own & np.isnan(block.astype(float))
                if given.any():
                    mask = pa.array(given)
                    data = b"".join(batch.column(2).filter(mask).to_pylist())
                    keys.append(np.frombuffer(data, np.uint8).reshape(-1, ORDER * WIDE))
                    values.append(batch.column(3).filter(mask).to_numpy())
                found = []
                for i in np.flatnonzero(own & ~given):
                    if every is None:
                        every, known = as_keys(np.concatenate(keys)), np.concatenate(values)
                    asked = as_keys(unpacked_cells(batch.column(2)[int(i)].as_py()))
                    at = np.searchsorted(every, asked)
                    assert (every[np.minimum(at, len(every) - 1)] == asked).all(), "a shard lacks n-grams"
                    found.append((int(block[i]), s, squeezed(known[at].astype("<f4"))))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], names=["block", "shard", "logs"])
        release_memory()

    none = F.lit(None)
    asked = logs.select("shard", none.cast("long").alias("block"), F.col("gram").alias("data"), F.col("log").cast("float").alias("log"))
    asked = asked.unionByName(wanted.select("shard", "block", F.col("cells").alias("data"), none.cast("float").alias("log")))
    dealt = asked.repartition(shards, "shard").sortWithinPartitions("shard", F.col("block").isNotNull(), "data")
    answers = scratch.put(dealt.mapInArrow(answer, "block long, shard int, logs binary"), "answers")
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        worker_state("kneser-ney")
        own = pa.ipc.open_stream(rows.column("chunk")[0].as_buffer()).read_all()
        texts = [t or "" for t in own.column(text_at).to_pylist()]
        sums, n = np.zeros(len(texts)), np.array([len(t) for t in texts], np.int64)
        if n.any():
            table, symbols = alphabet(texts)
            codes, _ = distinct(texts, table)
            places, logs = dict(by_shard(cells_of(codes, symbols), shards)), np.full(len(codes), np.nan)
            for shard, data in zip(answers.column("shard").to_pylist(), answers.column("logs").to_pylist()):
                logs[places[shard]] = unpacked(data, len(places[shard]), "<f4")
            assert not np.isnan(logs).any(), "a block lacks n-grams"
            for group in stretches(texts):
                found, lengths = grams_of(texts, group, table)
                part = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=logs[np.searchsorted(codes, found)], minlength=len(lengths))
                np.add.at(sums, [i for i, _, _ in group], part)
        p = pa.array(np.exp(-sums / np.maximum(n, 1)), mask=n == 0)
        done = pa.Table.from_arrays([*own.columns, pa.chunked_array([p])], names=out.names)
        release_memory()
        return done

    chunks = blocks.filter("chunk is not null").select("block", "chunk")
    return chunks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out)


def fit(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """Trains on the rows of docs whose id is in ``trusted`` and finds each language's threshold.

    One in HELD_OUT of their texts is not counted but gives the thresholds.
    Returns (model, table ``lang, threshold``, threshold of all).  Languages without
    a held-out text take the threshold of all; without any, nothing is rejected.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    ids = scratch.put(trusted.select(F.col(id_col).alias("id")).dropna().distinct(), "trusted")
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0  # copies of a text stay together
    training = own.join(maybe_broadcast(ids), "id", "left_semi").withColumn("held", held)
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)).cast("long"))).first()[0] or 0
    with short_batches(spark):
        counts = scratch.put(count_grams(training.filter(~F.col("held")).select("text"), shard_count(spark, size)), "counts")
    model = Model(counts, scratch)
    scored = with_perplexity(training.filter("held").select("lang", "text"), model, "p").select("lang", "p")
    scored = scratch.put(scored.filter(F.col("p").isNotNull()), "held-out")
    by_lang = scratch.put(scored.groupBy("lang").agg(F.percentile_approx("p", quantile, 10000).alias("threshold")), "thresholds")
    overall = scored.agg(F.percentile_approx("p", quantile, 10000)).first()[0]
    return model, by_lang, overall


def _judged(docs: DataFrame, model: Model, by_lang: DataFrame, overall: float | None, text_col: str, lang_col: str) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: perplexity, and the threshold of its language."""
    p, t, lang = free_names(docs, "perplexity", "threshold", "of")
    cuts = by_lang.select(F.col("lang").alias(lang), F.col("threshold").alias(t))
    joined = with_perplexity(docs, model, p, text_col).join(maybe_broadcast(cuts, 10_000), F.col(f"`{lang_col}`").eqNullSafe(F.col(lang)), "left")
    return joined.withColumn(t, F.coalesce(t, F.lit(overall).cast("double"))).drop(lang), p, t


def score_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, threshold, keep`` of every row.

    Trusted are texts labelled with quality 1.  A text without characters (or a
    null one) has a null perplexity and is not kept; a null language is a language
    of its own; repeated rows score alike; an empty table gives none; other
    columns are not read.
    """
    model, by_lang, overall = fit(docs, labels.filter("quality = 1"), quantile)
    judged, p, t = _judged(docs.select("doc_id", "lang", "text"), model, by_lang, overall, "text", "lang")
    return judged.select("doc_id", "lang", F.length(text_or_empty("text")).cast("long").alias("n_chars"), p, t, _kept(p, t).cast("int").alias("keep"))


def _kept(p: str, t: str) -> Column:
    return F.col(p).isNotNull() & (F.col(t).isNull() | (F.col(p) <= F.col(t)))


def reject_poor(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs, all columns, that are kept. Columns may have any names."""
    model, by_lang, overall = fit(docs, labels.filter("quality = 1"), quantile)
    judged, p, t = _judged(docs, model, by_lang, overall, "text", "lang")
    return judged.filter(_kept(p, t)).drop(p, t)
