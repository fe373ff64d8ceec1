"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import BROADCAST_ROWS, Scratch, maybe_broadcast, release_memory, short_batches, text_or_empty, worker_state

#: Segments whose counts a worker remembers.
MEMO_ENTRIES = 1 << 19

#: Rows of one text from which its count is sent to them, not they to it.
HEAVY = 500

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file; counts of another version are never reused."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class SentencePieceCounter:
    """Counts what the library's ``encode`` would return.

    The normaliser of the models meant here only turns spaces into a mark, and no
    piece has that mark after another character, so no merge crosses the start of
    a mark: between lone spaces the library can be asked segment by segment, and
    answers are remembered.  Texts or models outside this rule go to the library whole.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        mark = "▁"
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        probe = "A ́  ﬁ "  # normalisers other than the identity change this
        self.cut = not any(mark in p.lstrip(mark) for p in pieces) and self.sp.normalize(probe) == mark + probe.replace(" ", mark)
        self.memo: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        memo, split, missing = self.memo, [], {}
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for text in texts:
            words = text.split(" ") if self.cut and text else []
            if not words or "" in words or "▁" in text or "\0" in text:
                split.append(None)
                continue
            split.append(words)
            for w in words:
                if w not in memo:
                    missing[w] = None
        if missing:
            for w, ids in zip(missing, self.sp.encode(list(missing), num_threads=1)):
                memo[w] = len(ids)
        get = memo.__getitem__
        return [len(self.sp.encode(t, num_threads=1)) if words is None else sum(map(get, words)) for t, words in zip(texts, split)]


def _counter(key: str, model) -> SentencePieceCounter:
    state = worker_state("sentencepiece")
    if key not in state:
        state.clear()
        state[key] = SentencePieceCounter(model())
    return state[key]


def with_digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``digest``: SHA-256 of the normalised content.

    Normalising may not change a count, so it only turns null into the empty text.
    """
    return docs.withColumn("digest", F.unhex(F.sha2(text_or_empty(text_col), 256)))


def count_tokens(
    docs: DataFrame, model: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """Returns ``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``cache`` is a folder with the table ``digest, version, n_tokens``; the texts
    whose (digest, version) it lacks are encoded once per distinct text and
    appended.  Without ``cache`` an empty one is begun in the shared folder.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows give repeated results; an empty table gives none; other
    columns are not read.  Copies of a text are dropped within each partition
    before the shuffle, so a text that a third of all rows hold reaches its task
    once per partition.
    """
    spark = docs.sparkSession
    version = tokenizer_version(model)
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the model file: under 1 MB
    if cache is None:
        cache = Scratch(spark, "token-cache").root
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache)

    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    texts = with_digest(own.select("text"))

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops repeats of a digest within the partition (as far as a bounded memory of them goes)."""
        seen: set[bytes] = set()
        for batch in batches:
            at = []
            for i, d in enumerate(batch.column(1).to_pylist()):
                if d not in seen:
                    at.append(i)
                    seen.add(d)
            if len(seen) > 1 << 20:
                seen.clear()
            yield batch.take(pa.array(at, pa.int64()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(version, lambda: shared.value)
        last = None
        for batch in batches:  # sorted by digest, so equal ones are neighbours
            digests, at = batch.column(1).to_pylist(), []
            for i, d in enumerate(digests):
                if d != last:
                    last = d
                    at.append(i)
            counts = counter(batch.column(0).take(pa.array(at, pa.int64())).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in at], pa.binary()), pa.array([version] * len(at), pa.string()), pa.array(counts, pa.int64())],
                names=["digest", "version", "n_tokens"],
            )

    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version)
    distinct = texts.mapInArrow(fresh, texts.schema)
    if not known.isEmpty():
        distinct = distinct.join(known.select("digest"), "digest", "left_anti").select("text", "digest")
    with short_batches(spark):
        distinct.repartition("digest").sortWithinPartitions("digest").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)

    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version)
    counts = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # one row each, should two runs have appended the same
    rows = with_digest(own).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    # Digests that many rows hold, at most one for each HEAVY rows, are broadcast; the others meet their rows by a shuffle.
    found = Scratch(spark, "token-heavy")
    heavy = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= HEAVY).select("digest")
    heavy = found.put(counts.join(heavy, "digest"), "heavy")
    columns = ["doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")]
    if heavy.isEmpty():
        return rows.join(counts, "digest").select(*columns)
    near = maybe_broadcast(heavy, BROADCAST_ROWS)
    light = rows.join(near.select("digest"), "digest", "left_anti").join(counts, "digest")
    return light.select(*columns).unionByName(rows.join(near, "digest").select(*columns))
