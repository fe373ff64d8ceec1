"""BPE encoding and decoding of whole texts by the automaton of ``automaton.py``."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.automaton import MEMO_ENTRIES, PATTERN, Automaton, load_merges
from textloom.llm.common import free_names, pieces, release_memory, text_or_empty, worker_state


class Codec:
    """Encodes and decodes texts as the tokenizer file's own library does.

    Strings of added tokens inside a text become those tokens; every other
    stretch is pre-split and each word is encoded by the automaton.  Chunks
    between single spaces recur, so their encoded form is kept in a bounded memo.
    """

    def __init__(self, data: str):
        spec = load_merges(data)
        self.automaton = Automaton(spec["labels"], spec["merges"])
        self.added = spec["added"]
        by_id = spec["labels"] | {i: s.encode() for s, i in self.added.items()}
        self.out = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.memo: dict[str, bytes] = {}

    def _words(self, text: str) -> bytes:
        encode = self.automaton.encode
        return b"".join(array("I", encode(w.encode())).tobytes() for w in self.split.findall(text))

    def _plain(self, text: str) -> bytes:
        """Ids of text without added tokens, as little-endian 32-bit integers."""
        chunks = text.split(" ")
        if len(chunks) > 1:
            chunks[1:] = [" " + c for c in chunks[1:]]
        memo, found = self.memo, []
        get, add = memo.get, found.append
        for chunk in chunks:
            ids = get(chunk)
            if ids is None:
                # A run of white space may be cut apart only where a lone space begins a chunk.
                if not chunk.strip() or chunk[-1].isspace() or chunk[:2].isspace():
                    return self._words(text)
                if chunk[0] == " " and chunk[1:].isalpha():  # one pre-split word
                    ids = array("I", self.automaton.encode(chunk.encode())).tobytes()
                else:
                    ids = self._words(chunk)
                if len(chunk) < 64:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[chunk] = ids
            add(ids)
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts, at = [], 0
        for m in self.special.finditer(text):
            if m.start() > at:
                parts.append(self._plain(text[at : m.start()]))
            parts.append(array("I", [self.added[m[0]]]).tobytes())
            at = m.end()
        if at < len(text):
            parts.append(self._plain(text[at:]))
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """The emitted arc labels, as valid UTF-8."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.out.__getitem__, numbers)).decode("utf-8", errors="replace").encode()


def _codec(key: str, data: Callable[[], str]) -> Codec:
    state = worker_state("bpe")
    if key not in state:
        state.clear()
        state[key] = Codec(data())
    return state[key]




def encode_documents(
    docs: DataFrame, tokenizer: str, text_col: str = "text", keep: list[str] | None = None, ids: bool = True, digests: bool = False
) -> DataFrame:
    """Tokens of every whole text.

    Returns the columns named in ``keep`` (doc_id if not given) and ``n_tokens``;
    with ``ids`` also ``token_ids`` (array<int>); with ``digests`` also
    ``ids_sha256`` and ``decoded_sha256``, taken of the little-endian ids and of
    the text that decoding those ids emits.

    A null text counts as empty: no tokens.  Repeated rows give repeated
    results, an empty table an empty one; other columns are not read, so
    their names cannot clash.  A map over partitions: nothing is shuffled, and a
    lost task is simply run again.
    """
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        data = f.read()
    key = hashlib.sha256(data.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(data)  # a vocabulary file: some MB, whatever the corpus
    fields = [T.StructField("n_tokens", T.LongType())]
    if ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    out = T.StructType([docs.schema[c] for c in keep] + fields)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text_col).alias(free_names(docs, "text")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, lambda: shared.value)
        sha = hashlib.sha256
        for batch in pieces(batches):
            texts = batch.column(len(keep)).to_pylist()
            n, packed, d1, d2 = [], [], [], []
            for text in texts:
                got = codec.encode(text)
                n.append(len(got) // 4)
                if ids:
                    packed.append(got)
                if digests:
                    d1.append(sha(got).hexdigest())
                    d2.append(sha(codec.decode(got)).hexdigest())
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(n, pa.int64())]
            if ids:
                offsets = [0]
                for k in n:
                    offsets.append(offsets[-1] + k)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
            if digests:
                columns += [pa.array(d1, pa.string()), pa.array(d2, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])
        release_memory()

    return source.mapInArrow(run, out)


def decode_documents(encoded: DataFrame, tokenizer: str, ids_col: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Texts of token ids, as ``text``; null ids give an empty text.

    Ids that the vocabulary lacks, and nulls among ids, emit nothing, as in the tokenizer's library.
    """
    keep = ["doc_id"] if keep is None else keep
    with open(tokenizer, encoding="utf-8") as f:
        data = f.read()
    key = hashlib.sha256(data.encode()).hexdigest()
    shared = encoded.sparkSession.sparkContext.broadcast(data)
    out = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, lambda: shared.value)
        most = len(codec.out)
        for batch in pieces(batches):
            known = [array("I", [i for i in ids or [] if i is not None and 0 <= i < most]) for ids in batch.column(len(keep)).to_pylist()]
            texts = [codec.decode(ids.tobytes()).decode() for ids in known]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string())], names=[f.name for f in out.fields])

    return encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(ids_col).alias(free_names(encoded, "ids")[0])).mapInArrow(run, out)
