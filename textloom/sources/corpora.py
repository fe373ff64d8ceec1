"""Readers of training corpora: tagged lines, running text, numbered lines, paraphrase pairs; and files of vectors.

Null lines count as empty.  Lines and running text are read by Spark's splittable text reader; files of vectors are read whole, one a task, so each must
be below 2 GB (larger tables come as several files).
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import relational, tokens
from textloom.operators.shared import Tables

#: Words of a line or of running text in one sentence (fixed values).
LINE_WORDS, RUNNING_WORDS = 10_000, 1_000
#: White space, and runs of word characters or of other signs.
SPACE, WORD_PUNCT = r"[\x09-\x0D\x20]+", r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0D\x20]+)"
#: Words that every task may have at hand.
NEAR_WORDS = 100_000
#: Rows of a file of vectors that leave a task at once.
ROWS = 1_024


def words(line: Column) -> Column:
    return F.filter(F.split(F.coalesce(line, F.lit("")), SPACE), lambda w: w != "")


def word_punct(line: Column) -> Column:
    """Runs of letters, digits and underscores, and runs of other signs."""
    return F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(WORD_PUNCT), F.lit(1))


def tagged_words(line: Column) -> Column:
    """``word/tag`` of a tagged line: words in lower case, tags cut to two letters; what has no such tag, or several slashes, is left out."""
    parts = F.transform(words(line), lambda w: F.split(w, "/"))
    kept = F.filter(parts, lambda p: (F.size(p) == 2) & F.substring(p[1], 1, 2).rlike(r"^\p{L}+$"))
    return F.transform(kept, lambda p: F.concat(F.lower(p[0]), F.lit("/"), F.substring(p[1], 1, 2)))


def chunked(rows: DataFrame, column: str, size: int) -> DataFrame:
    """The rows once for each ``size`` words of ``column``, which holds those words, and ``chunk`` from 0; rows without words give none."""
    n = F.size(column)
    parts = F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), lambda k: F.slice(column, k * size + 1, F.lit(size)))
    return rows.filter(n > 0).select(*[c for c in rows.columns if c != column], F.posexplode(parts).alias("chunk", column))


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """``tokens`` of a corpus of tagged lines, lines without words left out."""
    return spark.read.text(path).select(tagged_words(F.col("value")).alias("tokens")).filter(F.size("tokens") > 0)


def read_lines(spark: SparkSession, path: str, longest: int = LINE_WORDS) -> DataFrame:
    """``chunk, tokens``: a sentence a line, cut where it has more than ``longest`` words."""
    return chunked(spark.read.text(path).select(words(F.col("value")).alias("tokens")), "tokens", longest)


def read_running(spark: SparkSession, path: str, size: int = RUNNING_WORDS) -> DataFrame:
    """``path, chunk, tokens``: running text without sentence marks, cut every ``size`` words.

    Blanks part the rows that Spark reads, so one endless line is read by many tasks; places in the file give words their running number.
    """
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    rows = spark.read.option("lineSep", " ").text(path).select(*at, F.posexplode(words(F.col("value"))).alias("place", "word"))
    rows = relational.numbered(Tables(spark, "running").put(rows, "words"), ["path", "block", "row", "place"], 0)
    firsts = rows.groupBy("path").agg(F.min("id").alias("first"))
    place = F.col("id") - F.col("first")
    cells = rows.join(firsts, "path").select("path", F.floor(place / size).alias("chunk"), place.alias("place"), "word")
    found = cells.groupBy("path", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("c"))
    return found.select("path", "chunk", F.col("c.word").alias("tokens"))


def numbered_lines(lines: DataFrame, ids: DataFrame, most: int = 0, longest: int = 0, batch: int = 128) -> DataFrame:
    """``line, batch, ids`` of lines (``line`` from 0, ``value``): the words' numbers (``term, id``), 1 for unknown ones and, with ``most``, for those from it on.

    With ``longest`` lines of more words are left out; a batch is so many lines, with those left out.
    """
    known = ids.withColumn("id", F.when(F.col("id") < most, F.col("id")).otherwise(1)) if most else ids
    split = lines.select("line", word_punct(F.col("value")).alias("tokens"))
    if longest:
        split = split.filter(F.size("tokens") <= longest)
    if 0 < most <= NEAR_WORDS:
        return _looked_up(split, ids.filter((F.col("id") < most) & F.col("term").isNotNull())).select("line", F.floor(F.col("line") / batch).alias("batch"), "ids")
    return tokens.encoded(split, known, ["line"]).select("line", F.floor(F.col("line") / batch).alias("batch"), "ids")


def _looked_up(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``line, ids`` of ``line, tokens``: each task has the few known words (``term, id``), so that lines stay where they are."""
    found = known.select("term", F.col("id").cast("long").alias("id")).collect()  # no more than NEAR_WORDS
    shared = rows.sparkSession.sparkContext.broadcast(([r["term"] for r in found], [r["id"] for r in found]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, numbers = shared.value
        terms, numbers = pa.array(terms, pa.string()), pa.array(numbers, pa.int64())
        for batch in batches:
            tokens = batch.column(1)
            ids = pc.fill_null(numbers.take(pc.index_in(tokens.flatten().cast(pa.string()), terms)), 1)
            ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(tokens), 0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["line", "ids"])

    return rows.select("line", "tokens").mapInArrow(run, f"line {rows.schema['line'].dataType.simpleString()}, ids array<long>")


def paraphrases(lines: DataFrame, longest: int = 0) -> DataFrame:
    """``line, a, b``: the words of the fourth and fifth field of tab-separated lines, in lower case.

    Lines with fewer or more fields are left out, and with ``longest`` those whose two sentences both have more words.
    """
    rows = lines.select("line", F.split(F.lower("value"), "\t").alias("f")).filter(F.size("f") == 5)
    rows = rows.select("line", word_punct(F.col("f")[3]).alias("a"), word_punct(F.col("f")[4]).alias("b"))
    return rows.filter((F.size("a") <= longest) | (F.size("b") <= longest)) if longest else rows


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=names)


def read_binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``path, place, term, v`` of files with a line ``n d``, then ``word``, a blank and d little-endian floats a word (a new line before a word is skipped)."""

    def parse(content: bytes) -> Iterator[tuple]:
        at = content.index(b"\n") + 1
        n, dims = map(int, content[:at].split())
        for place in range(n):
            end = content.index(b" ", at)
            term = content[at:end].lstrip(b"\n").decode("utf-8", "replace")
            at = end + 1 + 4 * dims
            if at > len(content):
                raise ValueError(f"the file ends within vector {place} of {n}")
            yield place, term, np.frombuffer(content, "<f4", dims, end + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                where = batch.column(0)[k].as_py()
                yield from _batches(((where, *row) for row in parse(batch.column(1)[k].as_py())), ["path", "place", "term", "v"], [pa.string(), pa.int64(), pa.string(), pa.list_(pa.float32())])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, place long, term string, v array<float>")


def npy_header(content: bytes) -> tuple[dict, int]:
    """The description of a stored array, and where its numbers begin."""
    if content[:6] != b"\x93NUMPY":
        raise ValueError("not a stored array")
    long = content[6] > 1
    (length,) = struct.unpack_from("<I" if long else "<H", content, 8)
    begin = 12 if long else 10
    return ast.literal_eval(content[begin : begin + length].decode("latin1")), begin + length


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``path, place, v``: the rows of stored arrays of two dimensions, row by row in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                where, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                what, begin = npy_header(content)
                if what["fortran_order"] or len(what["shape"]) != 2:
                    raise ValueError(f"{where}: only rows of two dimensions are read")
                rows = np.frombuffer(content, np.dtype(what["descr"]), what["shape"][0] * what["shape"][1], begin).reshape(what["shape"])
                yield from _batches(((where, i, row.astype(np.float32)) for i, row in enumerate(rows)), ["path", "place", "v"], [pa.string(), pa.int64(), pa.list_(pa.float32())])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, place long, v array<float>")


def read_word_table(spark: SparkSession, matrix: str, dictionary: str) -> DataFrame:
    """``term, v``: line i of a dictionary has row i of a stored array; of a repeated word the last row counts."""
    terms = spark.read.text(dictionary, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("place", "term")).select("place", F.trim("term").alias("term"))
    rows = read_matrix(spark, matrix).join(terms, "place")
    return rows.groupBy("term").agg(F.max_by("v", "place").alias("v"))


def write_word_vectors(vectors: DataFrame, path: str, counts_path: str | None = None) -> None:
    """``term, v, n`` as lines ``term x1 ... xd`` below a line ``rows d``, frequent words first; and ``term n`` lines likewise."""
    d = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    cells = F.array_join(F.transform("v", lambda x: F.format_string("%f", x.cast("double"))), " ")
    head = vectors.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.lit("").alias("term"), F.lit(f"{d['n']} {d['d'] or 0}").alias("value"))
    lines = vectors.select(F.lit(1).alias("part"), F.col("n").cast("long").alias("n"), "term", F.concat_ws(" ", "term", cells).alias("value"))
    head.unionByName(lines).orderBy("part", F.desc("n"), "term").select("value").write.mode("overwrite").text(path)
    if counts_path:
        vectors.orderBy(F.desc("n"), "term").select(F.concat_ws(" ", "term", F.col("n").cast("string")).alias("value")).write.mode("overwrite").text(counts_path)


def read_counted_vectors(spark: SparkSession, path: str, counts_path: str) -> DataFrame:
    """``term, v, n`` of what ``write_word_vectors`` writes; ``n`` is null where the counts have no such word."""
    f = F.split("value", " ")
    rows = spark.read.text(path).select(f.alias("f")).filter(F.size("f") > 2)
    rows = rows.select(F.col("f")[0].alias("term"), F.transform(F.slice("f", F.lit(2), F.size("f") - 1), lambda x: x.cast("float")).alias("v"))
    counts = spark.read.text(counts_path).select(F.split("value", " ")[0].alias("term"), F.split("value", " ")[1].cast("long").alias("n"))
    return rows.join(counts, "term", "left")
