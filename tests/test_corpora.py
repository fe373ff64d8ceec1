"""Training-corpus readers on small files, against what plain Python reads."""

import random
import re
import struct

import numpy as np
import pytest
from oracle import spark_rows, sql_rows

import textloom.plans  # noqa: F401
from pyspark.sql import functions as F
from textloom.plans import catalogue
from textloom.sources import corpora

#: Of the readers' plans: wholly against SQL.
NAMES = ["fixed_chunks", "numbered_texts", "paraphrase_lines", "tagged_lines"]


@pytest.mark.parametrize("name", NAMES)
def test_larger_tables_match_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got, want = spark_rows(catalogue.QUERIES[name](spark, sf)), sql_rows(catalogue.ORACLES[name], sf)
    assert got == want and len(got[1]) > 100


def test_tagged_lines(spark, tmp_path):
    (tmp_path / "ca01").write_text("The/at-hl Jury/nn said/vbd ,/, a/b/c plain 1/2/cd two/cd\n\n./. ,/,\nIt/PPS is/bez\n")
    rows = sorted(r["tokens"] for r in corpora.read_tagged(spark, str(tmp_path)).collect())
    assert rows == [["it/PP", "is/be"], ["the/at", "jury/nn", "said/vb", "two/cd"]]


def test_lines_are_cut_and_running_text_crosses_them(spark, tmp_path):
    draw = random.Random(2)
    texts = {name: "".join(f"{name}{k}" + draw.choice([" ", "  ", "\n", " \t", "\n\n"]) for k in range(n)) for name, n in (("a", 2_345), ("b", 1_000), ("c", 1))}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "empty").write_text(" \n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # one file, many tasks
    try:
        found = {(r["path"][-1], r["chunk"]): r["tokens"] for r in corpora.read_running(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {(n, k): t.split()[1_000 * k : 1_000 * k + 1_000] for n, t in texts.items() for k in range(-(-len(t.split()) // 1_000))}
    got = sorted((r["chunk"], r["tokens"]) for r in corpora.read_lines(spark, str(tmp_path), 2).collect())
    assert got == sorted((k // 2, line.split()[k : k + 2]) for t in texts.values() for line in t.split("\n") for k in range(0, len(line.split()), 2))


def test_numbered_lines_and_paraphrases(spark):
    lines = spark.createDataFrame([(0, "the cat's mat."), (1, None), (2, "the the the the the the"), (128, "über_maß 3.5%"), (129, "")], "line long, value string")
    ids = spark.createDataFrame([("the", 2), ("cat", 3), ("'", 4), ("über_maß", 5), (".", 9)], "term string, id long")
    got = {r["line"]: (r["batch"], r["ids"]) for r in corpora.numbered_lines(lines, ids, most=9, longest=5).collect()}
    assert got == {1: (0, []), 128: (1, [5, 1, 1, 1, 1]), 129: (1, [])}  # the others have six words
    assert corpora.numbered_lines(lines, ids, most=9).filter("line = 0").first()["ids"] == [2, 3, 4, 1, 1, 1]
    pairs = spark.createDataFrame([(0, "1\t7\t8\tA b-c\tD"), (1, "1\t7\t8\tA b"), (2, None), (3, "1\t7\t8\ta b c\td e f"), (4, "1\t7\t8\t\t")], "line long, value string")
    assert sorted(tuple(r) for r in corpora.paraphrases(pairs, 2).collect()) == [(0, ["a", "b", "-", "c"], ["d"]), (4, [], [])]
    assert corpora.paraphrases(pairs).count() == 3


def test_files_of_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    terms, matrix = [f"w{k}" for k in range(2_500)] + ["süß"], rng.normal(size=(2_501, 7)).astype("<f4")
    matrix[3] = np.frombuffer(b"\n  \n" * 7, "<f4")  # blanks and new lines within numbers
    body = b"".join(w.encode() + b" " + v.tobytes() + b"\n" * (k % 2) for k, (w, v) in enumerate(zip(terms, matrix)))
    (tmp_path / "v.bin").write_bytes(b"2501 7\n" + body)
    rows = corpora.read_binary_vectors(spark, str(tmp_path / "v.bin")).orderBy("place").collect()
    assert [r["term"] for r in rows] == terms and np.array_equal(np.array([r["v"] for r in rows], np.float32), matrix)
    (tmp_path / "cut.bin").write_bytes(b"2501 7\n" + body[:-9])
    with pytest.raises(Exception, match="the file ends within vector"):
        corpora.read_binary_vectors(spark, str(tmp_path / "cut.bin")).count()
    for name, version in (("old.npy", (1, 0)), ("new.npy", (2, 0))):
        with open(tmp_path / name, "wb") as f:
            np.lib.format.write_array(f, matrix.astype(np.float64), version)
        rows = corpora.read_matrix(spark, str(tmp_path / name)).orderBy("place").collect()
        assert np.array_equal(np.array([r["v"] for r in rows], np.float32), matrix)
    np.save(tmp_path / "flat.npy", np.zeros(3))
    with pytest.raises(Exception, match="two dimensions"):
        corpora.read_matrix(spark, str(tmp_path / "flat.npy")).count()
    (tmp_path / "dictionary.txt").write_text("\n".join([*terms[:-1], "w0"]) + "\n")
    table = {r["term"]: r["v"] for r in corpora.read_word_table(spark, str(tmp_path / "old.npy"), str(tmp_path / "dictionary.txt")).collect()}
    assert len(table) == 2_500 and np.allclose(table["w0"], matrix[-1]) and np.allclose(table["w5"], matrix[5])


def test_written_vectors_come_back(spark, tmp_path):
    rows = [("b", [0.5, -1.25], 3), ("a", [1.0, 2.0], 9), ("c", [3.0, 0.0], 3)]
    corpora.write_word_vectors(spark.createDataFrame(rows, "term string, v array<float>, n long"), str(tmp_path / "v"), str(tmp_path / "n"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "v")).orderBy(F.monotonically_increasing_id()).collect()][0] == "3 2"
    lines = [line for p in sorted((tmp_path / "v").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["3 2", "a 1.000000 2.000000", "b 0.500000 -1.250000", "c 3.000000 0.000000"]
    assert sorted(tuple(r) for r in corpora.read_counted_vectors(spark, str(tmp_path / "v"), str(tmp_path / "n")).collect()) == sorted(rows)


def test_word_punct_is_a_partition_of_signs(spark):
    texts = ["don't stop!", "  a_b--c\x0bd ", "", None, "中文,x²"]
    found = [r["t"] for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, x string").orderBy("k").select(corpora.word_punct(F.col("x")).alias("t")).collect()]
    assert found[0] == ["don", "'", "t", "stop", "!"] and found[1] == ["a_b", "--", "c", "d"] and found[2:4] == [[], []]
    assert ["".join(t) for t in found] == [re.sub(r"[\x09-\x0D ]", "", x or "") for x in texts]
