"""Findings of round 4: what learners send, keep on disk and send back."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import graphs, learners
from textloom.operators.sgd import Settings
from textloom.operators.shared import Tables

S = Settings(dims=6, window=3, negative=2, alpha=0.1, epochs=2, sample=0, batch=64, block_words=60, pool=40)


def texts(spark):
    draw = np.random.default_rng(5)
    return spark.createDataFrame([(k, [f"w{x}" for x in draw.integers(0, 12, draw.integers(0, 9))]) for k in range(60)], "id long, tokens array<string>")


def vectors(state):
    return {(x.row, x.side): list(x.v) for x in state.collect()}


def test_first_vectors_are_made_from_a_hash(spark):
    rows = spark.createDataFrame([("wa",), ("s12",), ("",), ("n0101",)], "row string")
    got = rows.select(learners.first_vector(F.col("row"), 16, 7).alias("v"), F.xxhash64(F.lit(7), "row").alias("h")).collect()
    assert (learners.first_vectors(np.array([x.h for x in got]), 16) == np.array([x.v for x in got], np.float32)).all()


def test_blocks_share_a_part_and_only_what_is_wanted_comes_back(spark, monkeypatch):
    edges = spark.createDataFrame([(f"s{a}", f"s{b}", 1.0) for k in range(58) for a, b in ((k, k + 1), (k + 1, k), (k, 99))], "a string, b string, weight double")
    s = replace(S, predict="one", pull=0.5)
    alone = vectors(learners.learn(texts(spark), s, edges=edges))
    monkeypatch.setattr(learners, "PARTS", 2)  # several blocks a part
    wanted = {w: vectors(learners.learn(texts(spark), s, edges=edges, wanted=w)) for w in ("all", "sentences", "losses")}
    assert wanted["all"].keys() == alone.keys() and all(np.allclose(v, alone[k], atol=1e-6) for k, v in wanted["all"].items())
    assert wanted["sentences"].keys() == {k for k in alone if k[1] == "i" and k[0][0] == "s"} and ("s99", "i") in alone
    assert wanted["losses"].keys() == {k for k in alone if k[1] == "loss"}
    assert all(np.allclose(v, alone[k], atol=1e-6) for w in ("sentences", "losses") for k, v in wanted[w].items())


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffled_files(spark):
    rows, before = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), shuffled(spark)
    again = Tables(spark, "test").put(rows, "rows")
    assert not shuffled(spark) - before
    assert again.count() == 7 and rows.count() == 7

def test_only_the_last_round_of_a_retrofit_stays(spark):
    values = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(3)], "id long, v array<double>")
    edges = spark.createDataFrame([(0, 1), (1, 0)], "a long, b long")
    found = graphs.retrofit(values, edges, 4)
    folder = spark._jvm.org.apache.hadoop.fs.Path(found.inputFiles()[0]).getParent().getParent()
    left = [x.getPath().getName() for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    assert sorted(left) == ["edges", "first", "round-3"]
    assert found.filter("id = 2").first().v == [2.0, 1.0]
