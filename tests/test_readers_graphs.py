"""Operators that SQL cannot express, against brute force; readers on files; sinks on folders."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import stem
from textloom.operators import graphs, models, relational, rouge, spaces, tokens, tuning
from textloom.sources import readers, sinks


def test_stems_of_published_examples():
    want = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
        "digitizer": "digit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt",
        "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
    }
    assert {w: stem.stem(w) for w in want} == want


def test_exceptions_come_before_stems(spark):
    table = stem.exception_table(["geese goose", "mice mouse mouses", ""])
    got = spark.createDataFrame([(["geese", "running", "is"],), (None,)], "t array<string>").select(stem.stemmed(F.col("t"), table, 3)).collect()
    assert got[0][0] == ["goose", "run", "is"] and got[1][0] is None


def test_huffman_codes_are_prefix_free_and_shortest(spark):
    r = random.Random(1)
    counts = [r.randrange(1, 100) for _ in range(40)]
    got = {x.term: x.code for x in tokens.huffman_codes(spark.createDataFrame([(f"w{i}", n) for i, n in enumerate(counts)], "term string, n long")).collect()}
    assert not any(a != b and b.startswith(a) for a, b in itertools.permutations(got.values(), 2)) and len(set(got.values())) == 40
    heap, cost = sorted(counts), 0
    while len(heap) > 1:
        two = heap[0] + heap[1]
        cost += two
        heap = sorted(heap[2:] + [two])
    assert sum(n * len(got[f"w{i}"]) for i, n in enumerate(counts)) == cost


def test_word_breaks(spark):
    got = spark.createDataFrame([("thecatsat",), ("",), (None,), ("catx",)], "t string").select(tokens.word_breaks(F.col("t"), ["the", "cat", "sat", "at", "he"]))
    assert [x[0] for x in got.collect()] == ["the cat sat", "", None, "cat x"]


def test_swaps_exchange_neighbours_once(spark):
    rows = [([f"w{i}" for i in range(n)], str(n)) for n in range(9)]
    for x in spark.createDataFrame(rows, "t array<string>, k string").select("t", tokens.swapped(F.col("t"), 0.5, F.col("k")).alias("s")).collect():
        moved = [i for i in range(len(x.t)) if x.t[i] != x.s[i]]
        assert sorted(x.t) == sorted(x.s) and len(moved) == 2 * math.floor(len(x.t) // 2 * 0.5 + 0.5)
        assert all(x.s[i] == x.t[i + 1] and x.s[i + 1] == x.t[i] for i in moved[::2])


def test_sequences_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        m, p = ([r.choice("abcd") for _ in range(r.randrange(0, 7))] for _ in range(2))
        best = max(k for k in range(len(m) + 1) if any(is_inside(c, p) for c in itertools.combinations(m, k)))
        marks = rouge._matched(m, p, 1.0)
        assert marks.sum() == best and is_inside([x for x, y in zip(m, marks) if y], p)
    assert rouge.sequence_hits([["the", "cat", "ran"]], [["the", "cat", "sat"]]) == (2.0, 3.0, 3.0)
    together, apart = (rouge.sequence_hits([list("abcdefg")], [list(p)], 1.2)[0] for p in ("abcdhik", "ahbkcid"))
    assert together == pytest.approx(4**1.2) and apart == pytest.approx(4**1.2)
    assert rouge.sequence_hits([list("abcd")], [list("ab"), list("cd")]) == (4.0, 4.0, 4.0)
    assert rouge.sequence_hits([list("aa")], [list("a"), list("a")])[0] == 1.0


def is_inside(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


def test_best_model_is_the_one_of_the_best_recall(spark):
    rows = [("d", "m1", 2, 5, 10), ("d", "m2", 3, 5, 6), ("e", "m1", 0, 4, 4)]
    got = {x.key: (x.hit, x.model) for x in rouge.best_model(spark.createDataFrame(rows, "key string, name string, hit long, peer long, model long"), "key", "name").collect()}
    assert got == {"d": (3, 6), "e": (0, 4)}


def table_of(spark, matrix, doc=None):
    return spark.createDataFrame([(i, [float(x) for x in v], 0 if doc is None else doc[i]) for i, v in enumerate(matrix)], "id long, v array<double>, doc long")


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spaces, "BLOCK", 7)
    m = np.random.default_rng(1).normal(size=(30, 4)).round(2)
    t = table_of(spark, m)
    got = {(x["query"], x["id"]) for x in spaces.neighbours(t.filter("id % 3 = 0"), t, 4).collect()}
    want = {(q, j) for q in range(0, 30, 3) for j in sorted(range(30), key=lambda j: (-round(float(m[q] @ m[j]), 9), j))[:4]}
    assert got == want
    assert spaces.neighbours(t.limit(0), t, 4).count() == 0


def test_spherical_kmeans_against_a_loop(spark):
    m = np.random.default_rng(2).normal(size=(40, 3))
    label = np.arange(40) % 4
    for _ in range(5):
        c = np.stack([m[label == k].mean(0) if (label == k).any() else np.zeros(3) for k in range(4)])
        c = c / np.where(np.linalg.norm(c, axis=1) > 0, np.linalg.norm(c, axis=1), 1)[:, None]
        label = np.argmax(np.round(m @ c.T, 9), axis=1)
    got = {x.id: x.cluster for x in spaces.spherical_kmeans(table_of(spark, m).select("id", "v"), 4, 5).collect()}
    assert [got[i] for i in range(40)] == label.tolist()


def test_linear_map_is_least_squares(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(50, 3)), r.normal(size=(50, 2))
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(3)
    matrix = spaces.linear_map(pairs)
    assert np.allclose(matrix, np.linalg.lstsq(x, y, rcond=None)[0])
    got = sorted(spaces.apply_map(table_of(spark, x), matrix).collect(), key=lambda r: r.id)
    assert np.allclose([r.v for r in got], x @ matrix)


EDGES = [(1, 2, 1.0), (1, 3, 2.0), (2, 3, 1.0), (3, 4, 1.0), (5, 6, 3.0)]


def test_walks_follow_edges_and_their_weights(spark):
    edges = spark.createDataFrame(EDGES, "a long, b long, weight double")
    near = {}
    for a, b, w in EDGES:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    walks = graphs.random_walks(edges, per_node=1500, length=3, p=0.4, q=0.5).collect()
    assert len(walks) == 6 * 1500 and all(len(x.path) == 3 and x.path[0] == x.start and all(b in near[a] for a, b in zip(x.path, x.path[1:])) for x in walks)
    firsts = Counter(x.path[1] for x in walks if x.start == 1)
    assert abs(firsts[3] / 1500 - 2 / 3) < 0.06
    # After 1, 3: back weighs 2 / 0.4, to 2 (beside 1) 1, on to 4 1 / 0.5.
    after = Counter(x.path[2] for x in walks if x.path[:2] == [1, 3])
    total = sum(after.values())
    assert all(abs(after[k] / total - w / 8) < 0.06 for k, w in ((1, 5), (2, 1), (4, 2)))
    lonely = spark.createDataFrame([(1, 2, 1.0)], "a long, b long, weight double")
    assert {tuple(x.path) for x in graphs.random_walks(lonely, 1, 4).collect()} == {(1, 2, 1, 2), (2, 1, 2, 1)}


def test_retrofits_reach_the_fixed_point(spark):
    values = spark.createDataFrame([(0, 1, [1.0]), (0, 2, [0.0]), (0, 3, [1.0]), (0, 9, [5.0])], "g long, id long, v array<double>")
    edges = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0)], "g long, a long, b long, weight double")
    got = {x.id: x.v[0] for x in graphs.retrofit_groups(values, edges, 60).collect()}
    assert got == {1: pytest.approx(2 / 3), 2: pytest.approx(1 / 3), 3: pytest.approx(2 / 3), 9: 5.0}
    walks = spark.createDataFrame([(1, [1, 2]), (2, [2, 1]), (2, [2, 3]), (3, [3, 2])], "start long, path array<long>")
    got = {x.id: x.v[0] for x in graphs.retrofit_walks(values.select("id", "v"), walks, 12).collect()}
    assert got == {1: pytest.approx(2 / 3, abs=1e-3), 2: pytest.approx(1 / 3, abs=1e-3), 3: pytest.approx(2 / 3, abs=1e-3), 9: 5.0}


def test_diverse_ranks(spark):
    ranks = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in range(5)], "doc_id long, node int, rank double")
    edges = spark.createDataFrame([(1, a, b, w) for a, b, w in ((0, 1, 1.0), (1, 0, 1.0), (0, 2, 0.1), (2, 0, 0.1), (2, 3, 0.9), (3, 2, 0.9))], "doc_id long, a int, b int, weight double")
    order = lambda share: [x.node for x in sorted(graphs.diverse_ranks(ranks, edges, share).collect(), key=lambda x: x.position)]
    assert order(1.0) == [0, 1, 2, 3, 4]
    # Costs: after 0, node 1 has 0.1 + 0.5, node 2 0.2 + 0.05, node 3 0.3, node 4 0.4.
    assert order(0.5) == [0, 2, 4, 1, 3]


def test_models_learn(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(3, 4)) * 6
    rows = [(i, (centres[i % 3] + r.normal(size=4)).tolist(), i % 3) for i in range(90)]
    t = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = models.classify_vectors(t.filter("id < 60"), t.filter("id >= 60"), 10.0).collect()
    assert len(got) == 30 and sum(x.label == x.predicted for x in got) >= 28
    found = {x.id: x.cluster for x in models.cluster(t.select("id", "v"), 3, 3).collect()}
    assert all(found[i] == found[i % 3] for i in range(90)) and len(set(found.values())) == 3
    texts = spark.createDataFrame([(i, ("good fine nice " if i % 2 else "bad poor awful ") * 3 + str(i), i % 2) for i in range(40)], "id long, text string, label int")
    got = models.classify_texts(texts.filter("id < 30"), texts.filter("id >= 30"), 10.0).collect()
    assert all(x.label == x.predicted for x in got)
    assert {x.predicted for x in models.majority(t.filter("id < 1"), t).collect()} == {0}
    pairs = spark.createDataFrame([(i, [x := i / 60, x * x], 1 + 4 * x) for i in range(60)], "id long, v array<double>, score double")
    got = models.regress_similarity(pairs, pairs).collect()
    assert np.corrcoef([x.score for x in got], [x.predicted for x in got])[0, 1] > 0.9


def test_adjusted_mutual_information(spark):
    one = lambda rows: models.adjusted_mutual_information(spark.createDataFrame(rows, "y int, p int"))
    assert one([(0, 1), (0, 1), (1, 0), (1, 0)]) == pytest.approx(1.0)
    y, p = [0, 0, 0, 1, 1], [0, 0, 1, 1, 1]

    def mutual(p):
        return sum(c / 5 * math.log(5 * c / (y.count(a) * list(p).count(b))) for (a, b), c in Counter(zip(y, p)).items())

    every = [mutual(q) for q in itertools.permutations(p)]
    expected = sum(every) / len(every)
    h = max(-sum(v / 5 * math.log(v / 5) for v in Counter(t).values()) for t in (y, p))
    assert one(list(zip(y, p))) == pytest.approx((mutual(p) - expected) / (h - expected))


def test_search_takes_the_first_best():
    s = tuning.Search(lambda window, beta=0: -abs(window - 9) - beta)
    assert s.run(tuning.grid(window=tuning.WINDOWS)) == {"window": 8}
    assert s.then().run(tuning.grid(beta=tuning.WEIGHTS)) == {"beta": 0.3}


def test_select_and_batches(spark):
    t = spark.range(12)
    assert [len(b) for b in relational.batches(t, 5)] == [5, 5, 2]
    assert relational.select(spark, {"t": t}, ["t.id"], [("t.id", ">", "3"), ("t.id", "<", "6")], order_by=["t.id"]).collect() == [(4,), (5,)]


def test_readers_read_files(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text if isinstance(text, bytes) else text.encode())

    for k in range(10):
        put(f"news/20news-bydate-train/sci.med/{k}", f"From: a\n\n> q\nbody {k}\n--\nsig")
    put("news/20news-bydate-test/rec.autos/7", b"From: a\n\nb\xffody\n\nsig")
    put("news/20news-bydate-test/misc.forsale/8", "From: a\n\nbody")
    put("news/.hidden/20news-bydate-test/rec.autos/9", "From: a\n\nbody")
    got = readers.read(spark, "news", str(tmp_path / "news")).collect()
    assert Counter(x.istrain for x in got) == {"YES": 8, "VALID": 2, "NO": 1} and {x.content for x in got if x.split == "test"} == {"body"}
    put("imdb/train/pos/1", "a<br />b &amp; c")
    put("imdb/test/unsup/1", "x")
    assert [(x.topic, x.content) for x in readers.read(spark, "imdb", str(tmp_path / "imdb")).collect()] == [("pos", "ab & c")]
    put("sick/SICK.txt", "pair_ID\tA\tB\tl\ts\tset\n1\tone\ttwo\tN\t4.5\tTRAIN\n")
    assert tuple(readers.read(spark, "sick", str(tmp_path / "sick")).first()) == ("1", "one", "two", 4.5, "TRAIN")
    put("tree/datasetSplit.txt", "i,s\n1,1\n2,2\n3,3\n")
    put("tree/datasetSentences.txt", "i\ts\n1\tA, b\n2\tc\n3\td\n")
    put("tree/sent_sentiment.txt", "1\t0.2\n2\t0.5\n3\t0.9\n")
    tree = str(tmp_path / "tree")
    assert sorted(map(tuple, readers.read(spark, "treebank", tree).collect())) == [(1, "A, b", "ng", "YES"), (3, "d", "pos", "VALID")]
    assert [x.topic for x in readers.read(spark, "treebank", tree, ways=5).orderBy("id").collect()] == ["vng", "ntrl", "vpos"]
    body = "word " * 100 + "."
    put("duc/d1/doc1", f"<DOC><TEXT>{body}</TEXT></DOC>")
    put("duc/d1/doc2", "<DOC>no text</DOC>")
    put("duc/d1/perdocs", f'<SUM DOCREF="doc1" SUMMARIZER="a">{body}</SUM><SUM DOCREF="doc2" SUMMARIZER="a">{body}</SUM>')
    assert [x.filename for x in readers.read(spark, "duc", str(tmp_path / "duc")).collect()] == ["doc1"]
    put("vectors.txt", "2 3\na 1 2 3\nb 4 5 6\n")
    assert {x.term: x.v for x in readers.read(spark, "vectors", str(tmp_path / "vectors.txt")).collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    with pytest.raises(ValueError):
        readers.read(spark, "unknown", "x")


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "topic")
    sinks.insert(spark.createDataFrame([("b",), ("a",)], "name string"), path, ["name"])
    sinks.insert(spark.createDataFrame([("c",)], "name string"), path, ["name"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    sinks.truncate(spark, [path])
    assert spark.read.parquet(path).count() == 0 and sinks.execute(spark, "select 1 as x").first().x == 1
    v = spark.createDataFrame([(1, [3.0, 4.0])], "id long, v array<double>")
    sinks.dump_vectors(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).first().unit[0] == pytest.approx(0.6, abs=1e-5)
    assert spark.read.text(str(tmp_path / "v_text")).first().value == "1 3.000 4.000"
    sinks.write_training_csv(v, spark.createDataFrame([(1, "y")], "id long, label string"), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).first().value == "1,3.0,4.0,y"
    s = spark.createDataFrame([(1, 4, 1)], "doc_id long, node int, position int")
    assert sorted(map(tuple, sinks.summary_rows({1: s, 21: s}).collect())) == [(1, 1, 4, 1), (1, 21, 4, 1)]
    page = spark.range(1).select(sinks.evaluation_html(F.lit("x"), F.array(F.lit("a < b")))).first()[0]
    assert '<a name="1">[1]</a> a &lt; b' in page
    assert sinks.report(spark.createDataFrame([("m", "f1", 0.5)], "method string, metric string, value double")) == "m\tf1\t0.5000"
