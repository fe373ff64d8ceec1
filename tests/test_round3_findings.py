"""What the reviewer's findings of round 3 name, at sizes that show them."""

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import vectors as vec
from textloom.llm import jaccard
from textloom.operators import corpus, language, models, neural, recurrent, rouge, sgd, shared, spaces
from textloom.sources import corpora


def test_references_without_a_semicolon_are_text(spark):
    rows = spark.createDataFrame([("<b>a</b>&ampb &amp; &notit; &copy;&#65; &#x42; &amp;copy;",), (None,)], "h string")
    assert [r[0] for r in rows.select(tx.html_text(F.col("h"))).collect()] == ["a&ampb & &notit; ©A B &copy;", None]


def test_word_sums_shuffle_each_word_of_a_block_once(spark):
    draw = np.random.default_rng(3)
    vectors = {f"w{k}": draw.normal(size=4).tolist() for k in range(9)}
    texts = [(d, p, [f"w{x}" for x in draw.integers(0, 12, draw.integers(0, 30))]) for d in range(20) for p in range(3)] + [(None, 1, ["w1", "w1", "w2"]), (0, 0, ["w3"]), (99, 0, None), (99, 1, ["w11"])]
    given = spark.createDataFrame(list(vectors.items()) + [("w8", [1.0, 2.0, 3.0, 4.0]), ("w0", None)], "term string, v array<double>")
    want: dict = {}
    for d, p, words in texts:
        for w in words or []:
            want.setdefault((d, p), []).extend([vectors[w]] if w in vectors else [])
            want[(d, p)] += [[1.0, 2.0, 3.0, 4.0]] if w == "w8" else []
    rows = spark.createDataFrame(texts, "d long, p int, tokens array<string>")
    for how, f in (("avg", np.mean), ("sum", np.sum)):
        found = spaces.word_sums(rows, given, ["d", "p"], how)
        got = {(r["d"], r["p"]): r["v"] for r in found.collect()}
        assert got.keys() == {k for k, v in want.items() if v}
        assert all(np.allclose(v, f(want[k], axis=0), atol=1e-12) for k, v in got.items())


def test_means_are_plain_sums(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 3.0), (1, [5.0, 0.0], 1.0), (2, [4.0, 4.0], 2.0)], "g int, v array<float>, w double")
    means = rows.groupBy("g").agg(vec.mean(F.col("v"), 2, F.col("w")).alias("m"))
    assert {r["g"]: r["m"] for r in means.collect()} == {1: [2.0, 1.5], 2: [4.0, 4.0]}
    assert "ObjectHashAggregate" not in means._jdf.queryExecution().toString()


def test_vectors_are_sent_to_few_meetings(spark):
    draw = np.random.default_rng(5)
    v = np.round(draw.normal(size=(4_500, 3)), 1)
    rows = spark.createDataFrame([(k, x.tolist(), k // 10) for k, x in enumerate(v)], "id long, v array<double>, doc long")
    score = np.round(v @ v.T, 9)
    np.fill_diagonal(score, -np.inf)
    docs = np.arange(len(v)) // 10
    fits = np.where(score >= np.where(docs[:, None] == docs[None], 0.2, 0.3), score, -np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(len(v)), fits.shape), -fits), axis=1)[:, :5]
    for side in (None, 1_000):  # many meetings too
        was, spaces.BLOCK = spaces.BLOCK, side or spaces.BLOCK
        try:
            got = spaces.neighbours(rows, rows, 5, doc=True, intra=0.2, inter=0.3).collect()
        finally:
            spaces.BLOCK = was
        assert {(r["query"], r["id"]) for r in got} == {(q, int(i)) for q in range(len(v)) for i in want[q] if fits[q, i] > -np.inf}
    assert spaces._sides(600_000, 65_536) == 10  # 293 with blocks of 2,048


def test_pairs_of_sentences_stay_in_their_task(spark, monkeypatch):
    draw = np.random.default_rng(7)
    texts = {(d, p): [f"w{x}" for x in draw.integers(0, 25, draw.integers(0, 9))] for d in (1, 2) for p in range(30)}
    rows = spark.createDataFrame([(d, p, w) for (d, p), w in texts.items()] + [(None, 1, ["w1"])], "doc_id long, pos int, tokens array<string>")
    want = {}
    for doc in (1, 2):
        own = {p: {x: w.count(x) for x in w} for (d, p), w in texts.items() if d == doc}
        k = {x: sum(x in c for c in own.values()) for c in own.values() for x in c}
        w = {p: {x: n / max(c.values()) * np.log(len(own) / (k[x] + 1)) for x, n in c.items()} for p, c in own.items()}
        norm = {p: np.sqrt(sum(own[p][x] * v * v for x, v in c.items())) for p, c in w.items()}
        for a in own:
            for b in own:
                if set(own[a]) & set(own[b]) and norm[a] > 0 and norm[b] > 0:
                    want[doc, a, b] = sum(v * w[b].get(x, 0) for x, v in w[a].items()) / (norm[a] * norm[b])
    for matrix in (corpus.MATRIX, 100):  # pieces of sentences and of terms
        monkeypatch.setattr(corpus, "MATRIX", matrix)
        for threshold in (0.1, -1.0):
            edges = corpus.similarity_edges(rows, threshold)
            assert "Join" not in edges._jdf.queryExecution().toString()
            got = {(r["doc_id"], r["a"], r["b"]): r["weight"] for r in edges.collect()}
            assert got.keys() == {x for x, v in want.items() if round(v, 9) > threshold}
            assert all(abs(v - want[x]) < 1e-12 for x, v in got.items())


def test_near_copies_meet_once_though_they_share_many_tiles(spark):
    draw = np.random.default_rng(9)
    rows = [(int(tile), m) for m in range(40) for tile in draw.permutation(30)[:28]]  # each misses two of 30 tiles
    sizes = {tile: sum(x == tile for x, _ in rows) for tile, _ in rows}
    tiles = spark.createDataFrame([(t, sizes[t], 100, m + 1, m + 1) for t, m in rows], "tile long, m long, n long, digest long, root long")
    bits = spark.createDataFrame([(m + 1, bytes(16)) for m in range(40)], "digest long, bits binary")
    every = {(a + 1, b + 1) for a in range(40) for b in range(a + 1, 40)}
    for block in (512, 16):  # a tile in one task, and in several
        was, jaccard.BLOCK = jaccard.BLOCK, block
        try:
            found = [(r["a"], r["b"]) for r in jaccard.meeting_pairs(tiles, bits, 0.8, None).collect()]
        finally:
            jaccard.BLOCK = was
        assert set(found) == every and len(found) < 2 * len(every)  # some 26 tiles hold each pair


def test_overlap_units_stay_with_their_pair(spark):
    draw = np.random.default_rng(11)
    texts = [(k % 12, [f"w{x}" for x in draw.integers(0, 4, n)]) for k, n in enumerate([0, 1, 2, *draw.integers(0, 9, 27)])] + [(13, None), (None, ["w1"]), (14, ["w1", "w2"])]
    peers, models = (spark.createDataFrame(rows, "pair long, tokens array<string>") for rows in (texts, texts[::2] + [(14, ["w2"])]))
    for units, count in ((corpus.grams(2), lambda r: corpus.gram_counts(r, "pair", 2)), (corpus.skip_bigrams(4), lambda r: corpus.skip_bigram_counts(r, "pair", 4))):
        found, want = rouge.common_units(peers, models, "pair", units), rouge.hits(count(peers), count(models), "pair")
        assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_numbered_lines_stay_where_they_are(spark):
    lines = spark.createDataFrame([(0, "a b, a"), (1, None), (130, "z c zz"), (131, "")], "line long, value string")
    ids = spark.createDataFrame([("a", 2), ("b", 3), (",", 4), ("c", 5)], "term string, id long")
    found = corpora.numbered_lines(lines, ids, most=5)
    assert {tuple(r[:2]): r["ids"] for r in found.collect()} == {(0, 0): [2, 3, 4, 2], (1, 0): [], (130, 1): [1, 1, 1], (131, 1): []}
    assert {r["line"]: r["ids"] for r in corpora.numbered_lines(lines, ids).collect()} == {0: [2, 3, 4, 2], 1: [], 130: [1, 5, 1], 131: []}
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_pairs_of_the_taught_text_are_counted_once(spark):
    taught, asked = ([["a", "b", "a"], None, ["b", None, "a"], [], ["a"]], [["a", "b"], ["c", "a"], None, ["b", "c"]])
    rows = [spark.createDataFrame([(k, w) for k, w in enumerate(x)], "id long, tokens array<string>") for x in (asked, taught)]
    pairs = [[p for w in x for v in [["", *filter(None, w or []), ""]] for p in zip(v, v[1:])] for x in (asked, taught)]
    words = {y for _, y in pairs[1]}
    want = {p: (pairs[0].count(p), (pairs[1].count(p) + 0.5) / (sum(x == p[0] for x, _ in pairs[1]) + 0.5 * len(words)) if p[1] in words else None) for p in pairs[0]}
    found = language.bigram_probabilities(*rows, 0.5)
    assert {(r["before"], r["term"]): (r["times"], r["p"]) for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 2


def test_text_models_move_a_number_for_each_text(spark):
    draw = np.random.default_rng(13)
    texts = [(k, " ".join([*(f"w{x}" for x in draw.integers(0, 9, draw.integers(0, 12)) + k % 2), f"own{k}"]), k % 2) for k in range(60)] + [(60, None, 1), (61, "new", 0)]
    rows = spark.createDataFrame(texts, "id long, text string, label int")
    sizes, was = [], recurrent.summed
    try:
        recurrent.summed = lambda words, m, teach: sizes.append(sum(x.size for x in m.values())) or was(words, m, teach)
        found = {r["id"]: (r["label"], r["predicted"]) for r in models.classify_texts(rows.filter("id < 40"), rows.filter("id >= 40")).collect()}
    finally:
        recurrent.summed = was
    assert set(sizes) == {40}
    words = spark.createDataFrame([(k, [w for w in (t or "").split() if w], float(y)) for k, t, y in texts], "id long, kept array<string>, label double")
    features = Pipeline(stages=[CountVectorizer(inputCol="kept", outputCol="n"), IDF(inputCol="n", outputCol="x"), Normalizer(inputCol="x", outputCol="features")]).fit(words.filter("id < 40"))
    model = OneVsRest(classifier=LogisticRegression(regParam=1 / 40, standardization=False)).fit(features.transform(words.filter("id < 40")).select("features", "label"))
    want = {r["id"]: (int(r["label"]), int(r["prediction"])) for r in model.transform(features.transform(words.filter("id >= 40"))).collect()}
    assert found == want


def test_steps_add_to_rows_unsorted_and_draw_as_before(monkeypatch):
    """a step of regularised_chain adds to its rows without sorting them, and draws the rows that running totals give."""
    rng = np.random.default_rng(3)
    for dims in (4, 5):
        matrix, rows, delta = (rng.standard_normal((50, dims)).astype(np.float32), rng.integers(0, 20, 400), rng.standard_normal((400, dims)).astype(np.float32))
        want = matrix.astype(np.float64)
        for r, d in zip(rows, delta):
            want[r] += d
        with monkeypatch.context() as m:
            m.setattr(sgd.np, "argsort", None)
            sgd.add_rows(matrix, rows, delta)
            sgd.add_rows(matrix, rows[:0], delta[:0])
        np.testing.assert_allclose(matrix, want, atol=1e-4)
    weights = np.where(rng.random(3_000) < 0.3, 0, rng.random(3_000) ** 8)
    pool, shares = sgd.Pool.of(weights), np.concatenate([rng.random(20_000), [0.0, np.nextafter(1, 0)]])
    rows, upto = np.flatnonzero(weights > 0), np.cumsum(weights[weights > 0])
    np.testing.assert_array_equal(pool.rows[pool.places(shares)], rows[np.minimum(np.searchsorted(upto, shares * upto[-1], "right"), len(rows) - 1)])
    assert len(sgd.Pool.of(np.zeros(5)).rows) == 0


def test_texts_of_a_step_are_read_alone_and_stay_arrays(spark):
    """F32: a step of convolution_classes opens its part's files only, and its texts are parts of the batch's memory, not lists of Python numbers."""
    rows = spark.range(40).select("id", (F.col("id") % 4).alias("part"), F.when(F.col("id") != 6, F.array_repeat(F.col("id").cast("int"), 2)).alias("ids"))
    table = shared.Tables(spark, "test").put(rows, "parts", "part")
    assert table.columns == rows.columns and sorted(map(tuple, table.collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    own = table.filter("part = 2").select(F.input_file_name().alias("f"), "id").collect()
    assert len(own) == 10 and all("part=2" in r["f"] for r in own)
    assert "PartitionFilters: [isnotnull(part" in table.filter("part = 2")._jdf.queryExecution().executedPlan().toString()
    column = pa.array([[9], [1, 2], None, [], [3]], pa.list_(pa.int32())).slice(1)
    got = recurrent.lists(column)
    assert [r.tolist() for r in got] == [[1, 2], [], [], [3]] and all(r.dtype == np.int32 for r in got)


def test_filters_find_the_first_of_the_greatest_places(spark):
    """F32: the values at all places are those of each filter laid over each place, also for texts shorter than a filter."""
    s = neural.Settings(word_dims=5, units=3, hidden=4, words=20)
    m, rng = neural.first_model(s, 20, 3), np.random.default_rng(1)
    m["filters_b"] += 0.05
    rows = [rng.integers(0, 20, n).astype(np.int32) for n in (0, 1, 2, 3, 9, 40)]
    want = []
    for r in rows:
        x = np.zeros((max(len(r), s.width), s.word_dims))
        x[: len(r)] = m["words"][r]
        z = [sum(x[p + w] @ m["filters"][w] for w in range(s.width)) + m["filters_b"] for p in range(len(x) - s.width + 1)]
        best = np.maximum(np.max(z, axis=0), 0) * (len(r) > 0)
        want.append(recurrent.log_softmax(np.maximum(best @ m["hidden"] + m["hidden_b"], 0) @ m["out"] + m["out_b"]))
    np.testing.assert_allclose(neural.convolved(m, rows, None, None), want, atol=1e-5)


def test_encoding_has_one_python_worker_in_a_task(spark):
    """denoising_encoder numbers words where it encodes them; null and empty sentences, unknown and null words are as before."""
    s = recurrent.Settings(word_dims=4, dims=6, words=6)
    rows = [(1, ["a", "b", "zz"]), (2, None), (3, []), (4, ["b", None]), (5, ["b", "yy"])]
    sentences = spark.createDataFrame(rows, "id long, tokens array<string>")
    words = spark.createDataFrame([(2, "a"), (3, "b")], "id long, term string")
    m = recurrent.first_model(s, 4)
    vectors = recurrent.encode(sentences, m, words)
    assert vectors._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r["id"]: r["v"] for r in vectors.collect()}
    want = recurrent._last_states(m, "encoder", [[2, 3, 1], [3, 1]], True, True)
    np.testing.assert_allclose([got[1], got[4]], want, atol=1e-6)
    assert got[2] == got[3] == [0.0] * 6 and got[4] == got[5]
    ids, mask = recurrent.padded([np.array([2, 3], np.int32), np.zeros(0, np.int32)], True)
    assert ids.T.tolist() == [[2, 3, 0], [0, 0, 0]] and mask.T.tolist() == [[1, 1, 1], [1, 0, 0]]
    assert [None if x is None else x.tolist() for x in recurrent.lists(pa.array([[1], None, []], pa.list_(pa.int32())), null=True)] == [[1], None, []]
