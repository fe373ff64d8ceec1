"""Cases that once gave wrong results: each was wrong before its fix."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, common, jaccard, licenses, mixing, queries, sharding, token_counts, toxicity

#: Two words whose CRC-32 is equal from any start value.
ALIKE = ("ppjhntuqn", "sjzbybvos")


def test_sharding_keeps_large_ids_beside_null(spark):
    rows = [(2**60 + 1, "a"), (None, "b"), (None, None), (2**53 + 1, "c"), (-(2**62) - 1, "d")]
    got = sharding.shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=2)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(rows)
    assert sorted(r.slot for r in got.collect()) == [0, 0, 1, 1, 2]


def test_sharding_deals_repeated_rows_apart(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    rows = [(1, "same text")] * 300 + [(i, f"text {i}") for i in range(2, 90)] + [(None, None)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.shuffle_into_shards(docs, shards=3, bucket_bytes=700).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(3)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert max(sum(r.doc_id == 1 for r in got if r.shard == s) for s in range(3)) < 200
    again = sharding.shuffle_into_shards(docs.repartition(5), shards=3, bucket_bytes=700).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_documents_has_all_copies_of_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED", 4)
    r = random.Random(2)
    rows = [(7, "w " * 40, "s1", "x", i) for i in range(9)] + [(None, t, "s1", "x", 0) for t in ("a b c", "d e f", "a b c")]
    rows += [(i, " ".join(["v"] * r.randrange(1, 60)), r.choice(["s1", "s2", "s3", None]), "y", i) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, nth int").repartition(3)
    want = Counter()
    for x in mixing.mix(docs).collect():
        want[x.doc_id, x.source, x.size] += x.copies
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    found = Counter((x.doc_id, x.source, len(x.text.split())) for x in got.collect())
    assert found == Counter({k: v for k, v in want.items() if v})


def plain_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    """Cuts sources above their limit and shares the rest anew until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, done = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s] + 1e-12}
        if not over:
            return done | {s: level * weight[s] for s in open_}
        for s in over:
            done[s] = most * sizes[s]
            left -= done[s]
        open_ -= over
    return done


@pytest.mark.parametrize("seed", range(4))
def test_mixing_targets_against_a_plain_loop(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([1, 5, 40, 900, 20000]) for s in ["a", "b", "é", "z", "日", None][: r.randrange(2, 7)]}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = plain_targets(sizes)
    assert {x.source: pytest.approx(x.target, rel=1e-9) for x in got} == want


def test_mixing_rounds_each_document_with_its_expectation(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string").cache()
    total, runs = Counter(), 8
    for seed in range(runs):
        for x in mixing.mix(docs, seed=seed).collect():
            total[x.doc_id] += x.copies
            expected = x.target / x.source_size
            assert math.floor(expected) <= x.copies <= math.ceil(expected)
    ratio = {x.doc_id: x.target / x.source_size for x in mixing.mix(docs).collect()}
    for i, e in ratio.items():
        f = e - math.floor(e)
        assert abs(total[i] / runs - e) <= 4.5 * math.sqrt(max(f * (1 - f), 1e-9) / runs) + 1e-9


def test_jaccard_tells_words_of_equal_crc_apart(spark):
    words = [f"w{i}" for i in range(30)]
    texts = [*ALIKE, " ".join([*words, ALIKE[0]]), " ".join([*words[:10], ALIKE[1], *words[10:]]), " ".join([ALIKE[0]] * 2 + words), " ".join([ALIKE[1]] * 2 + words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(docs, 3, 0.9).collect()}
    assert got[0] != got[1]
    sets = jaccard.Shingler(1)(list(ALIKE))
    assert sets.first[0] != sets.first[1] and sets.second[0] != sets.second[1] and len(set(sets.digests().tolist())) == 2


def test_shingles_against_plain_sets(spark):
    r = random.Random(8)
    texts = ["", " \t\n", "One", "a b", "A b c   d"] + [" ".join(r.choice("abcde") for _ in range(r.randrange(1, 40))) for _ in range(60)]
    for width in (1, 3, 5):
        sets, plain = jaccard.Shingler(width)(texts), []
        for t in texts:
            w = t.encode().lower().split()
            plain.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
        assert sets.sizes.tolist() == [len(p) for p in plain]
        names = sets.digests().tolist()
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert jaccard.common_shingles(sets[i], sets[j]) == len(plain[i] & plain[j])
                assert (names[i] == names[j]) == (plain[i] == plain[j])


def test_repeated_rows_of_an_owner_join_once(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(base))] * 40 + [(2, " ".join(base[:-1] + ["x"]))] * 30 + [(None, " ".join(base[1:] + ["y"]))] * 5 + [(9, "alone")]
    docs = spark.createDataFrame([(*t, "id", 1) for t in texts], "doc_id long, text string, row string, g int").repartition(3)
    got = jaccard.similar_components(docs, 3, 0.9).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(1, 1): 40, (2, 1): 30, (None, 1): 5, (9, 9): 1})
    kept = jaccard.keep_one_per_component(docs, 3, 0.9)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 9]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Context.master = "local[2]"
    assert common.shared_dir(Session()) == common.shared_dir(Session())


def test_session_settings_stay(spark):
    before = {key: spark.conf.get(key) for key in common.ARROW_BOUNDS}
    docs = spark.createDataFrame([(1, "a b c d"), (2, "bad words")], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))
    jaccard.similar_components(docs).count()
    assert {key: spark.conf.get(key) for key in before} == before
    with common.short_batches(spark):
        assert {key: int(spark.conf.get(key)) for key in before} == common.ARROW_BOUNDS
    assert {key: spark.conf.get(key) for key in before} == before


def test_toxicity_learns_once_from_a_repeated_id(spark):
    rows, labels = [(1, "bad bad"), (2, "good text"), (3, "fine day")], [(1, 1), (2, 0), (3, 0)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    once = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), table)
    often = toxicity.train(spark.createDataFrame(rows + rows[:1] * 500, "doc_id long, text string").repartition(4), table)
    assert [x.tolist() if hasattr(x, "tolist") else x for x in once] == [x.tolist() if hasattr(x, "tolist") else x for x in often]
    with pytest.raises(ValueError):
        toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), table, toxicity.Settings(sample_rows=10**6))


def test_ftrl_against_a_plain_loop():
    s = toxicity.Settings(bits=6, l1=0.3)
    r = random.Random(4)
    model, z, n = toxicity.Ftrl(s), [0.0] * 65, [0.0] * 65

    def weight(i):
        if abs(z[i]) <= (0 if i == 64 else s.l1):
            return 0.0
        return -(z[i] - math.copysign(0 if i == 64 else s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    import numpy as np

    for _ in range(60):
        at, y = sorted(r.sample(range(64), 6)), r.randrange(2)
        w = {i: weight(i) for i in [*at, 64]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in w:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
            n[i] += g * g
        model.learn(np.array(at), float(y))
    assert model.z.tolist() == pytest.approx(z) and model.n.tolist() == pytest.approx(n)


def test_decoding_skips_ids_that_the_vocabulary_lacks(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    ids = [r.token_ids for r in bpe.encode_documents(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), path).collect()][0]
    table = spark.createDataFrame([(1, [ids[0], -1, None, 10**9, *ids[1:]]), (2, None)], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_documents(table, path).collect()} == {1: "hello world", 2: ""}


def test_stages_keep_columns_with_clashing_names(spark):
    from textloom.llm import quality

    names = ["perplexity", "threshold", "of", "score", "row", "h", "nth", "id", "own", "block", "n"]
    rows = [(i, f"text number {i} of many words", "en", "s", 5, *map(str, range(len(names)))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    for got in (toxicity.reject_toxic(docs, labels), quality.reject_poor(docs, labels), jaccard.keep_one_per_component(docs), mixing.mix_documents(docs)):
        assert got.columns == docs.columns and set(map(tuple, got.collect())) <= set(rows)
    assert quality.reject_poor(docs.select(F.col("doc_id"), "text", "lang", "source", "n_chars").limit(0), labels).count() == 0


def test_contract_columns(spark):
    """The queries' columns and types on a small table."""
    sf = "/root/testdata/sf0.001"
    types = {name: dict(f(spark, sf).dtypes) for name, f in queries.QUERIES.items() if name not in ("op5_ngram_jaccard",)}
    assert types["op1_sharding"].items() >= {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}.items()
    assert types["op2_bpe"].items() >= {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}.items()
    assert types["op3_mixing"].items() >= {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}.items()
    assert types["op4_token_counts"].items() >= {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}.items()
    assert types["op6_licenses"].items() >= {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}.items()
    assert types["op8_fingerprints"].items() >= {"n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}.items()
    assert types["op9_toxicity"].items() >= {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items()
    assert types["op10_media"].items() >= {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}.items()


def test_a_text_of_many_rows_gets_its_count(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(token_counts, "HEAVY", 10)
    path = queries.tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, "copied text") for i in range(40)] + [(i, None) for i in range(40, 60)] + [(99, "rare one"), (None, "x")]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, limit=2)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 2) for i, t in rows)
    assert Counter(map(tuple, got.collect())) == want


def test_license_blocks_cross_lines_and_siblings_stay_apart(spark):
    bsd = "Redistribution and use in source and binary forms,\nwith or without\n\n modification, are permitted."
    gap = " filler" * 40
    texts = {
        1: (bsd, "bsd"), 2: (bsd.replace("forms", "forms" + gap), ""), 3: ("x" + gap * 90 + "\n" + bsd + gap * 90, "bsd"),
        4: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        5: ("Licensed under the GNU Lesser General\nPublic License", "gpl,lgpl"),
        6: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"), 7: ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa"),
        8: (" ".join(w + gap for w in "released under the mit license".split()), ""), 9: ("Released under\nthe MIT License\n" * 3000, "mit"),
        10: (None, ""), 11: ("\0 \x7f--", ""), 12: ("ALL\0RIGHTS\nreserved ÄÖ", "reserved"),
    }
    rows = [(i, t, "clash") for i, (t, _) in texts.items()] + [(1, bsd, "clash"), (None, bsd, "clash"), (None, bsd, None)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)).collect()
    assert Counter((r.doc_id, r.labels) for r in got) == Counter((i, texts[i][1] if i else "bsd") for i, _, _ in rows)
    assert {r.doc_id: r.n_words for r in got}[12] == 4 and {r.doc_id: r.n_words for r in got}[11] == 0


def test_license_blocks_against_every_window(spark):
    r = random.Random(5)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split(" ")}) + ["other", "words"]
    rows = []
    for i in range(150):
        text = [r.choice(vocabulary) for _ in range(r.randrange(60))]
        for _, t in r.sample(licenses.TEMPLATES, 2):
            near = [w if r.random() > 0.1 else "odd" for w in t.split(" ")]
            at = r.randrange(len(text) + 1)
            text[at:at] = [x for w in near for x in ([w] if r.random() > 0.3 else [w, "gap"])]
        rows.append((i, "\n".join(text)))

    def plain(text):
        tokens, best = text.split("\n"), {}
        for t, (label, template) in enumerate(licenses.TEMPLATES):
            wanted, span = set(template.split(" ")), licenses.STRETCH * len(template.split(" "))
            must = set(licenses.telling(licenses.TEMPLATES, t, licenses.CONTAINMENT))
            shares = [len(s) / len(wanted) for i in range(len(tokens)) if must <= (s := wanted & set(tokens[i : i + span]))]
            if max(shares, default=0) >= licenses.CONTAINMENT:
                best[label] = max(shares)
        joined = " " + " ".join(tokens) + " "
        base = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in joined}
        return ",".join(sorted(base | set(best))), 1.0 if base else max(best.values(), default=0.0)

    got = {x.doc_id: (x.labels, round(x.score, 9)) for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (plain(t)[0], round(plain(t)[1], 9)) for i, t in rows}
