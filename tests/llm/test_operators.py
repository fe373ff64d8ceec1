"""Operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import zlib

import pytest
from oracle import spark_rows, sql_rows

from textloom.llm import automaton, bpe, fingerprints, jaccard, licenses, media, mixing, quality, queries, sharding, token_counts, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, h string"


def rows():
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "cc", "by", "License", "x1"]
    found = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "null id"), (None, None), (4, "CC by 4.0\nAll rights reserved. <|endoftext|>"), (5, "é 世界 🙂  \t\n"), (6, "w" * 9000), (6, "other text")]
    base = [r.choice(words) + str(r.randrange(40)) for _ in range(120)]
    for i in range(10, 30):
        copy = list(base)
        for _ in range(i % 5):
            copy[r.randrange(len(copy))] = "edit" + str(r.randrange(99))
        found.append((i, " ".join(copy)))
    found += [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for i in range(30, 60)]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None]), 0, "x", "y", "z") for i, t in found]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(10, 60)] + [(None, 1, None)], "doc_id long, quality int, toxic int")


def test_sharding_is_a_permutation_with_even_shards(docs, empty):
    got = sharding.shuffle_into_shards(docs, shards=4, bucket_bytes=2000).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows())
    by_shard = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    again = sharding.shuffle_into_shards(docs.repartition(5), shards=4, bucket_bytes=2000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shuffle_into_shards(empty).count() == 0


def test_bpe_matches_the_library_and_decodes(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = bpe.encode_documents(docs, path, keep=["doc_id", "text"], digests=True).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    decoded = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    assert sorted(r.text for r in decoded.collect()) == sorted(r[1] or "" for r in rows())
    assert bpe.encode_documents(empty, path).count() == 0


def test_automaton_equals_merging(docs):
    r = random.Random(1)
    labels = {i: bytes([97 + i]) for i in range(3)}
    merges = []
    for _ in range(25):
        a, b = r.choice(list(labels)), r.choice(list(labels))
        if labels[a] + labels[b] not in labels.values():
            labels[len(labels)] = labels[a] + labels[b]
            merges.append((a, b, len(labels) - 1))
    machine = automaton.Automaton(labels, merges)
    rank = {(a, b): (i, c) for i, (a, b, c) in enumerate(merges)}
    for n in range(1, 8):
        for word in itertools.product(b"abc", repeat=n):
            ids = [x - 97 for x in word]
            while True:
                best = min(((rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
                if best is None:
                    break
                i = best[1]
                ids[i : i + 2] = [rank[ids[i], ids[i + 1]][1]]
            assert machine.encode(bytes(word)) == ids


def test_mixing_keeps_targets(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    total = sum(r.size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * total) < 1e-6
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sum(r.size for r in own) and own[0].target <= 2 * own[0].source_size + 1e-9
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.copies in (0, 1, 2) for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns


def test_token_counts_match_the_library_and_the_cache(spark, docs, empty, tmp_path):
    import sentencepiece

    path, cache = queries.tokenizer("piece_bpe_32k.model"), str(tmp_path / "cache")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows())
    for _ in range(2):
        got = token_counts.count_tokens(docs, path, cache).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert spark.read.parquet(cache).count() == len({r[1] or "" for r in rows()})
    assert token_counts.count_tokens(empty, path).count() == 0


@pytest.mark.parametrize("width,threshold", [(3, 0.9), (5, 0.8)])
def test_jaccard_join_is_exact(docs, empty, width, threshold):
    sets = []
    for r in rows():
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
            old, new = root[j], root[i]
            root = [new if x == old else x for x in root]
    ids = [r[0] for r in rows()]
    want = []
    for i in range(len(sets)):
        reached = [ids[j] for j in range(len(sets)) if root[j] == root[i] and ids[j] is not None]
        want.append((ids[i] or -1, len(sets[i]), min(reached, default=None) or -1))
    got = jaccard.similar_components(docs, width, threshold).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == sorted(want)
    assert jaccard.similar_components(empty, width, threshold).count() == 0
    assert jaccard.keep_one_per_component(docs, width, threshold).columns == docs.columns


def test_licenses_match_sql(spark, docs, empty):
    assert spark_rows(licenses.scan_licenses(spark.read.parquet(f"{SF}/documents.parquet"))) == sql_rows(licenses.oracle(), SF)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(got) <= len(rows()) and got[4].base_labels == "cc-by,reserved" and got[4].first_word == 0 and got[1].n_words == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_quality_separates_junk(spark, docs, empty, labels):
    d, known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_quality(d, known).join(known, "doc_id").groupBy("quality").avg("keep").collect()
    share = {r[0]: r[1] for r in got}
    assert share[1] > 0.97 and share[0] < 0.3
    assert quality.score_quality(docs, labels).count() == len(rows())
    assert quality.score_quality(empty, labels).count() == 0
    assert quality.reject_poor(docs, labels).columns == docs.columns


def test_stretches_give_every_text_its_own_ngrams(monkeypatch):
    texts = ["", "a", "abc\0de", "Él 12, naïve\n" * 9, "x" * 23, ""]
    classes = [[0] * (quality.ORDER - 1) + [quality.class_of(ord(c)) for c in t] for t in texts]
    wanted = []
    for line in classes:
        for end in range(quality.ORDER, len(line) + 1):
            code = 0
            for c in line[end - quality.ORDER : end]:
                code = code * quality.CLASSES + c
            wanted.append(code)
    for size in (5, 16, 1 << 18):
        monkeypatch.setattr(quality, "STRETCH", size)
        groups = list(quality.stretches(texts))
        assert all(sum(end - at for _, at, end in g) <= size for g in groups)
        assert [x for g in groups for x in quality.grams_of(texts, g, quality.class_table())[0].tolist()] == wanted


def test_quality_equals_a_plain_model_and_hears_every_script(spark, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("абвгдежзик") for _ in range(5)) for _ in range(12)]
    good = [" ".join(r.choice(words) for _ in range(60)) for _ in range(30)]
    junk = ["".join(r.sample(t, len(t))) for t in good[:5]]
    order, start = quality.ORDER, "\1"
    counts = {}
    for t in good:
        for i in range(len(t)):
            g = (start * order + t)[i + 1 : i + 1 + order]
            counts[g] = counts.get(g, 0) + 1
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = {}
        for g in tables[k + 1]:
            tables[k][g[1:]] = tables[k].get(g[1:], 0) + 1
    discounts, totals, lefts = {}, {}, {}
    for k, table in tables.items():
        n = [0] + [sum(v == j for v in table.values()) for j in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        discounts[k] = [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.05), j - 0.05) if n[j] else 0.5 for j in (1, 2, 3)]
        for g, v in table.items():
            totals[g[:-1]] = totals.get(g[:-1], 0) + v
            lefts[g[:-1]] = lefts.get(g[:-1], 0) + discounts[k][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(tables[1]) + 1)
        if g[:-1] not in totals:
            return p(g[1:])
        v = tables[len(g)].get(g, 0)
        return (v - discounts[len(g)][min(v, 3) - 1] if v else 0) / totals[g[:-1]] + lefts[g[:-1]] / totals[g[:-1]] * p(g[1:])

    texts = good + junk + ["語 unseen"]
    model = quality.Model(quality.count_grams(spark.createDataFrame([(t,) for t in good], "text string").repartition(3)), quality.Scratch(spark, "test"))
    monkeypatch.setattr(quality, "BLOCK_CHARS", 2000)
    got = {x.doc_id: x.perplexity for x in quality.with_perplexity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        logs = [math.log(p((start * order + t)[j + 1 : j + 1 + order])) for j in range(len(t))]
        assert got[i] == pytest.approx(math.exp(-sum(logs) / len(t)), rel=1e-5)
    assert min(got[i] for i in range(30, 35)) > 2 * max(got[i] for i in range(30))


def test_toxicity_on_held_out_rows(spark, docs, empty, labels):
    d, known = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score_documents(d, known).filter("held_out").join(known, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits >= 0.8 * sum(r.toxic for r in got) and hits >= 0.95 * sum(r.predicted for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert toxicity.score_documents(docs, labels).count() == len(rows())
    assert toxicity.score_documents(empty, labels).count() == 0


def test_fingerprints_follow_the_order(docs, empty):
    clean = docs.filter("doc_id is not null and doc_id not in (3, 6)")
    got = {r.doc_id: r for r in fingerprints.compare_with_next(clean, bucket_bytes=3000).collect()}
    texts = {r[0]: r[1] or "" for r in rows() if r[0] is not None and r[0] not in (3, 6)}
    order = sorted(texts, reverse=True)
    walker = fingerprints.Walker()
    assert set(got) == set(texts)
    for i, doc_id in enumerate(order):
        t, following = texts[doc_id], texts[order[(i + 1) % len(order)]]
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        a, b, c = (fingerprints.fingerprint_texts([x])[0] for x in (t, edited, following))
        assert (got[doc_id].fingerprint, got[doc_id].edited_fingerprint) == (a, b)
        assert got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc_id].near_edited == fingerprints.likeness(walker, a, b) and got[doc_id].near_next == fingerprints.likeness(walker, a, c)
    assert fingerprints.compare_with_next(docs).count() == len(rows())
    assert fingerprints.compare_with_next(empty).count() == 0
    classes = fingerprints.near_classes(docs).collect()
    assert len(classes) == len(rows()) and {r.class_id for r in classes if r.doc_id == 3} == {3}


def test_media_round_trip(docs, empty):
    got = media.read_media(media.to_media(docs)).collect()
    assert len(got) == len(rows())
    want = sorted(hashlib.sha256(media.padded(r[1] or "")[0]).hexdigest() for r in rows())
    assert sorted(r.payload_sha256 for r in got) == want
    data = media.pack(bytes(range(256)) * 20)
    frame = media.parse_avi(data)["frames"][1]
    slow = media.decode_frame(data, *frame)
    assert (slow == slow[:, :1, :1]).all() and (slow[:, 0, 0] == media.unpack(data)[1][1]).all()
    assert media.clip_rows(media.read_media(media.to_media(docs))).count() >= len(rows())
    assert media.to_media(empty).count() == 0
