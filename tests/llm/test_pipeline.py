"""The pipeline, each stage against a plainer computation on its own input; media and shards against second computations."""

import random
import struct
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import media, quality, sharding, toxicity
from textloom.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in lower).split(" ") if w]


def test_stages_and_run(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name.replace(" ", "-"))
        stage(spark, now, SF).write.parquet(out)
        seen.append((now, spark.read.parquet(out)))
        now = seen[-1][1]
    assert all(after.columns == docs.columns for _, after in seen[:-1])
    kept = [Counter(r.doc_id for r in after.select("doc_id").collect()) for _, after in seen]

    scores = toxicity.score_documents(docs, labels).collect()
    assert kept[0] == Counter(r.doc_id for r in scores if not r.predicted) and 0 < len(scores) - sum(kept[0].values()) < 0.5 * len(scores)
    judged = quality.score_quality(seen[1][0], labels).collect()
    assert kept[1] == Counter(r.doc_id for r in judged if r.keep) and kept[1].total() < kept[0].total()

    rows = seen[2][0].collect()
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and root[i] != root[j]:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if x == old else x for x in root]
    classes = {}
    for r, k in zip(rows, root):
        classes.setdefault(k, []).append(r.doc_id)
    assert len(kept[2]) == len(classes) and all(sum(kept[2][d] for d in set(ids)) == 1 for ids in classes.values())

    before = {r.doc_id: len(words(r.text)) for r in seen[3][0].collect()}
    assert set(kept[3]) <= set(before) and max(kept[3].values()) <= 2
    assert abs(sum(before[d] * n for d, n in kept[3].items()) - 1.5 * sum(before.values())) < 0.15 * sum(before.values())

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    library.no_truncation(), library.no_padding()
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in seen[4][0].collect())
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in seen[4][1].collect()) == want

    settings = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch",)}
    again = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in again.select("doc_id").collect()) == kept[4]
    assert settings == {k: spark.conf.get(k) for k in settings}


def plain_frame(data: bytes) -> list[int]:
    """The mean level of each block of a one-component baseline JPEG whose blocks are flat: bit by bit, by the standard."""
    at, tables = 2, {}
    while True:
        marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + length]
        if marker == 0xDB:
            step = body[1]
        elif marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
        elif marker == 0xC4:
            code, symbols, table = 0, list(body[17:]), {}
            for size in range(1, 17):
                for _ in range(body[size]):
                    table[f"{code:0{size}b}"] = symbols.pop(0)
                    code += 1
                code *= 2
            tables[body[0]] = table
        elif marker == 0xDA:
            break
        at += 2 + length
    scan = data[at + 2 + length : data.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    bits, place = "".join(f"{x:08b}" for x in scan), 0

    def symbol(table):
        nonlocal place
        for size in range(1, 17):
            if bits[place : place + size] in table:
                place += size
                return table[bits[place - size : place]]
        raise ValueError

    levels, dc = [], 0
    for _ in range(height // 8 * (width // 8)):
        size = symbol(tables[0x00])
        value = bits[place : place + size]
        place += size
        dc += 0 if not size else int(value, 2) if value[0] == "1" else int(value, 2) - 2**size + 1
        assert symbol(tables[0x10]) == 0  # nothing but the mean
        levels.append(round(dc * step / 8) + 128)
    return levels


def test_media_read_by_an_independent_decoder():
    payload = bytes(random.Random(1).randrange(256) for _ in range(1_500))
    data = media.pack(payload)
    assert data[:4] == b"RIFF" and data[8:12] == b"AVI " and struct.unpack("<I", data[4:8])[0] == len(data) - 8
    movi = data.index(b"movi")
    index = data.rindex(b"idx1")
    entries = [struct.unpack("<4sIII", data[index + 8 + 16 * k : index + 24 + 16 * k]) for k in range(struct.unpack("<I", data[index + 4 : index + 8])[0] // 16)]
    frames = [data[movi + at + 8 : movi + at + 8 + size] for name, _, at, size in entries if name == b"00dc"]
    assert bytes(x for f in frames for x in plain_frame(f))[: len(payload)] == payload


def test_a_real_cut_is_found():
    r = np.random.default_rng(2)
    dark, light = (np.clip(r.normal(m, 6, (30, 1024)), 0, 255).astype(np.uint8) for m in (60, 190))
    assert media.shots(np.concatenate([dark, light, dark])) == [0, 30, 60]
    assert media.shots(np.concatenate([dark, dark])) == [0]


def test_places_of_shards_computed_again(spark):
    rows = [(i % 90 or None, f"text {i * 37 % 101}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(x) for x in sharding.shuffle_into_shards(docs, shards=7, bucket_bytes=900, seed=5).collect())
    size = sum(len(t) + 16 for _, t in rows)
    buckets = -(-size // 900)
    dealt = docs.withColumn("b", F.pmod(F.xxhash64(F.lit(5), "doc_id", "text", F.lit(0).cast("long")), F.lit(buckets))).collect()
    place, want = 0, Counter()
    for b in range(buckets):
        own = sorted((x for x in dealt if x.b == b), key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.text))
        order = np.arange(len(own))
        np.random.Generator(np.random.PCG64([5, b])).shuffle(order)
        for k in order:
            shard = next(s for s in range(7) if s * 300 // 7 <= place < (s + 1) * 300 // 7)
            want[own[k].doc_id, own[k].text, shard, place - shard * 300 // 7] += 1
            place += 1
    assert got == want
