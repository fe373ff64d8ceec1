"""SimHash components against all pairs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import simhash
from textloom.llm.common import Scratch

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_fingerprint(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in BLANKS else c for c in lower).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: list[int], budget: int = 3) -> list[int]:
    root = list(range(len(fps)))
    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= budget and root[i] != root[j]:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    return root


def corpus() -> list[str | None]:
    r = random.Random(5)
    words = [f"W{i}é" if i % 9 == 0 else f"w{i}" for i in range(500)]
    made: list[str | None] = [None, "", "   ", "a", "A", "a b", "a\tB", "a b c", "\x1fa\x1fb", "x\xa0y z q"]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randrange(80, 300))]
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(words)
            made.append(r.choice([" ", "\n", "  "]).join(copy))
    return made + ["same text of three words"] * 40 + ["long " * 40_000]


def test_documents_equal_all_pairs(spark):
    texts = corpus()
    ids = random.Random(1).sample(range(10_000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, fp string").repartition(3)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    root = plain_components(fps)
    least = {r: min(ids[i] for i in range(len(ids)) if root[i] == r) for r in set(root)}
    assert got == {d: (f"{f:016x}", least[r]) for d, f, r in zip(ids, fps, root)}
    assert 25 < len(set(root)) < len(texts) - 100


@pytest.mark.parametrize("blocks, part, task", [(4, 1 << 16, 1 << 17), (5, 40, 300), (4, 30, 1 << 17), (6, 1 << 16, 100)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, blocks, part, task):
    monkeypatch.setattr(simhash, "PART_LEAVES", part)
    monkeypatch.setattr(simhash, "TASK_LEAVES", task)
    monkeypatch.setattr(simhash, "PAIRS", 64)
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 4)
    r = random.Random(blocks + part)
    found = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 30])):
            x = base
            for _ in range(r.randrange(0, 6)):
                x ^= 1 << r.randrange(64)
            found.add(x)
    fps = sorted(found)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.trie_links(spark.createDataFrame([(s,) for s in signed], "fp long"), Scratch(spark, "test"), blocks=blocks).collect()
    root = plain_components(fps)
    at = {s: i for i, s in enumerate(signed)}
    mine = list(range(len(fps)))
    for a, b in links:
        old, new = mine[at[a]], mine[at[b]]
        mine = [new if m == old else m for m in mine]
    assert Counter(Counter(root).values()) == Counter(Counter(mine).values())
    assert len(set(zip(root, mine))) == len(set(root))


def test_pairs_of_close_leaves_are_complete_and_pruned():
    r = random.Random(8)
    fps = sorted({r.getrandbits(64) ^ (1 << r.randrange(64)) for _ in range(2000)} | {i ^ (i << 7) for i in range(300)})
    x = np.array(fps, np.uint64)
    starts = tuple(np.array([v]) for v in (0, len(x), 0, len(x)))
    got = {(int(a), int(b)) for aa, bb in simhash.close_leaves(x, starts, 0, 3) for a, b in zip(aa, bb)}
    assert got == {(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3}


def test_null_ids_repeats_and_an_empty_table(spark):
    rows = [(None, "a b c d"), (None, "solitary words stand here alone"), (5, "a b c d"), (5, "a b c d"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(x) for x in simhash.near_duplicates(docs).select("doc_id", "component_id").collect())
    assert got == Counter([(None, 5), (None, None), (5, 5), (5, 5), (None, None)])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    named = simhash.near_duplicates(docs.withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string"))))
    assert {x.component_id for x in named.collect()} == {"id5", None}
