"""Fingerprints against a plain walk, classes of near-copies against all pairs."""

import itertools
import random

from textloom.llm import fingerprints

M64 = (1 << 64) - 1


def mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


GOLDEN, SEED, PERIOD = 0x9E3779B97F4A7C15, 7, 4096


def plain_walk(text: str) -> list[int]:
    """The character written at each step, one step after the other."""
    written, i, j = [], 0, 0
    codes = [ord(c) for c in text]
    while i < len(codes):
        written.append(codes[i])
        at = j % PERIOD
        moves = at == PERIOD - 1 or mix(((codes[i] & 255) * PERIOD + at + (SEED * 2 + 1) * GOLDEN) & M64) >> 40 & 1
        i, j = i + bool(moves), j + 1
    return written


def plain_fingerprint(text: str) -> str:
    written = plain_walk(text)
    level = 0
    while len(written) >> (level + 1) >= 96:
        level += 1
    picked = [c for j, c in enumerate(written) if mix((j * GOLDEN + SEED) & M64) & ((1 << level) - 1) == 0]
    return f"{level:x}:" + "".join("0123456789abcdef"[mix(c + SEED * 31 + 1) & 15] for c in picked)


def texts() -> list[str]:
    r = random.Random(11)
    found = ["", "a", "é世界🙂", "ab " * 4_000]
    for _ in range(12):
        base = [r.choice("abcdefghij") * 2 + str(r.randrange(100)) for _ in range(150)]
        for edits in (0, 1, 2, 6, 40):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = "edit"
            found.append(" ".join(copy))
    return found


def test_fingerprints_equal_a_plain_walk():
    own = texts()
    assert fingerprints.fingerprint_texts(own) == [plain_fingerprint(t) for t in own]


def test_edits_move_few_steps():
    """Likeness falls with edits, and the sampled one is near that of all steps."""
    walker, r = fingerprints.Walker(), random.Random(3)
    base = [r.choice("abcdefghij") * 2 + str(r.randrange(100)) for _ in range(400)]
    for edits, least in ((1, 0.93), (4, 0.8)):
        copy = list(base)
        for _ in range(edits):
            copy[r.randrange(len(copy))] = "edit"
        a, b = " ".join(base), " ".join(copy)
        x, y = plain_walk(a), plain_walk(b)
        whole = sum(p == q for p, q in zip(x, y)) / max(len(x), len(y))
        assert whole > least - 0.05 and abs(fingerprints.likeness(walker, *fingerprints.fingerprint_texts([a, b])) - whole) < 0.15


def components(n, links):
    root = list(range(n))
    for a, b in links:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if x == old else x for x in root]
    return root


def test_classes_against_all_pairs(spark, monkeypatch):
    own = texts() + texts()[6:20] + [None]
    ids = random.Random(1).sample(range(1_000), len(own))
    docs = spark.createDataFrame(list(zip(ids, own, own)), "doc_id long, text string, least string").repartition(3)
    walker = fingerprints.Walker()
    prints = fingerprints.fingerprint_texts([t or "" for t in own])
    close = [(i, j) for i, j in itertools.combinations(range(len(own)), 2) if fingerprints.likeness(walker, prints[i], prints[j]) >= 0.8]
    root = components(len(own), close)
    for part in (4_096, 3):
        monkeypatch.setattr(fingerprints, "PART", part)
        got = {x.doc_id: (x.fingerprint, x.class_id) for x in fingerprints.near_classes(docs).collect()}
        assert {d: p for d, (p, _) in got.items()} == dict(zip(ids, prints))
        # No class joins what links do not, and nine in ten of the links are within a class.
        for i, j in itertools.combinations(range(len(own)), 2):
            assert root[i] == root[j] or got[ids[i]][1] != got[ids[j]][1]
        assert sum(got[ids[i]][1] == got[ids[j]][1] for i, j in close) >= 0.9 * len(close) > 20
        assert all(c == min(d for d, (_, k) in got.items() if k == c) for _, c in got.values())
    assert fingerprints.near_classes(docs.limit(0)).count() == 0


def test_links_join_all_that_are_alike():
    r = random.Random(9)
    walker = fingerprints.Walker()
    base = "".join(r.choice("0123456789abcdef") for _ in range(120))
    prints = sorted({"0:" + "".join(r.choice("0123456789abcdef") if r.random() < p else c for c in base) for p in (0.02, 0.1, 0.15, 0.25, 0.5) for _ in range(12)} | {"1:" + base[:100]})
    for level in (0, 1):
        close = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if max(int(prints[k][0], 16) for k in (i, j)) == level and fingerprints.likeness(walker, prints[i], prints[j]) >= 0.8]
        got = fingerprints.linked(walker, prints, level, 0.8) if level else fingerprints.linked(walker, [p for p in prints if p[0] == "0"], 0, 0.8)
        assert components(len(prints), close) == components(len(prints), got)
