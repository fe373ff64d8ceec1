"""The divergence audit against plain loops over every term of every source."""

import random
import re
from collections import Counter, defaultdict

import pytest

from textloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, min_docs=3, top=200):
    terms_of = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = terms_of(text)
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pair = [(sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept), x) for x in sources if x != s]
            own = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", own, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def corpus(seed=4, n=400):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("al", "Be", "çé", "δ", "x") for b in "abcdefghijk"] + ["it's", "re-do", "naïve", "x_y", "12ab34", "\U0001f600", "İ"]
    rows = [(i, r.choice([" ", ", ", "\n"]).join(r.choice(words[: r.randrange(5, len(words))]) for _ in range(r.randrange(0, 40))), r.choice(["en", "de", None, "xx"]), r.choice(["s1", "S2", "é3", None, "s5"])) for i in range(n)]
    return rows + [(1000, None, "en", "s1"), (1001, "", "empty", "s1"), (1002, "solo", "empty", None), (1003, "!!! 123", "en", "nothing"), (1004, "al" * 50_000, "en", "s1")] + [rows[0]] * 9


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_loops(spark, monkeypatch, small):
    if small:  # many blocks, weighted copies, large sources dealt out, tiles of sources, several tasks, short chunks of pairs
        for name, value in (("BLOCK_BYTES", 2_000), ("HOT_COPIES", 4), ("TILE_SOURCES", 2), ("TASK_POSTINGS", 100), ("PAIRS", 50)):
            monkeypatch.setattr(divergence, name, value)
    rows = corpus() + [(5000 + i, "hot copy of Al", "en", "s1") for i in range(60 if small else 3)]
    docs = spark.createDataFrame([(*x, "y") for x in rows], SCHEMA + ", term string").repartition(3)
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_ranks_stop_at_top_and_ties_go_by_bytes(spark):
    rows = [(k, " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)), "en", s) for k, s in enumerate(["a", "a", "a"])] + [(9, "other words", "en", "b")]
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA), top=20).collect()))
    assert got == plain(rows, top=20)
    assert len([x for x in got if x[2] == "term" and x[1] == "a"]) in (0, 20)


def test_an_empty_table_and_no_kept_terms(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b", "en", "s"), (2, "c", "en", "t"), (3, None, None, None)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect())) == plain(rows)
