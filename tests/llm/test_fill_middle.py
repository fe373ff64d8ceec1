"""Fill-in-the-middle against a plain loop, grammars against their own regexes."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import fill_middle
from textloom.llm.fill_middle import CHARACTERS, LINES, TOKENS, WORDS, Grammar, Part

SCHEMA = "doc_id long, text string"


def texts() -> list[str | None]:
    r = random.Random(3)
    made = ["".join(r.choice("ab \n\té\U0001f600<PSM>\r\x0b\x1f\xa0") for _ in range(r.randrange(0, 40))) for _ in range(300)]
    return [None, "", " ", "  a", "a  ", "a", "\n\n", "x<P>y", "<S>", "<", "a <", "a <P", "\U0001f600 \U0001f601", *made, "word " * 30_000]


def plain(doc_id, text, seed=42):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_equals_a_plain_loop_and_is_restored(spark):
    rows = [(None if i % 50 == 49 else i, t) for i, t in enumerate(texts())] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = fill_middle.fill_in_middle(docs).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {x.form for x in got} == {"plain", "psm", "spm"}
    for x in got:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plain(x.doc_id, x.text)
        assert x.again == (x.text or "")


@pytest.mark.parametrize("grammar", [TOKENS, WORDS, LINES, CHARACTERS, Grammar((Part("0-9"), Part("a-z"), Part("^0-9a-z", many=False)))])
def test_units_are_the_matches_of_the_grammar(spark, grammar):
    docs = spark.createDataFrame([(t,) for t in [*texts(), "a1b22cc;;d.", "12ab", "ab12"]], "text string")
    for text, got in docs.select("text", fill_middle.units(F.col("text"), grammar).alias("u")).collect():
        assert got == [m[0] for m in re.finditer(grammar.regex(), text or "")]
        assert "".join(got) == (text or "")


def test_clashing_columns_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "x", "y")], "doc_id long, text string, N long, form string, row string")
    got = fill_middle.fill_in_middle(docs)
    assert got.columns == [*docs.columns, "n_", "form_", "prefix_chars", "middle_chars", "output"]
    assert tuple(got.first())[:5] == (1, "a b c", 7, "x", "y") and got.first()["n_"] == 3
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    always = fill_middle.fill_in_middle(docs, percent=100, suffix_first_percent=0, seed=1).first()
    assert always["form_"] == "psm" and always["output"].startswith("<P>")


def test_text_ids_and_nothing_is_shuffled(spark):
    docs = spark.createDataFrame([("a-1", "x y")], "doc_id string, text string")
    got = fill_middle.fill_in_middle(docs)
    assert tuple(got.first())[2:] == plain("a-1", "x y")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
