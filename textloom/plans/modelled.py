"""Queries over counted language models and their scores, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import language
from textloom.plans.catalogue import TURNS, WORDS, _turns, _words, query

#: Pairs of following words of documents (``seen``) and of turns (``asked``), the sentence's end as ''.
PAIRS = (
    WORDS.rstrip() + TURNS.split("tc as")[0]
    + """
b as (select list_concat([''], coalesce(tokens, [])) as p, list_concat(coalesce(tokens, []), ['']) as q from dtok),
seen as (select before, term, count(*) as n from (select unnest(p) as before, unnest(q) as term from b) group by all),
totals as (select before, sum(n) as total from seen group by before),
known as (select distinct term from seen),
tb as (select doc_id, list_concat([''], coalesce(tokens, [])) as p, list_concat(coalesce(tokens, []), ['']) as q from turns),
asked as (select doc_id, before, term, count(*) as times from (select doc_id, unnest(p) as before, unnest(q) as term from tb) group by all),
met as (select a.doc_id, a.before, a.term, a.times, (coalesce(n, 0) + 0.5::double) / (coalesce(total, 0) + 0.5::double * (select count(*) from known)) as p
  from asked a join known using (term) left join seen s on s.before = a.before and s.term = a.term left join totals t on t.before = a.before)
"""
)


def _as_sentences(rows, key: str):
    return rows.select(F.col(key).alias("id"), "tokens")


def _bigrams(t):
    return language.bigram_probabilities(_as_sentences(_turns(t), "doc_id"), _as_sentences(_words(t), "doc_id"), 0.5)


@query("with " + PAIRS + "select before, term, sum(times)::bigint as times, round(any_value(p), 12) as p from met group by before, term")
def bigram_probabilities(t):
    """Every pair of following words in the turns, by the counts of all documents; words that no document has are left out."""
    return _bigrams(t).filter("p is not null").select("before", "term", "times", F.round("p", 12).alias("p"))


@query("with " + PAIRS + "select sum(times)::bigint as words, round(sum(log10(p) * times), 4) as log_p, round(pow(10, -sum(log10(p) * times) / sum(times)), 6) as perplexity from met")
def bigram_perplexity(t):
    return language.score(_bigrams(t)).select("words", F.round("log_p", 4).alias("log_p"), F.round("perplexity", 6).alias("perplexity"))


@query(
    "with " + PAIRS + ", c as (select doc_id, before, term, times, p from met), a as (select doc_id, sum(times)::bigint as words, sum(log10(p) * times) as l, sum(log10(0.25 * (0.5::double / 4) + 0.75 * p) * times) as x from c group by doc_id)"
    " select doc_id, words, round(pow(10, -l / words), 6) as other_perplexity, round(pow(10, -x / words), 6) as mixed_perplexity from a"
)
def mixed_bigrams(t):
    """Each conversation by bigrams, and mixed with a model that gives every word one in eight."""
    turns = _turns(t).select("doc_id", F.struct("doc_id", "pos").alias("id"), "tokens")
    words = language.with_bigrams(turns, _bigrams(t)).filter("other is not null").select(F.col("id.doc_id").alias("doc_id"), F.lit(0.125).alias("p"), "other")
    scored = language.score(words, ["doc_id"], 0.25)
    return scored.select("doc_id", "words", F.round("other_perplexity", 6).alias("other_perplexity"), F.round("mixed_perplexity", 6).alias("mixed_perplexity"))


@query("with " + PAIRS + "select doc_id, count(*) as n, round(sum(times / 1024.0::double), 6) as total from asked group by doc_id")
def printed_probabilities(t):
    """Lines as another tool prints them, made of every conversation's pairs and their counts, read back."""
    turns = _as_sentences(_turns(t), "doc_id")
    pairs = language._pairs(turns).groupBy("id", "before", "term").agg(F.count(F.lit(1)).alias("times"))
    shown = F.format_string("\tp( %s | %s ) \t= [2gram] %s [ 0 ]", "term", "before", (F.col("times") / 1024.0).cast("string"))
    lines = pairs.select(F.col("id").alias("doc_id"), F.explode(F.array(shown, F.format_string("%d words", "times"))).alias("value"))
    return language.printed_probabilities(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 6).alias("total"))
