"""Rules of the training-corpus readers over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import relational
from textloom.plans.catalogue import query
from textloom.sources import corpora

SQL_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')"
SQL_PUNCT = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0D\x20]+'"


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias(column)


@query(f"""with w as (select doc_id, {SQL_WORDS} as w from documents), k as (select doc_id, w, unnest(range(0, ceil(len(w) / 100.0)::bigint)) as chunk from w)
select doc_id, chunk, array_to_string(w[chunk * 100 + 1 : chunk * 100 + 100], ' ') as tokens from k""")
def fixed_chunks(t):
    """Whole texts cut every 100 words."""
    rows = corpora.chunked(t("documents").select("doc_id", corpora.words(F.col("text")).alias("tokens")), "tokens", 100)
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), _joined("tokens"))


@query(f"""with p as (select doc_id, regexp_extract_all(coalesce(text, ''), {SQL_PUNCT}) as w from documents),
v as (select term, row_number() over (order by n desc, term) + 1 as id from (select term, count(*) as n from (select unnest(w) as term from p) group by term having count(*) >= 5)),
e as (select doc_id, generate_subscripts(w, 1) as place, unnest(w) as term from p),
j as (select doc_id, string_agg(case when id < 5000 then id else 1 end, ' ' order by place) as ids from e left join v using (term) group by doc_id)
select doc_id, doc_id // 128 as batch, coalesce(ids, '') as ids from p left join j using (doc_id)""")
def numbered_texts(t):
    """Each document as a line of word numbers, those from 5,000 on and rare words as 1."""
    lines = t("documents").select(F.col("doc_id").alias("line"), F.col("text").alias("value"))
    counts = lines.select(F.explode(corpora.word_punct(F.col("value"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    ids = relational.numbered(counts, [F.desc("n"), "term"], 2).select("term", "id")
    return corpora.numbered_lines(lines, ids, most=5_000).select(F.col("line").alias("doc_id"), "batch", _joined("ids"))


@query(f"""with l as (select conv_id, turn, translate(text, chr(9) || chr(10), '  ') as a, translate(lead(text) over (partition by conv_id order by turn), chr(9) || chr(10), '  ') as b from conversations),
p as (select conv_id, turn, regexp_extract_all(lower(a), {SQL_PUNCT}) as a, regexp_extract_all(lower(b), {SQL_PUNCT}) as b from l where b is not null and a is not null)
select conv_id * 1048576 + turn as line, array_to_string(a, ' ') as a, array_to_string(b, ' ') as b from p where len(a) <= 20 or len(b) <= 20""")
def paraphrase_lines(t):
    """Adjacent turns as the fields of one line, pairs of two long ones left out."""
    rows = t("conversations").select("conv_id", "turn", F.translate("text", "\t\n", "  ").alias("s"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("next"))
    lines = rows.join(after, ["conv_id", "turn"]).filter("s is not null and next is not null")
    value = F.concat_ws("\t", F.lit("1"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), "s", "next")
    found = corpora.paraphrases(lines.select((F.col("conv_id") * 1048576 + F.col("turn")).alias("line"), value.alias("value")), 20)
    return found.select("line", _joined("a"), _joined("b"))


@query(f"""with w as (select doc_id, list_filter({SQL_WORDS}, lambda x: not contains(x, '/')) as w from documents)
select doc_id, array_to_string(list_transform(list_filter(w, lambda x: regexp_matches(x, '^[a-z]')), lambda x: lower(x) || '/nn'), ' ') as tokens from w""")
def tagged_lines(t):
    """Words that begin with a small letter are tagged as nouns of some length, all others as signs, which are left out."""
    tagged = F.transform(corpora.words(F.col("text")), lambda w: F.concat(w, F.when(w.rlike("^[a-z]"), F.concat(F.lit("/nn"), F.length(w).cast("string"))).otherwise("/.")))
    rows = t("documents").select("doc_id", corpora.tagged_words(F.array_join(tagged, " ")).alias("tokens"))
    return rows.select("doc_id", _joined("tokens"))
