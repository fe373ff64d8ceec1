"""Queries on tokens, vocabularies and the SELECT builder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import stem
from textloom.functions import text as tx
from textloom.operators import relational, tokens
from textloom.plans.catalogue import SENTENCES, TURNS, _turns, query

VOCAB = "wc as (select term, count(*) as n from (select unnest(tokens) as term from turns) group by term having count(*) >= 5), ids as (select term, row_number() over (order by n desc, term) + 1 as id from wc),"


def _ids(t) -> DataFrame:
    counts = _turns(t).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return relational.numbered(counts, [F.desc("n"), "term"], 2).select("term", "id")


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias(column)


@query("with " + SENTENCES + "x as (select 1) select doc_id, pos, trim(replace(replace(replace(replace(sentence, chr(2), ''), chr(3), ''), chr(13), ''), chr(10), ' '), ' ') as sentence from sents")
def cleaned_sentences(t):
    return t("documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "s")).select("doc_id", "pos", tx.cleaned(F.col("s")).alias("sentence"))


@query("with " + TURNS + VOCAB + "ww as (select doc_id, pos, generate_subscripts(tokens, 1) as place, unnest(tokens) as term from turns), e as (select doc_id, pos, string_agg(coalesce(id, 1), ' ' order by place) as ids from ww left join ids using (term) group by all) select doc_id, pos, coalesce(ids, '') as ids from turns left join e using (doc_id, pos)")
def encode_unknown(t):
    return tokens.encoded(_turns(t), _ids(t), ["doc_id", "pos"]).select("doc_id", "pos", _joined("ids"))


@query("with " + TURNS + VOCAB + "ww as (select doc_id, pos, generate_subscripts(tokens, 1) as place, unnest(tokens) as term from turns), e as (select doc_id, pos, string_agg(id, ' ' order by place) as ids from ww join ids using (term) group by all) select doc_id, pos, coalesce(ids, '') as ids from turns left join e using (doc_id, pos)")
def encode_known(t):
    return tokens.encoded(_turns(t), _ids(t), ["doc_id", "pos"], None).select("doc_id", "pos", _joined("ids"))


@query("with " + TURNS + "ww as (select unnest(tokens) as term from turns) select term, count(*) as n from ww where regexp_full_match(term, '\\p{L}+') group by term")
def alpha_vocabulary(t):
    return _turns(t).select(F.explode("tokens").alias("term")).filter(F.col("term").rlike(r"^\p{L}+$")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("with " + TURNS + "p as (select doc_id, pos, tokens, lead(tokens) over (partition by doc_id order by pos) as following from turns) select doc_id, pos, array_to_string(list_filter(following, lambda x: not list_contains(tokens, x)), ' ') as target from p where following is not null")
def no_overlap(t):
    following = F.lead("tokens").over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = _turns(t).withColumn("following", following).filter("following is not null")
    return rows.select("doc_id", "pos", F.array_join(tokens.without_shared(F.col("following"), F.col("tokens")), " ").alias("target"))


@query("with l as (select lang, row_number() over (order by lang) - 1 as label from (select distinct lang from documents)) select doc_id, label, array_to_string(list_transform(range(0, (select count(*) from l)), lambda i: case when i = label then 1 else 0 end), '') as one_hot from documents join l using (lang)")
def label_encoding(t):
    names = sorted(r["lang"] for r in t("documents").select("lang").distinct().dropna().collect())  # the classes
    label = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")) - 1
    one_hot = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.when(i == F.col("label"), "1").otherwise("0")), "")
    return t("documents").withColumn("label", label.cast("long")).select("doc_id", "label", one_hot.alias("one_hot"))


@query("select doc_id, array_to_string(string_split(text, ' ')[1:100], ' ') as text from documents")
def word_limit(t):
    return t("documents").select("doc_id", tokens.first_words(F.col("text"), 100).alias("text"))


@query("with r as (select conv_id, turn, list_filter(string_split(regexp_replace(regexp_replace(replace(lower(text), '-', ' - '), '[^a-z0-9-]', ' ', 'g'), ' +', ' ', 'g'), ' '), lambda x: regexp_matches(x, '^[a-z0-9$]')) as w from conversations) select conv_id, turn, array_to_string(w, ' ') as tokens from r")
def rouge_tokens(t):
    return t("conversations").select("conv_id", "turn", F.array_join(tokens.evaluation_tokens(F.col("text")), " ").alias("tokens"))


CHOSEN = "m as (select doc_id, pos, tokens, list_transform(list_sort(list_transform(range(0, len(tokens)), lambda i: {'h': md5(doc_id || ':' || pos || '-' || i), 'i': i}))[1:round(len(tokens) * 0.3, 0)::int], lambda p: p.i) as c from turns)"


@query("with " + TURNS + CHOSEN + " select doc_id, pos, array_to_string(list_transform(range(0, len(tokens)), lambda i: case when list_contains(c, i) then '<unk>' else tokens[i + 1] end), ' ') as tokens from m")
def corrupt_mask(t):
    key = F.concat_ws(":", "doc_id", "pos")
    return _turns(t).select("doc_id", "pos", F.array_join(tokens.masked(F.col("tokens"), 0.3, key), " ").alias("tokens"))


@query("with " + TURNS + CHOSEN + " select doc_id, pos, array_to_string(list_transform(list_filter(range(0, len(tokens)), lambda i: not list_contains(c, i)), lambda i: tokens[i + 1]), ' ') as tokens from m")
def corrupt_remove(t):
    key = F.concat_ws(":", "doc_id", "pos")
    return _turns(t).select("doc_id", "pos", F.array_join(tokens.removed(F.col("tokens"), 0.3, key), " ").alias("tokens"))


@query()
def corrupt_swap(t):
    key = F.concat_ws(":", "doc_id", "pos")
    return _turns(t).select("doc_id", "pos", F.array_join(tokens.swapped(F.col("tokens"), 0.3, key), " ").alias("tokens"))


@query()
def stemmed_tokens(t):
    return _turns(t).select("doc_id", "pos", F.array_join(stem.stemmed(F.col("tokens")), " ").alias("tokens"))


@query()
def huffman_codes(t):
    return tokens.huffman_codes(_turns(t).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))


# Relational


@query("select d.lang, count(*) as n from documents d, labels l where d.doc_id = l.doc_id and l.quality = 1 group by d.lang")
def select_builder(t):
    d, l = t("documents"), t("labels")  # noqa: E741
    return relational.select(d.sparkSession, {"d": d, "l": l}, ["d.lang", "count(*) as n"], [("d.doc_id", "=", "l.doc_id"), ("l.quality", "=", "1")], ["d.lang"], ["d.lang"])


@query("select doc_id from documents where (lang = 'en' or source like 'src1%') and not n_chars < 100")
def free_condition(t):
    d = t("documents")
    return relational.select(d.sparkSession, {"d": d}, ["d.doc_id"], [("(d.lang", "=", "'en'"), ("or",), ("d.source", "like", "'src1%')"), ("and not",), ("d.n_chars", "<", "100")])


@query("select d.doc_id, l.quality, case d.doc_id % 5 when 0 then 'test' else 'train' end as part from documents d join labels l using (doc_id) where d.doc_id % 5 in (0, 1, 2)")
def valid_variant(t):
    """Training rows YES, and the VALID rows to test them with."""
    istrain = F.when(F.col("doc_id") % 5 == 0, "VALID").when(F.col("doc_id") % 5 < 3, "YES").otherwise("NO")
    rows = t("documents").select("doc_id", istrain.alias("istrain")).join(t("labels").select("doc_id", "quality"), "doc_id")
    train = rows.filter("istrain = 'YES'").select("doc_id", "quality", F.lit("train").alias("part"))
    return train.unionByName(rows.filter("istrain = 'VALID'").select("doc_id", "quality", F.lit("test").alias("part")))


@query("select d.doc_id, d.lang, d.n_chars, l.quality, l.toxic from documents d full join labels l using (doc_id)")
def frame_concat(t):
    return t("documents").select("doc_id", "lang", "n_chars").join(t("labels").select("doc_id", "quality", "toxic"), "doc_id", "full")


@query("with n as (select count(*) as n from documents), o as (select doc_id, lang, row_number() over (order by doc_id) as place from documents), d as (select i as draw, ('0x' || substr(md5(i || '-2000'), 1, 8))::bigint % n + 1 as place from range(0, 1000) r(i), n) select draw, doc_id, lang from d join o using (place)")
def sample_replaced(t):
    return tokens.sample_with_replacement(t("documents").select("doc_id", "lang"), "doc_id", 1000).orderBy("lang", "draw")
