"""Reader rules over texts that are put together from the tables, and the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.catalogue import query
from textloom.sources import readers

MAIL = "'From: ' || source || chr(10) || chr(10) || '> quoted' || chr(10) || lang || ' wrote: this' || chr(10) || 'body ' || doc_id || chr(10) || '--' || chr(10) || 'sig'"


def _files(rows: DataFrame, path: Column, value: Column) -> DataFrame:
    return rows.select(path.alias("path"), value.alias("value"))


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""select 'YES' as istrain, doc_id, 'sci' as category, 'body ' || doc_id as content from documents where doc_id % 3 = 0
union all select 'NO', doc_id, 'rec', 'body ' || doc_id from documents where doc_id % 3 = 1""")
def newsgroup_reader(t):
    """Every third document's folder is a topic that is not read."""
    k, i = F.col("doc_id") % 3, F.col("doc_id")
    folder = F.when(k == 0, "20news-bydate-train/sci.med").when(k == 1, "20news-bydate-test/rec.autos").otherwise("20news-bydate-train/misc.forsale")
    value = _cat("From: ", F.col("source"), "\n\n> quoted\n", F.col("lang"), " wrote: this\nbody ", i, "\n--\nsig")
    found = readers.parse_newsgroups(_files(t("documents"), _cat("/", folder, "/", i), value))
    return found.select("istrain", F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "category", "content")


def _wire(t) -> DataFrame:
    i, k = F.col("doc_id"), F.col("doc_id") % 5
    topics = F.when(k == 0, "<D>zinc</D><D>acq</D>").when(k == 1, "<D>corn</D>").when(k == 2, "").otherwise("<D>ship</D><D>earn</D>")
    value = _cat(
        '<!DOCTYPE x>\n<REUTERS TOPICS="', F.when(k == 4, "NO").otherwise("YES"), '" LEWISSPLIT="', F.when(i % 2 == 0, "TRAIN").otherwise("TEST"), '" CGISPLIT="c" OLDID="7" NEWID="', i,
        '">\n<TOPICS>', topics, "</TOPICS><PLACES><D>", F.col("lang"), "</D></PLACES><PEOPLE></PEOPLE>\n<TEXT>&#2;<TITLE>t", i, "</TITLE><BODY>b &lt; ", F.col("source"), "</BODY></TEXT></REUTERS>",
    )
    return readers.parse_newswire(_files(t("documents"), F.lit("/a.sgm"), value))


@query("""select doc_id::varchar as newid, 't' || doc_id as title, case doc_id % 5 when 0 then 'acq' else 'ship' end as topic, case when doc_id % 2 = 0 then 'YES' else 'NO' end as istrain,
'OLDID:7^TOPICS:YES^CGISPLIT:c^LEWISSPLIT:' || case when doc_id % 2 = 0 then 'TRAIN' else 'TEST' end as metadata from documents where doc_id % 5 in (0, 3)""")
def newswire_reader(t):
    return _wire(t).select("newid", "title", "topic", "istrain", "metadata")


@query("""with k as (select doc_id::varchar as newid, doc_id % 5 as k, lang from documents where doc_id % 5 in (0, 3))
select newid, 'places' as category, lang as name from k union all select newid, 'topics', unnest(case k when 0 then ['zinc', 'acq'] else ['ship', 'earn'] end) from k""")
def newswire_tags(t):
    return readers.document_tags(_wire(t))


LONG = "length(text) - length(replace(text, '.', '')) between 1 and 1000 and len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) >= 100 and not contains(text, '<') and not contains(text, '&')"


def _summarised(t) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    clean = t("documents").filter(~F.contains("text", F.lit("<")) & ~F.contains("text", F.lit("&")))
    gold = _cat('<SUM DOCSET="d" SUMMARIZER="', i % 7, '" DOCREF="', i, '">', F.repeat(F.lit("word "), (50 + 25 * (i % 4)).cast("int")), "</SUM>")
    gold = readers.parse_gold_summaries(_files(clean, F.lit("/perdocs"), F.concat(gold, gold)))
    return readers.parse_summarised_documents(_files(clean, _cat("/d/", i), _cat("<DOC><TEXT>", F.col("text"), "</TEXT></DOC>")), gold), gold


@query(f"select doc_id::varchar as filename from documents where doc_id % 4 >= 2 and {LONG}")
def summarised_reader(t):
    return _summarised(t)[0].select("filename")


@query(f"select doc_id::varchar as filename, trim(repeat('word ', (50 + 25 * (doc_id % 4))::int)) as summary, 20 as method_id, 'SUMMARIZER:' || (doc_id % 7) as metadata from documents where doc_id % 4 >= 2 and {LONG}")
def gold_summaries(t):
    documents, gold = _summarised(t)
    return readers.gold_of_documents(gold, documents)


@query("""select page_id, case page_id % 4 when 0 then 'YES' when 1 then 'MAYBE' else 'NO' end as istrain from pages where page_id % 4 < 3""")
def review_reader(t):
    k, i = F.col("page_id") % 4, F.col("page_id")
    folder = F.when(k == 0, "train/pos").when(k == 1, "train/unsup").when(k == 2, "test/neg").otherwise("test/unsup")
    found = readers.parse_reviews(_files(t("pages"), _cat("/", folder, "/", i), F.col("html")))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("page_id"), "istrain")


@query("select doc_id, (generate_subscripts(p, 1) - 1)::int as line_no, unnest(p) as content from (select doc_id, regexp_split_to_array(text, '\\r?\\n') as p from documents)")
def line_review_reader(t):
    found = readers.parse_line_reviews(_files(t("documents"), _cat("/train/pos/", F.col("doc_id")), F.col("text")))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "line_no", "content")


def _pairs(t) -> DataFrame:
    i = F.col("doc_id")
    line = _cat("pair_ID\tsentence_A\tsentence_B\tlabel\tscore\tset\n", i, "\tfirst ", F.col("lang"), "\tsecond ", F.col("source"), "\tX\t", (i % 9) / 2, "\t", F.when(i % 3 == 0, "TRAIN").when(i % 3 == 1, "TEST").otherwise("TRIAL"), "\n")
    return readers.parse_pairs(_files(t("documents"), F.lit("/SICK.txt"), line))


@query("select doc_id::varchar as pair_id, 'first ' || lang as sent1, 'second ' || source as sent2, (doc_id % 9) / 2.0 as score, case doc_id % 3 when 0 then 'TRAIN' when 1 then 'TEST' else 'TRIAL' end as split from documents")
def pair_reader(t):
    return _pairs(t)


@query("select doc_id::varchar as pair_id, side, case side when 0 then 'first ' || lang else 'second ' || source end as content, case doc_id % 3 when 0 then 'TRAIN' when 1 then 'TEST' else 'TRIAL' end as topic from documents, (values (0), (1)) s(side)")
def pair_documents(t):
    return readers.pair_documents(_pairs(t))


def _treebank(t, ways: int) -> DataFrame:
    i, d = F.col("doc_id"), t("documents")
    splits = _files(d, F.lit("/s"), _cat("sentence_index,splitset_label\n", i, ",", i % 3 + 1, "\n"))
    sentences = _files(d, F.lit("/t"), _cat("sentence_index\tsentence\n", i, "\tA ", F.col("lang"), ", b\n"))
    sentiments = _files(d.filter("doc_id % 7 > 0"), F.lit("/v"), _cat(i, "\t", (i % 11) / 10, "\n"))
    return readers.parse_treebank(splits, sentences, sentiments, ways)


TREEBANK = "x as (select doc_id as id, 'A ' || lang || ', b' as content, (doc_id % 11) / 10.0 as v, case doc_id % 3 when 0 then 'YES' when 1 then 'NO' else 'VALID' end as istrain from documents where doc_id % 7 > 0)"


@query(f"with {TREEBANK} select id, content, case when v <= 0.4 then 'ng' else 'pos' end as topic, istrain from x where v <= 0.4 or v > 0.6")
def treebank_2way(t):
    return _treebank(t, 2)


@query(f"with {TREEBANK} select id, content, case when v <= 0.2 then 'vng' when v <= 0.4 then 'ng' when v <= 0.6 then 'ntrl' when v <= 0.8 then 'pos' else 'vpos' end as topic, istrain from x")
def treebank_5way(t):
    return _treebank(t, 5)


@query("select 'w' || vec_id as term, generate_subscripts(v, 1)::int - 1 as k, unnest(v) as x from (select vec_id, embedding::double[] as v from embeddings)")
def vector_reader(t):
    lines = t("embeddings").select(_cat("w", F.col("vec_id"), " ", F.array_join(F.transform(F.col("embedding").cast("array<double>"), lambda x: x.cast("string")), " ")).alias("value"))
    header = lines.limit(1).select(F.lit("9 64").alias("value"))
    return readers.parse_vectors(header.unionByName(lines)).select("term", F.posexplode("v").alias("k", "x"))


@query("with k as (select doc_id, row_number() over (order by md5(doc_id::varchar || '-2000') || '-' || doc_id) as n from documents where doc_id % 2 = 0) select d.doc_id, case when d.doc_id % 2 = 1 then 'NO' when n <= (select round_even(count(*) * 0.2, 0) from k) then 'VALID' else 'YES' end as istrain from documents d left join k using (doc_id)")
def validation_override(t):
    rows = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "YES").otherwise("NO").alias("istrain"))
    return readers.with_validation(rows, "doc_id")
