"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import vectors as vec
from textloom.operators import corpus, relational

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common tables of the SQL: sentences, and sentences with more than two words.
SENTENCES = r"""
pieces as (select doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) as p from documents),
sents as (select doc_id, (generate_subscripts(p, 1) - 1)::int as pos, unnest(p) as sentence from pieces),
toks as (select *, list_filter(string_split(regexp_replace(regexp_replace(lower(sentence), '<br />', ' ', 'g'), '[[:punct:]\s]+', ' ', 'g'), ' '), lambda x: x <> '') as tokens from sents),
good as (select * from toks where len(tokens) > 2),
"""
WORDS = """
dtok as (select doc_id, list_filter(string_split(regexp_replace(regexp_replace(lower(text), '<br />', ' ', 'g'), '[[:punct:]\\s]+', ' ', 'g'), ' '), lambda x: x <> '') as tokens from documents),
vocab as (select term, count(*) as n from (select unnest(tokens) as term from dtok) group by term),
"""
TURNS = """
turns as (select conv_id as doc_id, turn::int as pos, list_filter(string_split(regexp_replace(regexp_replace(lower(text), '<br />', ' ', 'g'), '[[:punct:]\\s]+', ' ', 'g'), ' '), lambda x: x <> '') as tokens from conversations),
tc as (select doc_id, pos, term, count(*) as n from (select doc_id, pos, unnest(tokens) as term from turns) group by all),
tf as (select *, n / max(n) over (partition by doc_id, pos) as tf from tc),
tot as (select doc_id, count(*) as total from turns group by doc_id),
idf as (select doc_id, term, ln(any_value(total) / (count(*) + 1)) as idf from tf join tot using (doc_id) group by doc_id, term),
w as (select doc_id, pos, term, n, tf * idf as w from tf join idf using (doc_id, term)),
norms as (select doc_id, pos, sqrt(sum(n * w * w)) as norm from w group by all),
raw as (select x.doc_id, x.pos as a, y.pos as b, sum(x.w * y.w) as s from w x join w y using (doc_id, term) group by all),
edges as (select r.doc_id, a, b, s / (na.norm * nb.norm) as weight from raw r join norms na on na.doc_id = r.doc_id and na.pos = a
  join norms nb on nb.doc_id = r.doc_id and nb.pos = b where na.norm > 0 and nb.norm > 0 and round(s / (na.norm * nb.norm), 9) > 0.1),
"""


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _sentences(t) -> DataFrame:
    return corpus.sentence_table(t("documents"))


def _words(t) -> DataFrame:
    return t("documents").select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


def _vocabulary(t) -> DataFrame:
    return _words(t).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _turns(t) -> DataFrame:
    return t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pos"), tx.tokens(F.col("text")).alias("tokens"))


def _vectors(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.summarise(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES["summarise_documents"] = FLAGSHIP


# Text


@query("with " + SENTENCES + "x as (select 1) select doc_id, pos, sentence from good")
def seg_sentences(t):
    return _sentences(t).select("doc_id", "pos", "sentence")


@query("select doc_id, (generate_subscripts(p, 1) - 1)::int as pos, unnest(p) as paragraph from (select doc_id, string_split(text, chr(10)) as p from documents)")
def seg_paragraphs(t):
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "paragraph"))


@query("with " + SENTENCES + "x as (select 1) select doc_id, pos, array_to_string(tokens, ' ') as tokens from toks")
def norm_tokens(t):
    pieces = t("documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    return pieces.select("doc_id", "pos", F.array_join(tx.tokens(F.col("sentence")), " ").alias("tokens"))


@query("with " + SENTENCES + "x as (select 1) select doc_id, pos, len(tokens)::int as n from good where len(tokens) >= 4")
def short_sentence_filter(t):
    return _sentences(t).select("doc_id", "pos", F.size("tokens").alias("n")).filter("n >= 4")


@query("select doc_id, case when instr(m, chr(10) || chr(10)) > 0 then substr(m, instr(m, chr(10) || chr(10)) + 2) else '' end as body from (select doc_id, 'From: a' || chr(10) || chr(10) || text as m from documents)")
def strip_header(t):
    return t("documents").select("doc_id", tx.without_header(F.concat(F.lit("From: a\n\n"), "text")).alias("body"))


@query("select page_id, array_to_string(list_filter(string_split(html, chr(10)), lambda x: not regexp_matches(x, '(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\\||^>)')), chr(10)) as body from pages")
def strip_quotes(t):
    return t("pages").select("page_id", tx.without_quotes(F.col("html")).alias("body"))


@query("""with l as (select doc_id, string_split(trim(text || chr(10) || '--' || chr(10) || 'sig', ' '), chr(10)) as p, trim(text || chr(10) || '--' || chr(10) || 'sig', ' ') as whole from documents),
m as (select *, list_max(list_transform(range(0, len(p)), lambda i: case when trim(replace(p[i + 1], '-', ''), ' ') = '' then i else 0 end)) as cut from l)
select doc_id, case when cut > 0 then array_to_string(p[1:cut], chr(10)) else whole end as body from m""")
def strip_footer(t):
    return t("documents").select("doc_id", tx.without_footer(F.concat("text", F.lit("\n--\nsig"))).alias("body"))


@query("""with a as (select page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') as x from pages)
select page_id, replace(replace(replace(replace(x, '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', '"'), '&amp;', '&') as body from a""")
def html_text(t):
    return t("pages").select("page_id", tx.html_text(F.col("html")).alias("body"))


@query("with " + WORDS + "x as (select 1) select term, n from vocab")
def vocab_count(t):
    return _vocabulary(t)


@query("with " + WORDS + "x as (select 1) select term, n from vocab where n >= 5")
def vocab_prune(t):
    return _vocabulary(t).filter("n >= 5")


@query("with " + WORDS + "x as (select 1) select term, n, row_number() over (order by n desc, term) + 1 as id from vocab where n >= 20")
def vocab_index(t):
    """Ids from running totals over ranges of the order, so that the words of a frequent count are not one task's."""
    return relational.numbered(_vocabulary(t).filter("n >= 20"), [F.desc("n"), "term"], 2)


@query("with " + WORDS + "x as (select 1) select term, n, round((sqrt(n / (0.0001 * s)) + 1) * (0.0001 * s) / n, 6) as keep from vocab, (select sum(n)::double as s from vocab)")
def subsample_prob(t):
    v = _vocabulary(t)
    total = F.col("s") * 0.0001
    return v.crossJoin(F.broadcast(v.agg(F.sum("n").cast("double").alias("s")))).select("term", "n", F.round((F.sqrt(F.col("n") / total) + 1) * total / F.col("n"), 6).alias("keep"))


@query("with " + WORDS.replace("vocab as (", "vocab as materialized (") + "x as materialized (select sum(pow(n, 0.75)) as s from vocab) select term, round(pow(n, 0.75) / s, 9) as p from vocab, x")
def unigram_pow75(t):
    v = _vocabulary(t).withColumn("w", F.pow("n", F.lit(0.75)))
    return v.crossJoin(F.broadcast(v.agg(F.sum("w").alias("s")))).select("term", F.round(F.col("w") / F.col("s"), 9).alias("p"))


@query("with " + TURNS + "g as (select doc_id, pos, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) as gram from turns) select gram, count(*) as n from g group by gram")
def ngrams(t):
    rows = _turns(t).withColumn("k", F.lit(0))
    return corpus.gram_counts(rows, "k", 2).select("gram", "n")


@query("with " + TURNS + "i as (select doc_id, pos, generate_subscripts(tokens, 1) as k, unnest(tokens) as x from turns) select a.x || ' ' || b.x as gram, count(*) as n from i a join i b on a.doc_id = b.doc_id and a.pos = b.pos and b.k > a.k and b.k <= a.k + 3 group by gram")
def skip_bigrams(t):
    return corpus.skip_bigram_counts(_turns(t).withColumn("k", F.lit(0)), "k", 2).select("gram", "n")


@query("select conv_id, turn, text, lead(text) over w as following, lag(text) over w as previous from conversations window w as (partition by conv_id order by turn)")
def context_triples(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("following"), F.lag("text").over(w).alias("previous"))


@query("with " + TURNS + "x as (select 1) select doc_id, pos, array_to_string(list_concat(list_transform(range(0, greatest(9 - len(tokens), 0)), lambda i: 'null'), tokens), ' ') as padded from turns")
def null_pad(t):
    pad = F.array_repeat(F.lit("null"), F.greatest(9 - F.size("tokens"), F.lit(0)))
    return _turns(t).select("doc_id", "pos", F.array_join(F.concat(pad, "tokens"), " ").alias("padded"))


@query("with " + TURNS + "x as (select 1) select len(tokens)::int as length, count(*) as n from turns group by length")
def same_length_groups(t):
    return _turns(t).groupBy(F.size("tokens").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("with " + TURNS + "x as (select 1) select doc_id, pos, array_to_string(list_concat(list_transform(range(0, greatest(12 - len(tokens), 0)), lambda i: '0'), list_slice(tokens, greatest(len(tokens) - 11, 1), len(tokens))), ' ') as padded from turns")
def pad_ids(t):
    n = F.size("tokens")
    pad = F.array_repeat(F.lit("0"), F.greatest(12 - n, F.lit(0)))
    return _turns(t).select("doc_id", "pos", F.array_join(F.concat(pad, F.slice("tokens", F.greatest(n - 11, F.lit(1)), F.lit(12))), " ").alias("padded"))


# Relational


@query("select distinct lang as topic, source as category from documents")
def topic_from_source(t):
    return t("documents").select(F.col("lang").alias("topic"), F.col("source").alias("category")).distinct()


@query("with t as (select lang, source, row_number() over (order by lang, source) as topic_id from (select distinct lang, source from documents)) select doc_id, topic_id from documents join t using (lang, source)")
def doc_topic_bridge(t):
    topics = t("documents").select("lang", "source").distinct().withColumn("topic_id", F.row_number().over(Window.orderBy("lang", "source")).cast("long"))
    return t("documents").select("doc_id", "lang", "source").join(topics, ["lang", "source"]).select("doc_id", "topic_id")


@query("select doc_id, case doc_id % 3 when 1 then 'YES' when 2 then 'NO' else 'VALID' end as istrain from documents")
def split_map(t):
    k = F.col("doc_id") % 3
    return t("documents").select("doc_id", F.when(k == 1, "YES").when(k == 2, "NO").otherwise("VALID").alias("istrain"))


@query("select event_id, case when v <= 0.4 then 'ng' else 'pos' end as category from (select event_id, (event_id % 101) / 100.0 as v from events) where v <= 0.4 or v > 0.6")
def sentiment_bins_2way(t):
    v = (F.col("event_id") % 101) / 100.0
    return t("events").select("event_id", v.alias("v")).filter("v <= 0.4 or v > 0.6").select("event_id", F.when(F.col("v") <= 0.4, "ng").otherwise("pos").alias("category"))


@query("select event_id, case when v <= 0.2 then 'vng' when v <= 0.4 then 'ng' when v <= 0.6 then 'ntrl' when v <= 0.8 then 'pos' else 'vpos' end as category from (select event_id, (event_id % 101) / 100.0 as v from events)")
def sentiment_bins_5way(t):
    v = F.col("v")
    bins = F.when(v <= 0.2, "vng").when(v <= 0.4, "ng").when(v <= 0.6, "ntrl").when(v <= 0.8, "pos").otherwise("vpos")
    return t("events").select("event_id", ((F.col("event_id") % 101) / 100.0).alias("v")).select("event_id", bins.alias("category"))


def _order_by_hash() -> Column:
    return F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-2000")))


@query("select doc_id from documents order by md5(doc_id::varchar || '-2000'), doc_id limit (select (count(*) * 0.2)::bigint from documents where doc_id % 5 >= 0)")
def valid_split(t):
    n = t("documents").count()
    return t("documents").orderBy(_order_by_hash(), "doc_id").limit(round(n * 0.2)).select("doc_id")


@query("select doc_id from documents order by md5(doc_id::varchar || '-2000'), doc_id limit 50")
def random_k_docs(t):
    return t("documents").orderBy(_order_by_hash(), "doc_id").limit(50).select("doc_id")


@query("select d.doc_id, d.lang, l.quality from documents d join labels l using (doc_id) where l.quality = 1 and d.lang = 'en'")
def eval_join_2way(t):
    return t("documents").select("doc_id", "lang").filter("lang = 'en'").join(t("labels").filter("quality = 1").select("doc_id", "quality"), "doc_id")


@query("select distinct o.o_orderkey from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey where n.n_name in ('NATION_7', 'NATION_12')")
def system_docs_3way(t):
    n = t("nation").filter(F.col("n_name").isin("NATION_7", "NATION_12"))
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey").distinct()


@query("select distinct c.c_custkey, r.r_name from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey")
def gold_docs_4way(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "r_name").distinct()


@query("select doc_id, source from documents where source like 'src1%' and lang <> 'en'")
def like_filter(t):
    return t("documents").filter(F.col("source").like("src1%") & (F.col("lang") != "en")).select("doc_id", "source")


@query("select doc_id from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id)")
def anti_valid(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti")


@query("select doc_id from documents where exists (select 1 from labels l where l.doc_id = documents.doc_id and l.toxic = 1)")
def semi_gold(t):
    return t("documents").select("doc_id").join(t("labels").filter("toxic = 1"), "doc_id", "left_semi")


@query("select count(*) as n, count(distinct source) as sources from documents")
def count_docs(t):
    return t("documents").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query("select conv_id, string_agg(role, ',' order by turn) as roles from conversations group by conv_id")
def ordered_children(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["role"]), ",").alias("roles"))


@query("select source, count(*) filter (lang = 'de') as de, count(*) filter (lang = 'en') as en, count(*) filter (lang = 'es') as es, count(*) filter (lang = 'fr') as fr from documents group by source")
def pivot_runs(t):
    return t("documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("select lang, round(avg(n_chars), 6) as mean, count(*) as n from documents group by lang")
def mean_over_groups(t):
    return t("documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) as best from lineitem group by l_orderkey")
def argmax_params(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("best"))


# Ranking


@query("with " + TURNS + "x as (select 1) select doc_id, pos, term, round(tf, 6) as tf from tf")
def tf_max(t):
    return corpus.term_frequency(_turns(t)).select("doc_id", "pos", "term", F.round("tf", 6).alias("tf"))


@query("with " + TURNS + "x as (select 1) select doc_id, term, round(idf, 6) as idf from idf")
def idf_doc(t):
    return corpus.inverse_frequency(corpus.term_frequency(_turns(t)), _turns(t)).select("doc_id", "term", F.round("idf", 6).alias("idf"))


@query("with " + TURNS + "x as (select 1) select doc_id, a, b, round(weight, 6) as weight from edges")
def tfidf_edges(t):
    return corpus.similarity_edges(_turns(t), 0.1).select("doc_id", "a", "b", F.round("weight", 6).alias("weight"))


def _pagerank_sql(rounds: int) -> str:
    steps = "\n".join(
        f"r{k} as materialized (select n.doc_id, n.node, n.n, n.dangling, 0.15 / n.n + 0.85 * (coalesce(f.got, 0) + n.lost / n.n) as rank from "
        f"(select *, sum(case when dangling then rank else 0 end) over (partition by doc_id) as lost from r{k - 1}) n left join "
        f"(select r.doc_id, s.b as node, sum(r.rank * s.p) as got from r{k - 1} r join steps s on s.doc_id = r.doc_id and s.a = r.node group by all) f on f.doc_id = n.doc_id and f.node = n.node),"
        for k in range(1, rounds + 1)
    )
    return "with " + TURNS + (
        "steps as materialized (select doc_id, a, b, weight / sum(weight) over (partition by doc_id, a) as p from edges),"
        "r0 as materialized (select doc_id, pos as node, count(*) over (partition by doc_id) as n, not exists (select 1 from steps s where s.doc_id = t.doc_id and s.a = t.pos) as dangling, "
        "1.0 / count(*) over (partition by doc_id) as rank from turns t)," + steps
    )


@query(_pagerank_sql(10) + " x as (select 1) select doc_id, node, round(rank, 6) as rank from r10")
def pagerank_tfidf(t):
    turns = _turns(t)
    ranks = corpus.pagerank(turns.select("doc_id", F.col("pos").alias("node")), corpus.similarity_edges(turns, 0.1))
    return ranks.select("doc_id", "node", F.round("rank", 6).alias("rank"))


@query(
    _pagerank_sql(10)
    + " k as (select doc_id, node, row_number() over (partition by doc_id order by round(rank, 9) desc, node) as position, count(*) over (partition by doc_id) as n from r10)"
    " select doc_id, node, position::int as position from k where position <= ceil(round(n * 0.2, 9))"
)
def summary_topfrac(t):
    turns = _turns(t)
    return corpus.summary(corpus.pagerank(turns.select("doc_id", F.col("pos").alias("node")), corpus.similarity_edges(turns, 0.1)), 0.2)


@query("with " + SENTENCES + "x as (select 1) select d.doc_id, coalesce(min(pos), -1) as pos from documents d left join good g on g.doc_id = d.doc_id group by d.doc_id")
def first_sentence(t):
    firsts = _sentences(t).groupBy("doc_id").agg(F.min("pos").alias("pos"))
    return t("documents").select("doc_id").distinct().join(firsts, "doc_id", "left").select("doc_id", F.coalesce("pos", F.lit(-1)).alias("pos"))


# Vectors


@query("select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.v, b.v), 6) as s from (select vec_id, vec_id // 10 as d, embedding::double[] as v from embeddings) a join (select vec_id, vec_id // 10 as d, embedding::double[] as v from embeddings) b on a.d = b.d and a.vec_id < b.vec_id")
def inner_pairs(t):
    v = _vectors(t).withColumn("d", F.expr("vec_id div 10"))
    a, b = v.select("d", F.col("vec_id").alias("a"), F.col("v").alias("x")), v.select("d", F.col("vec_id").alias("b"), F.col("v").alias("y"))
    return a.join(b, "d").filter("a < b").select("a", "b", F.round(vec.dot(F.col("x"), F.col("y")), 6).alias("s"))


@query("select label, k, round(avg(x), 6) as mean from (select label, generate_subscripts(v, 1) - 1 as k, unnest(v) as x from (select label, embedding::double[] as v from embeddings)) group by label, k")
def mean_vectors(t):
    return _vectors(t).select("label", F.posexplode("v").alias("p", "x")).groupBy("label", F.col("p").cast("long").alias("k")).agg(F.round(F.avg("x"), 6).alias("mean"))


# Graphs


@query("select conv_id, lag(turn) over w as a, turn as b from conversations window w as (partition by conv_id order by turn) qualify lag(turn) over w is not null")
def chain_graph(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", F.lag("turn").over(w).alias("a"), F.col("turn").alias("b")).filter("a is not null")


@query("select conv_id, turn, coalesce(lag(turn) over w, -1) as previous, coalesce(lead(turn) over w, -1) as following from conversations window w as (partition by conv_id order by turn)")
def prev_next(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.coalesce(F.lag("turn").over(w), F.lit(-1)).alias("previous"), F.coalesce(F.lead("turn").over(w), F.lit(-1)).alias("following"))


@query("with " + TURNS + "x as (select 1) select doc_id, count(*) as edges, count(distinct a) as nodes from edges group by doc_id")
def graph_stats(t):
    return corpus.similarity_edges(_turns(t), 0.1).groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("a").alias("nodes"))


@query("with " + TURNS + "x as (select 1) select doc_id, a, b, round(weight / sum(weight) over (partition by doc_id, a), 6) as p from edges")
def transition_first(t):
    e = corpus.similarity_edges(_turns(t), 0.1)
    return e.select("doc_id", "a", "b", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("doc_id", "a")), 6).alias("p"))


# ROUGE and metrics


def _predictions(t) -> DataFrame:
    """True and predicted class of labelled documents: quality against a length rule."""
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"))


PREDICTIONS = "p as (select quality as y, (n_chars > 1000)::int as p from labels join documents using (doc_id)),"


@query("with " + PREDICTIONS + "x as (select 1) select y, p, count(*) as n from p group by y, p")
def confusion(t):
    return _predictions(t).groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))


@query("with " + PREDICTIONS + "x as (select 1) select round(avg((y = p)::int), 6) as accuracy from p")
def accuracy(t):
    return _predictions(t).agg(F.round(F.avg((F.col("y") == F.col("p")).cast("int")), 6).alias("accuracy"))


@query("with " + PREDICTIONS + "x as (select 1) select c as label, round(sum((y = c and p = c)::int) / nullif(sum((p = c)::int), 0), 4) as precision, round(sum((y = c and p = c)::int) / nullif(sum((y = c)::int), 0), 4) as recall, sum((y = c)::int)::bigint as support from p, (values (0), (1)) v(c) group by c")
def prf(t):
    classes = F.explode(F.array(F.lit(0), F.lit(1))).alias("label")
    hit = lambda c: F.sum(c.cast("int"))
    y, p, c = F.col("y"), F.col("p"), F.col("label")
    both = hit((y == c) & (p == c))
    return _predictions(t).select("y", "p", classes).groupBy("label").agg(F.round(both / F.nullif(hit(p == c), F.lit(0)), 4).alias("precision"), F.round(both / F.nullif(hit(y == c), F.lit(0)), 4).alias("recall"), hit(y == c).alias("support"))


@query("with " + PREDICTIONS + "s as (select avg((y = p)::int) as po, avg(y) * avg(p) + (1 - avg(y)) * (1 - avg(p)) as pe from p) select round((po - pe) / (1 - pe), 6) as kappa from s")
def kappa(t):
    s = _predictions(t).agg(F.avg((F.col("y") == F.col("p")).cast("int")).alias("po"), F.avg("y").alias("a"), F.avg("p").alias("b"))
    pe = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return s.select(F.round((F.col("po") - pe) / (1 - pe), 6).alias("kappa"))


@query("select round(corr(l_quantity, l_extendedprice), 6) as r, round(avg(pow(l_discount - l_tax, 2)), 6) as mse from lineitem")
def pearson_mse(t):
    return t("lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.avg(F.pow(F.col("l_discount") - F.col("l_tax"), 2)), 6).alias("mse"))


@query("select v.i as item, k.k as class, round(case when k.k = floor(v.y) + 1 then v.y - floor(v.y) when k.k = floor(v.y) then floor(v.y) - v.y + 1 else 0 end, 6) as mass from (select event_id as i, 1 + (event_id % 40) / 10.0 as y from events) v, (select unnest([1, 2, 3, 4, 5]) as k) k")
def sts_soft_labels(t):
    y = 1 + (F.col("event_id") % 40) / 10.0
    rows = t("events").select(F.col("event_id").alias("item"), y.alias("y"), F.explode(F.array(*[F.lit(k) for k in range(1, 6)])).alias("class"))
    low = F.floor("y")
    mass = F.when(F.col("class") == low + 1, F.col("y") - low).when(F.col("class") == low, low - F.col("y") + 1).otherwise(0.0)
    return rows.select("item", "class", F.round(mass, 6).alias("mass"))


@query("with p as (select l_quantity as x, l_extendedprice as y from lineitem), r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as x, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as y from p) select round(corr(x, y), 6) as rho from r")
def spearman(t):
    """Correlation of average ranks; ranks come from the distinct values' counts, so rows are never sorted in one task."""
    rows = t("lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    for c in ("x", "y"):
        rows = rows.join(corpus.average_ranks(rows, c), c)
    return rows.agg(F.round(F.corr("rank_x", "rank_y"), 6).alias("rho"))


CONTINGENCY = """
c as (select lang as y, source as p, count(*)::double as n from documents where lang is not null and source is not null group by all),
z as (select sum(n) as total from c),
a as (select y, sum(n) as n from c group by y), b as (select p, sum(n) as n from c group by p),
h as (select (select -sum(n / total * ln(n / total)) from a, z) as hy, (select -sum(n / total * ln(n / total)) from b, z) as hp,
  (select -sum(c.n / total * ln(c.n / b.n)) from c join b using (p), z) as hy_p, (select -sum(c.n / total * ln(c.n / a.n)) from c join a using (y), z) as hp_y),
s as (select case when hy = 0 then 1 else 1 - hy_p / hy end as hom, case when hp = 0 then 1 else 1 - hp_y / hp end as com from h)
"""


@query("with " + CONTINGENCY + "select round(hom, 6) as homogeneity, round(com, 6) as completeness, round(case when hom + com = 0 then 0 else 2 * hom * com / (hom + com) end, 6) as v_measure from s")
def v_measure(t):
    return corpus.v_measure(t("documents").select(F.col("lang").alias("y"), F.col("source").alias("p")))


EDGES = "e as (select conv_id as g, lag(turn) over w as a, turn as b from conversations window w as (partition by conv_id order by turn)), u as (select g, a, b from e where a is not null union all select g, b, a from e where a is not null)"


@query(f"""with {EDGES}, d as (select distinct g, a, b from u),
c as (select x.g, x.a as previous, x.b as node, y.b as following, case when y.b = x.a then 1 / 0.4 when z.a is not null then 1.0 else 1 / 0.5 end as w
  from d x join d y on y.g = x.g and y.a = x.b left join d z on z.g = x.g and z.a = x.a and z.b = y.b)
select g, previous, node, following, round(w / sum(w) over (partition by g, previous, node), 6) as p from c""")
def transition_second(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    edges = t("conversations").select(F.col("conv_id").alias("g"), F.lag("turn").over(w).alias("a"), F.col("turn").alias("b"), F.lit(1.0).alias("weight")).filter("a is not null")
    return corpus.second_order_transitions(edges, p=0.4, q=0.5).select("g", "previous", "node", "following", F.round("p", 6).alias("p"))
