"""Queries over vectors and graphs of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import vectors as vec
from textloom.operators import corpus, graphs, relational, spaces
from textloom.operators.shared import Tables
from textloom.plans.catalogue import TURNS, _turns, query

V = "vecs as (select vec_id as id, embedding::double[] as v, vec_id // 10 as doc, label from embeddings),"
#: Word vectors of the SQL: the words of all turns by rank, one vector each as far as there are vectors.
WORD_VECTORS = "wc as (select term, count(*) as n from (select unnest(tokens) as term from turns) group by term), wid as (select term, row_number() over (order by n desc, term) - 1 as id from wc), wv as (select term, v from wid join vecs using (id)),"
CELLS = "cells as (select doc_id, pos, generate_subscripts(v, 1)::int - 1 as k, unnest(v) as x from (select doc_id, pos, unnest(tokens) as term from turns) join wv using (term)),"


def _vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.expr("vec_id div 10").alias("doc"), "label")


def _cells(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode("v").alias("k", "x")).select(*keys, "k", F.round("x", 6).alias("x"))


def _word_vectors(t) -> DataFrame:
    counts = _turns(t).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    # The rank of a word by count, then by name.
    return relational.numbered(counts, [F.desc("n"), "term"], 0).join(_vectors(t), "id").select("term", "v")


@query("with " + V + "x as (select id, generate_subscripts(v, 1)::int - 1 as k, unnest(list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-6))) as x from vecs) select id, k, round(x, 6) + 0 as x from x")
def l2_normalize(t):
    return _cells(_vectors(t).select("id", vec.normalised(F.col("v")).alias("v")), "id")


@query("with " + V + "x as (select 1) select q.id as query, e.id, round(greatest(0, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v))), 6) + 0 as s from vecs q join vecs e on q.doc = e.doc")
def cosine_clipped(t):
    q = _vectors(t).select("doc", F.col("id").alias("query"), F.col("v").alias("q"))
    return q.join(_vectors(t), "doc").select("query", "id", F.round(spaces.clipped_cosine(F.col("q"), F.col("v")), 6).alias("s"))


@query("with " + V + "x as (select a.id, list_concat(a.v, b.v) as v from vecs a join vecs b on b.id = a.id + 1) select id, generate_subscripts(v, 1)::int - 1 as k, round(unnest(v), 6) + 0 as x from x")
def concat_vectors(t):
    following = _vectors(t).select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return _cells(_vectors(t).join(following, "id").select("id", F.concat("v", "w").alias("v")), "id")


@query("with " + V + "c as (select id, generate_subscripts(v, 1)::int - 1 as k, unnest(v) as x from vecs) select a.id, a.k, round(abs(a.x - b.x), 6) + 0 as x from c a join c b on b.id = a.id + 1 and a.k = b.k union all select a.id, a.k + 64, round(a.x * b.x, 6) + 0 from c a join c b on b.id = a.id + 1 and a.k = b.k")
def pair_features(t):
    following = _vectors(t).select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return _cells(_vectors(t).join(following, "id").select("id", spaces.pair_features(F.col("v"), F.col("w")).alias("v")), "id")


@query("with " + TURNS + V + WORD_VECTORS + CELLS + "x as (select 1) select doc_id, pos, k, round(avg(x), 6) + 0 as x from cells group by all")
def sentence_mean_vectors(t):
    return spaces.sentence_vectors(_turns(t), _word_vectors(t), ["doc_id", "pos"]).select("doc_id", "pos", "k", F.round("x", 6).alias("x"))


@query("with " + TURNS + V + WORD_VECTORS + CELLS + "x as (select 1) select doc_id, pos, k, round(sum(x), 6) + 0 as x from cells group by all")
def sentence_sum_vectors(t):
    return spaces.sentence_vectors(_turns(t), _word_vectors(t), ["doc_id", "pos"], "sum").select("doc_id", "pos", "k", F.round("x", 6).alias("x"))


@query("with " + TURNS + V + WORD_VECTORS + CELLS + """m as (select doc_id, pos, k, avg(x) as x from cells group by all), n as (select doc_id, pos, sqrt(sum(x * x)) as n from m group by all),
d as (select a.doc_id, a.pos, sum(a.x * b.x) as d from m a join m b on a.doc_id = b.doc_id and b.pos = a.pos + 1 and a.k = b.k group by all)
select d.doc_id, d.pos, round(d / (a.n * b.n), 6) + 0 as s from d join n a on a.doc_id = d.doc_id and a.pos = d.pos join n b on b.doc_id = d.doc_id and b.pos = d.pos + 1""")
def sentence_similarity(t):
    turns = _turns(t)
    own = Tables(turns.sparkSession, "similarity").put(spaces.word_sums(turns, _word_vectors(t), ["doc_id", "pos"]), "own")
    following = own.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("v").alias("w"))
    a, b = vec.normalised(F.col("v"), 0.0), vec.normalised(F.col("w"), 0.0)
    return own.join(following, ["doc_id", "pos"]).select("doc_id", "pos", F.round(vec.dot(a, b), 6).alias("s"))


def _knn_sql(score: str, order: str) -> str:
    return "with " + V + f"x as (select q.id as query, e.id, {score} as s from vecs q, vecs e where q.id % 20 = 0) select query, id, round(s, 6) + 0 as s from x qualify row_number() over (partition by query order by round(s, 9) {order}, id) <= 10"


@query(_knn_sql("list_dot_product(q.v, e.v)", "desc"))
def knn_topk(t):
    found = spaces.neighbours(_vectors(t).filter("id % 20 = 0"), _vectors(t), 10)
    return found.select("query", "id", F.round("score", 6).alias("s"))


@query(_knn_sql("sqrt(greatest(0, list_dot_product(q.v, q.v) + list_dot_product(e.v, e.v) - 2 * list_dot_product(q.v, e.v)))", ""))
def knn_euclidean(t):
    found = spaces.neighbours(_vectors(t).filter("id % 20 = 0"), _vectors(t), 10, "euclidean")
    return found.select("query", "id", F.round("score", 6).alias("s"))


@query(_knn_sql("sqrt(greatest(0, list_dot_product(q.v, q.v) + list_dot_product(e.v, e.v) - 2 * list_dot_product(q.v, e.v)))", ""))
def metric_tree_knn(t):
    """The same neighbours from a metric tree, which leaves out regions that cannot hold any."""
    found = spaces.tree_neighbours(_vectors(t).filter("id % 20 = 0"), _vectors(t), 10)
    return found.select("query", "id", F.round("score", 6).alias("s"))


GRAPH = V + """sims as (select a.id as q, b.id as id, list_dot_product(a.v, b.v) as s from vecs a, vecs b where a.id <> b.id and round(list_dot_product(a.v, b.v), 9) >= case when a.doc = b.doc then 0.2 else 0.3 end),
best as (select * from sims qualify row_number() over (partition by q order by round(s, 9) desc, id) <= 20),
graph as (select least(q, id) as a, greatest(q, id) as b, max(s) as weight from best group by all),"""


def _graph(t) -> DataFrame:
    return graphs.context_graph(_vectors(t), k=20, intra=0.2, inter=0.3)


@query("with " + GRAPH + "x as (select 1) select a, b, round(weight, 6) + 0 as weight from graph")
def context_knn_graph(t):
    return _graph(t).select("a", "b", F.round("weight", 6).alias("weight"))


@query("with " + GRAPH + "e as (select a as node from graph union all select b from graph) select id as node, count(e.node) as degree from vecs left join e on e.node = vecs.id group by id")
def graph_all_nodes(t):
    return graphs.with_all_nodes(_vectors(t).select(F.col("id").alias("node")), _graph(t))


@query("""with e as (select conv_id, lag(turn) over w as a, turn as b from conversations window w as (partition by conv_id order by turn)),
u as (select conv_id, a, b from e where a is not null union all select conv_id, b, a from e where a is not null),
l as (select conv_id, a as node, list(b order by b) as n from u group by all)
select conv_id, node, array_to_string(list_concat(n, list_transform(range(0, (select max(len(n)) from l) - len(n)), lambda i: -1)), ' ') as neighbours from l""")
def padded_adjacency(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    e = t("conversations").select("conv_id", F.lag("turn").over(w).alias("a"), F.col("turn").alias("b"), F.lit(1.0).alias("weight")).filter("a is not null")
    both = e.unionByName(e.select("conv_id", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return graphs.padded_adjacency(both, ["conv_id"]).select("conv_id", "node", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ").alias("neighbours"))


@query("with " + V + "x as (select a.doc, a.id as a, b.id as b, list_dot_product(a.v, b.v) as w from vecs a join vecs b on a.doc = b.doc) select doc, a, b, round(w, 6) + 0 as weight from x where round(w, 9) >= 0.1")
def latent_doc_graph(t):
    return graphs.document_graph(_vectors(t), 0.1).select("doc", "a", "b", F.round("weight", 6).alias("weight"))


@query("with " + TURNS + """e as (select doc_id, lag(pos) over w as a, pos as b from turns window w as (partition by doc_id order by pos)),
l as (select distinct tokens[1] as src, unnest(tokens[2:]) as dst from turns)
select 'sentence' as kind, (doc_id * 1000 + a)::varchar as src, (doc_id * 1000 + b)::varchar as dst from e where a is not null union all select 'lexicon', src, dst from l""")
def synonym_graph(t):
    """The chain of turns, and each turn's words as a lexicon line: the first word with the others."""
    from textloom.sources import readers

    w = Window.partitionBy("doc_id").orderBy("pos")
    chain = _turns(t).select((F.col("doc_id") * 1000 + F.lag("pos").over(w)).alias("a"), (F.col("doc_id") * 1000 + F.col("pos")).alias("b"), F.lit(1.0).alias("weight")).filter("a is not null")
    return graphs.with_lexicon(chain, readers.star_edges(_turns(t).select("tokens"))).drop("weight")


def _retrofit_sql(rounds: int, alpha: float, weight: str) -> str:
    steps = [
        "c as (select id, doc, generate_subscripts(v, 1) as k, unnest(v) as s from vecs), e as (select doc, lag(id) over w as a, id as b from vecs window w as (partition by doc order by id)),"
        f"u as materialized (select a as id, b as o, {weight} as w from e where a is not null union all select b, a, {weight} from e where a is not null),"
        "n as materialized (select id, count(*) as n from u group by id), v0 as materialized (select id, k, s, s as v from c)"
    ]
    for r in range(1, rounds + 1):
        steps.append(
            f"g{r} as (select u.id, x.k, sum(u.w * x.v) as got from u join v{r - 1} x on x.id = u.o group by all),"
            f"v{r} as materialized (select x.id, x.k, x.s, case when n.n is null then x.s else ({alpha} * n.n * x.s + got) / ({alpha} * n.n + n.n) end as v from v{r - 1} x left join n on n.id = x.id left join g{r} g on g.id = x.id and g.k = x.k)"
        )
    return "with " + V + ", ".join(steps) + f" select id, (k - 1)::int as k, round(v, 6) + 0 as x from v{rounds}"


def _chain(t, weight: str = "1.0D") -> DataFrame:
    w = Window.partitionBy("doc").orderBy("id")
    rows = _vectors(t).select(F.col("doc").alias("g"), F.lag("id").over(w).alias("a"), F.col("id").alias("b")).filter("a is not null")
    return rows.withColumn("weight", F.expr(weight).cast("double"))


@query(_retrofit_sql(20, 1.0, "1.0"))
def retrofit_sequential(t):
    """Twenty rounds over the chains of ten vectors each."""
    values = _vectors(t).select(F.col("doc").alias("g"), "id", "v")
    return _cells(graphs.retrofit_groups(values, _chain(t)).select("id", "v"), "id")


@query(_retrofit_sql(20, 2.0, "0.5 + (b % 3) / 4.0"))
def retrofit_weighted(t):
    values = _vectors(t).select(F.col("doc").alias("g"), "id", "v")
    return _cells(graphs.retrofit_groups(values, _chain(t, "0.5 + (b % 3) / 4.0"), alpha=2.0).select("id", "v"), "id")


@query()
def random_walks(t):
    edges = Tables(t("embeddings").sparkSession, "graph").put(_graph(t), "edges")
    return graphs.random_walks(edges, per_node=2, length=4).select("start", "walk", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"))


@query()
def spherical_kmeans(t):
    return spaces.spherical_kmeans(_vectors(t).select("id", "v"), 10)


@query()
def vocabulary_expansion(t):
    """Vectors mapped to those of their successors by least squares."""
    following = _vectors(t).select((F.col("id") - 1).alias("id"), F.col("v").alias("y"))
    matrix = spaces.linear_map(_vectors(t).join(following, "id").select(F.col("v").alias("x"), "y"))
    return _cells(spaces.apply_map(_vectors(t).select("id", "v"), matrix), "id")


@query()
def diverse_summary(t):
    turns = _turns(t)
    edges = corpus.similarity_edges(turns, 0.1)
    return graphs.diverse_ranks(corpus.pagerank(turns.select("doc_id", F.col("pos").alias("node")), edges), edges, 0.7)
