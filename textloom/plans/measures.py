"""Queries of overlap scores, classification and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import corpus, models, rouge, spaces
from textloom.plans.catalogue import PREDICTIONS, _predictions, query
from textloom.plans.spaces import _vectors

C = "c as (select conv_id, turn, list_filter(string_split(regexp_replace(regexp_replace(lower(text), '<br />', ' ', 'g'), '[[:punct:]\\s]+', ' ', 'g'), ' '), lambda x: x <> '') as tokens from conversations),"
HITS = """t as (select conv_id, turn, sum(n) as t from g group by all),
h as (select a.conv_id, a.turn, sum(least(a.n, b.n)) as hit from g a join g b on a.conv_id = b.conv_id and b.turn = a.turn + 1 and a.gram = b.gram group by all),
k as (select p.conv_id, p.turn, coalesce(hit, 0) as hit, p.t as peer, m.t as model from t p join t m on m.conv_id = p.conv_id and m.turn = p.turn + 1 left join h on h.conv_id = p.conv_id and h.turn = p.turn),
s as (select *, round(hit / model, 5) as recall, round(hit / peer, 5) as precision, round(case when hit > 0 then 2 * (hit / model) * (hit / peer) / (hit / model + hit / peer) else 0 end, 5) as f1 from k)
"""


def _gram_sql(n: int) -> str:
    gram = " || ' ' || ".join(f"tokens[i + {k}]" for k in range(n))
    return f"g as (select conv_id, turn, gram, count(*) as n from (select conv_id, turn, unnest(list_transform(range(1, len(tokens) - {n - 2}), lambda i: {gram})) as gram from c) group by all),"


SKIP = "i as (select conv_id, turn, generate_subscripts(tokens, 1) as k, unnest(tokens) as x from c), b as (select a.conv_id, a.turn, a.x || ' ' || b.x as gram from i a join i b on a.conv_id = b.conv_id and a.turn = b.turn and b.k > a.k and b.k <= a.k + 5),"
ROWS = " select conv_id, turn, recall, precision, f1 from s"


def _turn_pairs(t) -> tuple[DataFrame, DataFrame]:
    """Every turn as a peer, and the turn after it as its model."""
    c = t("conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("tokens"))
    return c.select(F.struct("conv_id", "turn").alias("pair"), "tokens"), c.select(F.struct("conv_id", (F.col("turn") - 1).cast(c.schema["turn"].dataType).alias("turn")).alias("pair"), "tokens")


def _scored(hits: DataFrame) -> DataFrame:
    return rouge.scores(hits).select("pair.conv_id", "pair.turn", "recall", "precision", "f1")


def _n(t, n: int) -> DataFrame:
    return rouge.common_units(*_turn_pairs(t), "pair", corpus.grams(n))


@query("with " + C + _gram_sql(1) + HITS + ROWS)
def rouge_1(t):
    return _scored(_n(t, 1))


@query("with " + C + _gram_sql(2) + HITS + ROWS)
def rouge_2(t):
    return _scored(_n(t, 2))


@query("with " + C + _gram_sql(3) + HITS + ROWS)
def rouge_3(t):
    return _scored(_n(t, 3))


@query("with " + C + _gram_sql(4) + HITS + ROWS)
def rouge_4(t):
    return _scored(_n(t, 4))


@query("with " + C + SKIP + "g as (select conv_id, turn, gram, count(*) as n from b group by all)," + HITS + ROWS)
def rouge_s(t):
    return _scored(rouge.common_units(*_turn_pairs(t), "pair", corpus.skip_bigrams(4)))


@query("with " + C + SKIP + "g as (select conv_id, turn, gram, count(*) as n from (select * from b union all select conv_id, turn, unnest(tokens) from c) group by all)," + HITS + ROWS)
def rouge_su(t):
    return _scored(rouge.common_units(*_turn_pairs(t), "pair", F.concat(corpus.skip_bigrams(4), corpus.grams(1))))


@query("with " + C + "g as (select conv_id, turn, gram, count(*) as n from (select conv_id, turn, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || '|' || tokens[i + 1])) as gram from c) group by all)," + HITS + ROWS)
def rouge_be(t):
    """Basic elements put together from neighbouring words; heads and modifiers count."""
    last = F.size("tokens") - 1
    lines = F.when(last >= 1, F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.concat_ws("|", F.get("tokens", i), F.get("tokens", i + 1), F.lit("next")))).otherwise(F.array().cast("array<string>"))
    return _scored(rouge.common_units(*_turn_pairs(t), "pair", rouge.be_units(lines)))


@query("with " + C + _gram_sql(1) + HITS + """select round(avg(recall), 5) as mean_recall, round(avg(precision), 5) as mean_precision, round(avg(f1), 5) as mean_f1, round(sum(hit) / sum(model), 5) as recall, round(sum(hit) / sum(peer), 5) as precision,
round(2 * (sum(hit) / sum(model)) * (sum(hit) / sum(peer)) / (sum(hit) / sum(model) + sum(hit) / sum(peer)), 5) as f1, sum(hit)::bigint as hit, sum(peer)::bigint as peer, sum(model)::bigint as model from s""")
def rouge_averages(t):
    return rouge.averages(_n(t, 1))


def _key(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "recall")


@query("with " + C + _gram_sql(1) + HITS + """, o as (select recall, row_number() over (order by conv_id * 1000 + turn) as place from s), n as (select count(*) as n from s),
d as (select i // n as resample, ('0x' || substr(md5(i::varchar), 1, 8))::bigint % n + 1 as place from n, range(0, 100 * (select n from n)) r(i)),
m as (select resample, avg(recall) as m from d join o using (place) group by resample)
select round(avg(m), 5) as mean, round(quantile_cont(m, 0.025), 5) as low, round(quantile_cont(m, 0.975), 5) as high from m""")
def rouge_bootstrap(t):
    found = rouge.bootstrap(_key(_scored(_n(t, 1))), "recall", "key", resamples=100)
    return found.select(*[F.round(c, 5).alias(c) for c in ("mean", "low", "high")])


def _sentence_pairs(t) -> DataFrame:
    c = t("conversations").select("conv_id", "turn", F.transform(tx.sentences(F.col("text")), tx.tokens).alias("s"))
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("model"))
    return c.withColumnRenamed("s", "peer").join(following, ["conv_id", "turn"])


@query()
def rouge_l(t):
    return rouge.sequence_scores(_sentence_pairs(t))


@query()
def rouge_w(t):
    return rouge.sequence_scores(_sentence_pairs(t), rouge.RUN_WEIGHT)


REPORT = PREDICTIONS + """c as (select distinct y as c from p union select distinct p from p),
e as (select c, (select count(*) from p where p = c and y = c) as hit, (select count(*) from p where p = c) as said, (select count(*) from p where y = c) as support from c),
r as (select c, support, case when said > 0 then hit / said else 0 end as p, case when support > 0 then hit / support else 0 end as r from e),
f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from r)
"""


@query("with " + REPORT + """select c::varchar as label, round(p, 4) as precision, round(r, 4) as recall, round(f, 4) as f1, support from f
union all select 'weighted', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4), round(sum(f * support) / sum(support), 4), sum(support) from f
union all select 'macro', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), sum(support) from f""")
def classification_report(t):
    return models.classification_report(_predictions(t).select(F.col("y").alias("label"), F.col("p").alias("predicted")))


@query("with m as (select arg_max(label, (n, -label)) as predicted from (select label, count(*) as n from embeddings where vec_id % 5 <> 0 group by label)) select vec_id as id, label, predicted from embeddings, m where vec_id % 5 = 0")
def majority_class(t):
    return models.majority(_vectors(t).filter("id % 5 <> 0"), _vectors(t).filter("id % 5 = 0"))


@query()
def classify_vectors(t):
    return models.classify_vectors(_vectors(t).filter("id % 5 <> 0"), _vectors(t).filter("id % 5 = 0"))


@query()
def classify_texts(t):
    docs = t("documents").join(t("labels").select("doc_id", F.col("quality").alias("label")), "doc_id").select(F.col("doc_id").alias("id"), "text", "label")
    return models.classify_texts(docs.filter("id % 5 <> 0"), docs.filter("id % 5 = 0"))


@query()
def kmeans_clusters(t):
    return models.cluster(_vectors(t).select("id", "v"), 10, starts=3)


@query()
def adjusted_mutual_information(t):
    d = t("documents")
    value = models.adjusted_mutual_information(d.select(F.col("lang").alias("y"), F.col("source").alias("p")))
    return d.sparkSession.createDataFrame([(value,)], "adjusted_mutual_information double")


@query()
def similarity_regression(t):
    """Pairs of neighbouring vectors; their score grows with their cosine."""
    v = _vectors(t)
    following = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    pairs = v.join(following, "id").select("id", spaces.pair_features(F.col("v"), F.col("w")).alias("v"), (1 + 4 * spaces.clipped_cosine(F.col("v"), F.col("w"))).alias("score"))
    return models.regress_similarity(pairs.filter("id % 5 <> 0"), pairs.filter("id % 5 = 0")).select("id", "score", "predicted")
