"""Queries over learned vectors.  Learning has no SQL; the learners are held against plain loops in tests/test_learners.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import snowball
from textloom.functions import text as tx
from textloom.operators import corpus, language, learners, neural, recurrent, relational, runners, tokens
from textloom.operators.sgd import Settings
from textloom.operators.shared import Tables
from textloom.plans.catalogue import _turns, query
from textloom.plans.spaces import _vectors
from textloom.sources import readers

#: Small vectors and few passes; all texts are read whole.
QUICK = Settings(dims=16, window=8, epochs=2, batch=512, block_words=50_000)


def _kept(rows: DataFrame, name: str, short: bool = False) -> DataFrame:
    return Tables(rows.sparkSession, "query").put(rows, name, short=short)


def _spoken(t) -> DataFrame:
    """Turns as sentences, stemmed: ``id, doc, pos, tokens``."""
    rows = t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("pos"), snowball.normalised(F.coalesce("text", F.lit(""))).alias("tokens"))
    return _kept(rows.select((F.col("doc") * (1 << 20) + F.col("pos")).alias("id"), "doc", "pos", "tokens"), "turns")


def _sentences(t) -> DataFrame:
    """The sentences of all documents: ``id, doc, pos, tokens``."""
    rows = corpus.sentence_table(t("documents")).select(F.col("doc_id").alias("doc"), "pos", "tokens")
    return _kept(rows.select((F.col("doc") * (1 << 24) + F.col("pos")).alias("id"), "doc", "pos", "tokens"), "sentences")


def _similar(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    vectors = _kept(runners.paragraph_vectors(sentences, QUICK), "vectors")
    return vectors, _kept(runners.similar(sentences, vectors, 20, 0.4, 0.4).select("a", "b"), "edges", short=True)


@query()
def paragraph_vectors(t):
    return runners.paragraph_vectors(_sentences(t), QUICK)


@query()
def document_vectors(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), snowball.normalised(F.coalesce("text", F.lit(""))).alias("tokens"))
    return runners.document_vectors(docs, QUICK)


@query()
def averaged_words(t):
    return runners.averaged_words(_spoken(t), QUICK)


@query()
def retrofitted(t):
    vectors, edges = _similar(_spoken(t))
    return runners.retrofitted(vectors, edges)


@query()
def retrofitted_chain(t):
    sentences = _spoken(t)
    return runners.retrofitted(_kept(runners.paragraph_vectors(sentences, QUICK), "vectors"), runners.chain(sentences))


@query()
def regularised(t):
    sentences = _spoken(t)
    return runners.regularised(sentences, _similar(sentences)[1], QUICK, 1.0)


@query()
def regularised_chain(t):
    sentences = _spoken(t)
    return runners.regularised(sentences, runners.chain(sentences), QUICK, 1.0)


@query()
def joint_context(t):
    sentences = _spoken(t)
    return runners.joint(sentences, _similar(sentences)[1], QUICK, 0.8)


@query()
def joint_chain(t):
    sentences = _sentences(t)
    return runners.joint(sentences, runners.chain(sentences), QUICK, 0.8)


@query()
def joint_labelled(t):
    """The first sentence of four documents in five is labelled with the document's language."""
    sentences = _sentences(t)
    firsts = sentences.groupBy("doc").agg(F.min("pos").alias("pos"))
    langs = t("documents").filter("doc_id % 5 > 0").select(F.col("doc_id").alias("doc"), F.col("lang").alias("label"))
    labels = sentences.join(firsts, ["doc", "pos"]).join(langs, "doc").select("id", "label")
    return runners.joint(sentences, runners.chain(sentences), QUICK, 0.8, labels=_kept(labels, "labels"))


@query()
def lexicon_regularised(t):
    """Each turn's words as a lexicon line: the first word with the others."""
    sentences = _spoken(t)
    return runners.lexicon_regularised(sentences, runners.chain(sentences), readers.star_edges(sentences.select("tokens")), QUICK, 0.5)


@query()
def node_vectors(t):
    sentences = _spoken(t)
    return runners.node_vectors(_similar(sentences)[1].withColumn("weight", F.lit(1.0)), QUICK, per_node=4)


@query()
def adjacent_sums(t):
    return runners.adjacent_sums(_spoken(t), QUICK)


@query()
def phrase_sums(t):
    """Every word has one of the vectors that are given, by its rank."""
    words = _turns(t).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = relational.numbered(words, [F.desc("n"), "term"], 0)
    given = _vectors(t).select(F.col("id").alias("of"), "v")
    n = given.count()
    spoken = _turns(t).select((F.col("doc_id") * (1 << 20) + F.col("pos")).alias("id"), "tokens")
    return runners.phrase_sums(spoken, ranked.join(given, F.pmod("id", F.lit(n)) == F.col("of")).select("term", "v"))


@query()
def snowball_stems(t):
    """Stems of all turns, stop words left out."""
    rows = t("conversations").select("conv_id", "turn", snowball.normalised(F.coalesce("text", F.lit("")), remove_stop_words=True).alias("s"))
    return rows.select("conv_id", "turn", F.array_join("s", " ").alias("stems"))


@query()
def learning_losses(t):
    return learners.losses(learners.learn(_sentences(t), QUICK, wanted="losses"))


#: A small encoder; its vocabulary is the most frequent words, all other words are one.
SMALL = recurrent.Settings(word_dims=16, dims=24, words=400, epochs=3, steps=5, rate=0.02)


def _taught(t) -> tuple[DataFrame, recurrent.Model, DataFrame]:
    sentences = _spoken(t)
    m, words, _ = recurrent.learn(sentences, SMALL)
    return sentences, m, words


@query()
def adjacent_encoder(t):
    """Every turn's vector by an encoder that learned to predict the turns before and after."""
    return recurrent.encode(*_taught(t))


@query()
def generated_turns(t):
    """The three likeliest following turns of each turn, by beams over whole words."""
    sentences, m, words = _taught(t)
    vectors = recurrent.encode(sentences, m, words, unit=False)
    return recurrent.generate(vectors, m, words, k=3, longest=12)


@query()
def following_perplexity(t):
    """How unlikely the decoder finds the turns that do follow."""
    sentences, m, words = _taught(t)
    vectors = recurrent.encode(sentences, m, words, unit=False)
    after = sentences.select((F.col("id") - 1).alias("id"), "tokens").join(sentences.select("id"), "id", "left_semi")
    return recurrent.perplexity(recurrent.reconstruction(vectors, after, m, words))


#: A small class-factored model of words.
WORDS = language.Settings(dims=24, words=2_000, classes=40, epochs=3, steps=4, rate=0.02)


def _modelled(t) -> tuple[DataFrame, language.Language]:
    sentences = _spoken(t).select("id", "doc", "tokens")
    return sentences, language.learn(sentences, WORDS)[0]


@query()
def language_perplexity(t):
    """Each conversation's perplexity by the recurrent model of all turns, by bigrams of all documents, and by their even mixture."""
    sentences, model = _modelled(t)
    docs = t("documents").select(F.col("doc_id").alias("id"), snowball.normalised(F.coalesce("text", F.lit(""))).alias("tokens"))
    other = language.with_bigrams(sentences, language.bigram_probabilities(sentences, _kept(docs, "stemmed"), 0.1))
    words = language.word_probabilities(sentences, model).join(other, ["id", "pos"])
    return language.score(words.join(sentences.select("id", "doc"), "id"), ["doc"], 0.5)


@query()
def rescored_turns(t):
    """Each turn as it is and with its words reversed: which the model finds likelier."""
    sentences, model = _modelled(t)
    turned = F.explode(F.array(F.struct(F.lit(0).alias("choice"), "tokens"), F.struct(F.lit(1).alias("choice"), F.reverse("tokens").alias("tokens")))).alias("x")
    choices = sentences.select(F.col("id").alias("item"), turned).select("item", "x.*", F.lit(0.0).alias("other"))
    return language.rescored(choices, model).filter("place = 1").groupBy("choice").agg(F.count(F.lit(1)).alias("n"))


@query()
def drawn_turns(t):
    """For each turn one that the model draws."""
    sentences, model = _modelled(t)
    return language.drawn(sentences.select("id"), model, 30).select("id", F.array_join("tokens", " ").alias("words"))


@query()
def denoising_encoder(t):
    """Every turn's vector by an encoder that learned to find turns again whose words were masked and swapped."""
    sentences = _spoken(t)

    def noise(ids, key):
        return tokens.swapped(tokens.masked(ids, 0.1, key, recurrent.UNKNOWN), 0.1, key)

    m, words, _ = recurrent.learn_denoising(sentences, SMALL, noise)
    return recurrent.encode(sentences, m, words)


@query()
def convolution_classes(t):
    """Languages of all documents by filters over words; the documents that do not teach are counted by their own and the found language."""
    docs = t("documents").select(F.col("doc_id").alias("id"), tx.tokens(F.col("text")).alias("tokens"), F.col("lang").alias("label"))
    docs = _kept(docs, "docs")
    s = neural.Settings(word_dims=16, units=24, hidden=24, words=4_000, epochs=4, steps=3, rate=0.02)
    c, _ = neural.learn(docs.filter("id % 5 > 0"), s)
    return neural.classify(docs, c).join(docs.filter("id % 5 = 0").select("id", "label"), "id").groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query()
def memory_classes(t):
    """Roles of all turns by long short-term memory, counted by the own and the found role of turns whose conversation does not teach."""
    turns = _kept(_turns(t).join(t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pos"), F.col("role").alias("label")), ["doc_id", "pos"]), "turns")
    rows = turns.select((F.col("doc_id") * (1 << 20) + F.col("pos")).alias("id"), "doc_id", "tokens", "label")
    s = neural.Settings("memory", word_dims=16, units=24, words=2_000, epochs=4, steps=3, rate=0.02)
    c, _ = neural.learn(rows.filter("doc_id % 5 > 0"), s)
    return neural.classify(rows, c).join(rows.filter("doc_id % 5 = 0").select("id", "label"), "id").groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
