"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, divergence, fill_middle, fingerprints, jaccard, licenses, media, mixing, quality, sharding, simhash, token_counts, toxicity
from textloom.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts, in a seeded random order."""
    rows = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), shards=8)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of all documents, and of the texts that decoding gives back."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), ids=False, digests=True)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, those of over 4,096 tokens marked."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are at least 0.9 alike."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"), width=3, threshold=0.9).drop("h")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under a model of the trusted ones, and whether their language keeps them."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and how alike neighbours are."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def near_copy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-copies among all documents by the fingerprints' bands, each link verified."""
    return fingerprints.near_classes(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as media files, read back."""
    read = media.read_media(media.to_media(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle forms of all documents, with digests of the output and of the text rebuilt from it."""
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of each source of all documents differ from other sources' and from its language's."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of those at most three bits apart."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_bpe, op3_mixing, op4_token_counts, op5_ngram_jaccard, op6_licenses, op7_quality, op8_fingerprints, op9_toxicity, op10_media, op11_fill_middle, op12_divergence, op13_simhash, near_copy_classes)
}

ORACLES: dict[str, str] = {"op6_licenses": licenses.oracle(), "op11_fill_middle": fill_middle.ORACLE, "op12_divergence": divergence.ORACLE}
