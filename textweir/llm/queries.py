"""The training-data queries: one for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import minimax_shards

    return minimax_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the counts of all others, so that what only one document says
    backs off; n_unigram tells how many of its words fell back to their own share."""
    from .ngrams import stupid_backoff

    return stupid_backoff(table(spark, sf_dir, "documents"), order=3, least=1, held_out=True)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE_KINDS, KINDS, find_pii, listed, scores

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.col("pii")[k]).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(BASE_KINDS, F.col("pii")), 256).alias("base_sha256"), listed(KINDS, F.col("pii")).alias("spans"), scores(KINDS, F.col("pii")).alias("scores")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge, trusted_ids

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, trusted_ids(table(spark, sf_dir, "labels")), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"
    )


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex16, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: The target mixture: weights by name at each level, others 1; the budget as a share of all tokens.
MIX = {
    "share": 0.9,
    "weights": {"domain": {"domain0": 3.0, "domain1": 2.0}, "lang": {"en": 5.0, "de": 2.0}, "source": {"src0": 2.0}},
    "epochs": 2,
}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), **MIX).select("doc_id", "domain", "lang", "source", "tokens", "copies")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import remove_repeats

    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrapper import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE_KINDS, find_secrets, listed

    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("secrets"), BASE_KINDS), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_ngrams": op2_ngrams,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_neighbours": op5_neighbours,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_passages": op8_passages,
    "op9_html": op9_html,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_secrets": op11_secrets,
    "op12_spelling": op12_spelling,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op7_mixing": oracles.mixing(**MIX),
    "op8_passages": oracles.PASSAGES,
    "op12_spelling": oracles.SPELLING,
    "op13_prefix_trie": oracles.TRIE,
}
