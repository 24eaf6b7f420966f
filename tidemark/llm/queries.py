"""The ten operators over the test tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pseudonym_key(spark: SparkSession) -> str:
    """The session's key for pseudonyms; the synthetic test tables hold no secrets, so they may do with a known one."""
    return spark.conf.get("spark.tidemark.pseudonymKey", "key of the synthetic tables")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score, learnt from the labelled documents that are not held out."""
    from tidemark.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    rows = docs.withColumn("held_out", toxicity.held_out(docs["doc_id"]))
    return toxicity.score(rows, model, keep=("doc_id", "held_out"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that repeated windows of 20 words remove."""
    from tidemark.llm import substrings

    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), 20)


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    from tidemark.llm import ann

    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and spans of the base formats, and all spans."""
    from tidemark.llm import secrets

    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    counts = [_count("base", i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])]
    base = F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, secrets.digest(F.col("found")).alias("spans"), _count("found", 3).alias("n_markov"))


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of at most 4096 tokens, each with its sequence and place."""
    from tidemark.llm import packing

    return packing.packed_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), 4096)


def packing_under_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with at most 16 pieces and half of the largest attention cost in a sequence: both bind, and so do the tokens."""
    from tidemark.llm import packing

    docs = _table(spark, sf_dir, "documents")
    return packing.packed_documents(docs, tokenizer_path(), 4096, max_docs=16, max_cost=4096.0**2 / 2, rule="norm")


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms of the same format."""
    from tidemark.llm import pii

    return pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies: five-word shingles, similarity 0.8 or more."""
    from tidemark.llm import neardup

    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likenesses."""
    from tidemark.llm import fingerprints

    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of a mix of the sources by weights 1, 2, 3, and where its copies go."""
    from tidemark.llm import mixing

    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences, by its known licence sentences."""
    from tidemark.llm import licences

    found = licences.scan(_table(spark, sf_dir, "documents"))
    lists = [F.array_join(c, ",").alias(c) for c in ("licences", "sentence_ids", "unmatched")]
    return found.select("doc_id", *lists)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_ann_forest": op3_ann_forest,
    "op4_secret_scan": op4_secret_scan,
    "op5_best_fit_packing": op5_best_fit_packing,
    "packing_under_limits": packing_under_limits,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_mix_sources": op9_mix_sources,
    "op10_licence_scan": op10_licence_scan,
}

SQL: dict[str, str] = {
    "op2_substring_dedup": sql.SUBSTRINGS,
    "op7_minhash_near_dedup": sql.NEAR_DUPLICATES,
    "op10_licence_scan": sql.LICENCES,
}
