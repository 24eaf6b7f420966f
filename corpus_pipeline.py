"""A training corpus from raw documents, stage by stage; part of the subpackage llm.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame that is written as Parquet and read again for the next one. All but the last return the
columns of ``documents``.

Edge cases, in every stage: null and empty texts are documents without words and are kept by the
toxicity stage, one of them stays after near-dedup, and they pack as the end id alone; very long
texts are worked on whole; rows that repeat are near copies, of which the smallest doc_id and text
hash stays; a null doc_id counts as the last; extra columns go, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _common, mixing, neardup, packing, pii, queries, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go; the model learns from the labels."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=tuple(COLUMNS)).where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the smallest doc_id."""
    return neardup.deduplicated(docs).select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format; n_chars follows the text."""
    return pii.pseudonymised(docs, queries.pseudonym_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the output shards."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.packed_documents(docs, queries.tokenizer_path(), 4096)


STAGES = [("toxicity", toxic_filter), ("near_dedup", near_dedup), ("pii", pseudonyms), ("mix", mix), ("pack", pack)]

#: the learnt scores, signatures and seeded draws are not SQL; the stages are tested by themselves
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = _common.written(docs, name)
    return docs
