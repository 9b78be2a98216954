"""Corpus pipeline: quality, near-duplicates, repeated passages, mixture, tokens.

Each stage takes all its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.llm import bpe, mixing, near_dup, quality, substring_dedup
from keepwise.llm.common import stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (score below 0.7).

    Null and empty texts are scored by the bias and go or stay together; repeated rows are judged alike; without
    usable labels all scores are 0.5 and nothing is left.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id (five words, similarity 0.8).

    Texts without words and rows without an id are linked with nothing and stay; of equal rows one stays.
    """
    return near_dup.drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus are cut out; n_chars follows the text.

    Documents without a repeated window keep their text as it is, null included; all rows stay.
    """
    done = substring_dedup.deduplicate(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length.cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: never, once or twice.

    Documents without words take no part in the totals; a null source is one of its own.
    """
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to; null and empty texts have no ids."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded=True)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", passage_dedup),
    ("source_mixing", mix_sources),
    ("bpe_encode_decode", tokenize),
]
# A fitted model, hashing and seeded draws: not expressible in SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
