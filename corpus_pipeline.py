"""A corpus pipeline out of the training-data operators.

Each stage takes what the one before it kept, judges whole texts, and returns the columns of
its input; the last adds ``rate`` and ``copies``.  Null and empty texts, repeated rows, null ids and
empty tables are treated as the operators of the stages document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm import decontaminate, mixing, neardup, quality, secrets
from tallyguard.llm.queries import TARGETS, labelled_domains
from tallyguard.session import cut


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least id."""
    return neardup.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are blanked out."""
    return secrets.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the rate and the number of copies that bring the languages to their targets."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix(docs, labelled_domains(docs, labels), TARGETS)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaked),
    ("secret scans", blank_secrets),
    ("mixing sources to target weights", mix_domains),
]

#: Trained models and signatures are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
