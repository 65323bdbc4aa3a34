"""A corpus pipeline of five stages; each reads the Parquet the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagloom.llm.common import documents, stored
from lagloom.llm.exact_dedup import keep_last_copies
from lagloom.llm.jaccard_join import keep_one_of_each
from lagloom.llm.packing import pack
from lagloom.llm.secret_scan import SecretForest, redact
from lagloom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Written here, so that texts pass between the
    JVM and Python in batches of few rows, however the caller writes the result."""
    return stored(reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "not-toxic")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return keep_last_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles the least doc_id stays."""
    return keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return redact(docs, SecretForest.for_corpus(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as pieces of full sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

#: A trained classifier's decisions can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
