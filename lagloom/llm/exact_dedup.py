"""Exact dedup with a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced
to one row per digest, set against the index by a sort-merge anti-join, and the
digests not seen before are appended. Only DataFrame operations are used.

Defined results
* null text counts as empty; texts are equal when byte-identical.
* within a batch the row with the largest doc_id stays; rows repeated with the
  same doc_id and text keep exactly one row; a null doc_id sorts below all.
* a text that an earlier batch indexed keeps that batch's document: all of its
  rows in the new batch are dropped. group_size counts the batch's rows.
* an empty batch gives an empty result and appends nothing.
* a batch that is added again under its name (after a driver was lost, say)
  gives the same verdicts again and appends nothing.
* other columns of the input are ignored, whatever their names;
  ``keep_last_copies`` keeps them as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, partitions, stored, unused

#: A digest held by more than 1/HOT_SHARE of a batch's rows is joined by
#: broadcast; there can be at most HOT_SHARE such digests.
HOT_SHARE = 256
_LOWEST = -(2**63)


class DigestIndex:
    """A bucketed, sorted table of the digests kept so far.

    ``path`` may name an existing index (its ``buckets`` must be as at its
    creation); a new session attaches to it by the same call. ``close`` takes
    the table's name out of the catalog and leaves its files.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "digest-index")
        self.buckets = buckets or partitions(spark)
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """Index a batch; one row per input row: doc_id, keep_id, group_size,
        kept, text_sha256, row_no (tells repeated rows apart). The digests are
        appended before the caller has the result: a job that may be run again
        must name its batch, and gets the same result then."""
        batch = batch or uuid.uuid4().hex
        rows = stored(
            docs.select(
                F.col(doc_id).cast("long").alias("doc_id"),
                F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
                F.monotonically_increasing_id().alias("row_no"),
            ),
            "digests",
        )
        order = F.coalesce(F.col("doc_id"), F.lit(_LOWEST))
        groups = stored(
            rows.groupBy("digest").agg(
                F.max("doc_id").alias("last_id"),
                F.count(F.lit(1)).alias("group_size"),
                F.max_by("row_no", order).alias("last_row"),
            ),
            "digest-groups",
        )
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", F.col("last_id").alias("keep_id"), F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.insertInto(self.table)
        )
        self.spark.catalog.refreshTable(self.table)
        verdicts = stored(
            groups.join(self.rows().hint("merge"), "digest").select(
                "digest", "keep_id", "group_size",
                F.when(F.col("batch") == batch, F.col("last_row")).otherwise(F.lit(-1)).alias("keep_row"),
            ),
            "digest-verdicts",
        )
        total = verdicts.agg(F.sum("group_size")).first()[0] or 0
        hot = F.col("group_size") * HOT_SHARE > total
        hot_verdicts = F.broadcast(verdicts.where(hot))  # at most HOT_SHARE rows
        rest = rows.join(hot_verdicts.select("digest"), "digest", "left_anti")
        joined = rows.join(hot_verdicts, "digest").unionByName(
            rest.join(verdicts.where(~hot).hint("merge"), "digest")
        )
        return joined.select(
            "doc_id", "keep_id", "group_size",
            (F.col("row_no") == F.col("keep_row")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "row_no",
        )


def keep_last_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns.

    The verdicts are joined back on doc_id and digest; rows repeated with both
    equal are numbered in the join's own partitions and one of them stays.
    """
    from pyspark.sql import Window

    key, sha, n = (unused(docs, x) for x in ("key", "sha", "place"))
    with DigestIndex(docs.sparkSession) as index:
        stays = index.add(docs).where("kept").select(
            F.coalesce("doc_id", F.lit(_LOWEST)).alias(key), F.col("text_sha256").alias(sha)
        )
    named = docs.select(
        "*",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias(key),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias(sha),
    )
    kept = named.join(stays.hint("merge"), [key, sha], "left_semi")
    once = Window.partitionBy(key, sha).orderBy(key)
    return kept.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).drop(key, sha, n)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with DigestIndex(spark) as index:
        return index.add(documents(spark, sf_dir)).drop("row_no")


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
