"""Proportional stratified interleaving into shards.

Every source's rows are put in a seeded random order; a row's place in it, as a
fraction of the source's rows, is its place in the whole. The whole order is cut
into equal counts, so each shard holds every source in its overall share.

Ranks are found without bringing a source into one task: rows are dealt out by
range, numbered inside each range, and the ranges' counts give the offsets.

Defined results
* null text counts as no bytes (size 1); a null source is a source of its own.
* rows with equal doc_id and text are interchangeable: each gets its own slot.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions, stored


def _number(key: str | None, schema: pa.Schema):
    """Adds range_no and place (from 0 in the range, per key if one is given)."""

    def number(batches):
        part, seen, last = TaskContext.get().partitionId(), 0, object()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            place = np.arange(n)
            if key is None:
                place += seen
            else:
                keys = np.asarray(batch.column(key).to_pylist(), dtype=object)
                new = np.concatenate(([keys[0] != last], keys[1:] != keys[:-1]))
                start = np.maximum.accumulate(np.where(new, place, -1))
                place = np.where(start < 0, place + seen, place - start)
                last = keys[-1]
            seen = int(place[-1]) + 1
            extra = [pa.array(np.full(n, part, "i4")), pa.array(place.astype("i8"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema=schema)

    return number


_ROW = "doc_id long, src string, size long, text_crc32 long, shuffle_key long"


def _arrow(*fields) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([pa.field(n, kinds[k]) for n, k in fields])


def interleaved(docs: DataFrame, shards: int = 8, seed: int = 20240117) -> DataFrame:
    """doc_id, size, text_crc32, source_rank (fraction), shard, slot."""
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("src"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("shuffle_key"),
    )
    order = ["src", "shuffle_key", "doc_id", "text_crc32"]
    fields = [tuple(x.split(" ")) for x in _ROW.split(", ")]
    number = _number("src", _arrow(*fields, ("range_no", "int"), ("place", "long")))
    ranked = stored(
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(number, _ROW + ", range_no int, place long"),
        "shard-ranks",
    )
    counts = ranked.groupBy("src", "range_no").agg(F.count(F.lit(1)).alias("n"))
    by_source = Window.partitionBy("src")
    before = F.sum("n").over(by_source.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        "src", "range_no", F.coalesce(before, F.lit(0)).alias("base"), F.sum("n").over(by_source).alias("n_src")
    )
    spread = ranked.join(offsets.hint("merge"), ["src", "range_no"]).select(
        "doc_id", "src", "size", "text_crc32", "shuffle_key",
        ((F.col("base") + F.col("place") + 0.5) / F.col("n_src")).alias("source_rank"),
    )
    order = ["source_rank", *order]
    number = _number(None, _arrow(*fields, ("source_rank", "double"), ("range_no", "int"), ("place", "long")))
    mixed = stored(
        spread.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(number, _ROW + ", source_rank double, range_no int, place long"),
        "shard-order",
    )
    # One row per range: as many as there are partitions, whatever the rows.
    starts, total = [], 0
    for r in sorted(mixed.groupBy("range_no").count().collect()):
        starts.append((r["range_no"], total))
        total += r["count"]
    starts = spark.createDataFrame(starts or [(0, 0)], "range_no int, start long")
    place = F.col("start") + F.col("place")
    total = max(total, 1)
    return (
        mixed.join(F.broadcast(starts), "range_no")
        .withColumn("g", place)
        .withColumn("shard", F.expr(f"cast(g * {shards} div {total} as int)"))
        .withColumn("slot", F.expr(f"g - (shard * {total}L + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", "source_rank", "shard", "slot")
    )


def op7_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
