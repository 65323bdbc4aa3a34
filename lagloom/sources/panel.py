"""Panels: the dense (series, frame, dimension) form all operators work on.

panel(series_id STRING, t BIGINT, dim INT, name STRING, value DOUBLE), without
nulls and with every frame 0..T-1 for every dimension of a series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("series_id", "dim")
#: Frames of a series whose windows one task computes at once.
BLOCK = 1 << 16


def windowed(
    rows: DataFrame, add: Callable, before: int = 0, after: int = 0, keys: Sequence[str] = KEYS, size: int | None = None
) -> DataFrame:
    """add(rows, w), where w orders the rows of a key by frame, for columns that
    look at most ``before`` frames back and ``after`` ahead.

    A key's frames are cut into blocks of ``size``, and each block is given the
    frames around it that its windows reach; those are dropped again. So a
    series of any length is spread over tasks, and the result is that of one
    window over the whole of it. Frames must be dense.
    """
    size = size or BLOCK
    reach = F.sequence(F.greatest(F.floor((F.col("t") - after) / size), F.lit(0)), F.floor((F.col("t") + before) / size))
    copies = rows.withColumn("_block", F.explode(reach))
    found = add(copies, Window.partitionBy(*keys, "_block").orderBy("t"))
    return found.where(F.col("_block") == F.floor(F.col("t") / size)).drop("_block")


def panelize(
    df: DataFrame, ts: str, dim: str, value: str, origin: str, unit: str, frames: int, series: str | None = None
) -> DataFrame:
    """Bucket a timestamped table, sum its values, fill the gaps with 0. The
    sums are partial before the shuffle. Rows outside the ``frames`` from origin
    on, or without time or dimension, belong to no frame."""
    key = F.col(series).cast("string") if series else F.lit("all")
    start = F.lit(origin).cast("timestamp_ntz")
    sums = (
        df.where(F.col(ts).isNotNull() & F.col(dim).isNotNull())
        .select(
            key.alias("series_id"),
            F.timestamp_diff(unit, start, F.col(ts).cast("timestamp_ntz")).alias("t"),
            F.col(dim).cast("string").alias("name"),
            F.col(value).cast("double").alias("value"),
        )
        .groupBy("series_id", "name", "t")
        .agg(F.sum("value").alias("value"))
    )
    return dense(sums, frames)


def dense(sums: DataFrame, frames: int) -> DataFrame:
    """(series_id, name, t, value) to a panel: a dimension for every name in
    sums, also where only frames outside have it, and 0 where nothing is. Names
    are numbered in order; the spine of a series, dimension and frame is made by
    explode, never by a join of facts."""
    names = sums.select("name").distinct()
    dims = names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("dim"))
    inside = sums.where(F.col("t").between(0, frames - 1))
    # A series' dimensions are made from their count and named by a join on their
    # number: no series meets a list of all names.
    many = names.agg(F.count(F.lit(1))).scalar()
    keys = inside.select("series_id").distinct().withColumn("dim", F.explode(F.sequence(F.lit(0), (many - 1).cast("int")))).join(dims, "dim")
    spine = keys.select("series_id", "dim", "name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))).alias("t"))
    return spine.join(inside, ["series_id", "name", "t"], "left").select(
        "series_id", "t", "dim", "name", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def from_columns(df: DataFrame, columns: list[str], t: str, series: Column | None = None) -> DataFrame:
    """A wide table with one column for each dimension, to long form."""
    wide = df.select(
        (series if series is not None else F.lit("all")).cast("string").alias("series_id"),
        F.col(t).cast("long").alias("t"),
        *(F.col(c).cast("double").alias(c) for c in columns),
    )
    names = F.array(*(F.lit(c) for c in columns))
    return wide.unpivot(["series_id", "t"], columns, "name", "value").select(
        "series_id", "t", (F.array_position(names, F.col("name")) - 1).cast("int").alias("dim"), "name", "value"
    )


def from_arrays(df: DataFrame, column: str = "x") -> DataFrame:
    """(series_id, t, x ARRAY<DOUBLE>) to long form."""
    return df.select("series_id", "t", F.posexplode(column).alias("dim", "value")).select(
        "series_id", F.col("t").cast("long").alias("t"), "dim", F.concat(F.lit("dim_"), F.col("dim")).alias("name"), F.col("value").cast("double").alias("value")
    )


def to_arrays(panel: DataFrame, value: str = "value") -> DataFrame:
    """(series_id, t, x): x in order of dim."""
    held = panel.groupBy("series_id", "t").agg(F.sort_array(F.collect_list(F.struct("dim", value))).alias("s"))
    return held.select("series_id", "t", F.transform("s", lambda s: s[value]).alias("x"))


def frames_between(panel: DataFrame, first: int, end: int) -> DataFrame:
    """Frames first..end-1, numbered from 0."""
    return panel.where(F.col("t").between(first, end - 1)).withColumn("t", F.col("t") - first)


def reversed_time(panel: DataFrame) -> DataFrame:
    last = panel.groupBy("series_id", "dim").agg(F.max("t").alias("_last"))
    return panel.join(last, ["series_id", "dim"]).select(*((F.col("_last") - F.col("t")).alias("t") if c == "t" else c for c in panel.columns))


def shape(panel: DataFrame) -> DataFrame:
    """n_frames and n_dims of each series."""
    return panel.groupBy("series_id").agg((F.max("t") + 1).alias("n_frames"), (F.max("dim") + 1).alias("n_dims"))
