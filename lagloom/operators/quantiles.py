"""Exact percentiles of groups of any size, by histograms in rounds.

Each wanted rank of each group is narrowed to a smaller and smaller range of
values. The first histogram is by sign and magnitude; each next one cuts the
range of the bucket that holds the rank, as its rows fill it, into equal parts.
Histograms are summed before they are shuffled and hold a bounded number of
buckets, so no task holds a group's values, however many there are or whatever
share of the rows one group has. Once a range holds few rows, or one value, the
rank is read off. Equal widths shrink a range by the number of buckets in every
round and magnitudes are apart from the first, so a handful of rounds settle any
doubles; panels of some thousand frames need none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written

#: Buckets of a round; rows from which a rank is read off; ranges sent to every task.
BUCKETS, FEW, SENT = 4096, 10_000, 100_000


def _magnitude(v: Column) -> Column:
    """A bucket that never falls as v grows: quarter powers of two, by sign.
    Infinities and NaN, which sorts last, have buckets of their own."""
    size = F.floor(F.log2(F.abs(v)) * 4) + 5000
    return (
        F.when(F.isnan(v), 3 * 10**4).when(v == float("inf"), 2 * 10**4).when(v == float("-inf"), -2 * 10**4)
        .when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("int")
    )


def _holding(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Of each wanted rank's buckets the one that holds it, the rank counted
    from its first row."""
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    rows = histogram.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    held = rows.where("rank >= before AND rank < upto")
    return held.select(*(c for c in held.columns if c not in ("bucket", "upto", "before", "rank")), (F.col("rank") - F.col("before")).alias("rank"))


def _inside(rows: DataFrame, ranges: DataFrame, many: int, keys: list[str]) -> DataFrame:
    """Each row beside the ranges of its group that it lies in."""
    if many <= SENT:
        ranges = F.broadcast(ranges)
    return rows.join(ranges, keys).where("v BETWEEN lo AND hi")


def percentiles(rows: DataFrame, keys: Sequence[str], value: str | Column, shares: Sequence[float], few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """keys and q: for each share (0 to 1) the value that lies so far up a
    group's values in order, between two by their distance. Null values are
    left out; a group without others has no row. Keys must not be null. The rows
    are read once for each round, so they should be a table."""
    keys = list(keys)
    rows = rows.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v IS NOT NULL")
    first = rows.groupBy(*keys, _magnitude(F.col("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = first.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    # a share's place, and the ranks on both sides of it
    place = F.transform(F.array(*map(F.lit, shares)), lambda s: s * (F.col("all") - 1))
    wanted = F.array_distinct(F.flatten(F.transform(place, lambda x: F.array(F.floor(x), F.ceil(x)))))
    each = upto.select("*", F.explode(F.filter(wanted, lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))).alias("at"))
    state = each.select(*keys, "at", F.col("all"), "lo", "hi", "n", (F.col("at") - F.col("upto") + F.col("n")).alias("rank"))
    state = written(state, "ranks")
    wide = (F.col("n") > few) & F.expr("lo < hi")
    while True:
        many, narrow = state.agg(F.count_if(wide), F.count_if(F.expr("lo < hi"))).first()
        if not many:
            break
        at = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets), F.lit(buckets - 1))
        by = [*keys, "at"]
        inside = _inside(rows, state.where(wide).drop("n"), many, keys)
        histogram = inside.groupBy(*by, "all", "rank", at.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        narrowed = _holding(histogram, by).select(state.columns)
        state = written(state.where(~wide).unionByName(narrowed), "ranks")
    # lo = hi: the rank's value; else a few rows are put in order
    told = state.where("NOT lo < hi").select(*keys, "at", "all", F.col("lo").alias("x"))
    listed = _inside(rows, state.where("lo < hi").drop("n"), narrow, keys).groupBy(*keys, "at", "all", "rank").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    told = told.unionByName(listed.select(*keys, "at", "all", F.get("vs", F.col("rank").cast("int")).alias("x")))
    held = told.groupBy(*keys, "all").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("x"))

    def between(s):
        x, at = s * (F.col("all") - 1), F.col("x")
        low, high = at[F.floor(x)], at[F.ceil(x)]
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return held.select(*keys, F.transform(F.array(*map(F.lit, shares)), between).alias("q"))
