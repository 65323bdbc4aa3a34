"""Pairs of dimensions, at equal frames and at lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import EPS


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; 0 where a side does not vary."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    flat = (sx < EPS) | (sy < EPS) | sx.isNull() | sy.isNull()
    # NULLIF keeps the division legal under ANSI for the guarded case.
    return F.when(flat, 0.0).otherwise(F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0)))


def lag_pairs(panel: DataFrame, max_lag: int, value: str = "value", min_lag: int = 1) -> DataFrame:
    """series_id, src, dst, lag, t, x (src at t), y (dst at t + lag), src <> dst.

    An equi-join on the shifted frame; the shifts are exploded, so both sides
    are hashed on (series_id, frame).
    """
    lags = F.explode(F.sequence(F.lit(min_lag), F.lit(max_lag)))
    a = panel.select("series_id", "t", F.col("dim").alias("src"), F.col(value).alias("x"), lags.alias("lag"))
    a = a.withColumn("at", F.col("t") + F.col("lag"))
    b = panel.select("series_id", F.col("t").alias("at"), F.col("dim").alias("dst"), F.col(value).alias("y"))
    return a.join(b, ["series_id", "at"]).where("src <> dst").select("series_id", "src", "dst", "lag", "t", "x", "y")


def lag_corr(panel: DataFrame, max_lag: int, value: str = "value") -> DataFrame:
    return lag_pairs(panel, max_lag, value).groupBy("series_id", "src", "dst", "lag").agg(safe_corr("x", "y").alias("r"))


def same_frame_pairs(panel: DataFrame, value: str = "value", ordered: bool = False) -> DataFrame:
    a = panel.select("series_id", "t", F.col("dim").alias("i"), F.col(value).alias("x"))
    b = panel.select("series_id", "t", F.col("dim").alias("j"), F.col(value).alias("y"))
    return a.join(b, ["series_id", "t"]).where("i <> j" if ordered else "i < j")


def pair_corr(panel: DataFrame, value: str = "value") -> DataFrame:
    return same_frame_pairs(panel, value).groupBy("series_id", "i", "j").agg(safe_corr("x", "y").alias("r"))


def covariance(panel: DataFrame, value: str = "value") -> DataFrame:
    """Sample covariance of every pair, both orders and the diagonal."""
    a = panel.select("series_id", "t", F.col("dim").alias("i"), F.col(value).alias("x"))
    b = panel.select("series_id", "t", F.col("dim").alias("j"), F.col(value).alias("y"))
    return a.join(b, ["series_id", "t"]).groupBy("series_id", "i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def best_lag(lagged: DataFrame) -> DataFrame:
    """Of each pair i < j the lag and direction of largest |r|: ties go to the
    smaller lag, then to i before j. The lag's sign tells the direction."""
    pairs = lagged.select(
        "series_id",
        F.least("src", "dst").alias("i"),
        F.greatest("src", "dst").alias("j"),
        "lag",
        (F.col("src") > F.col("dst")).cast("int").alias("back"),
        "r",
    )
    w = Window.partitionBy("series_id", "i", "j").orderBy(F.abs("r").desc(), "lag", "back")
    first = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    found = F.abs("r") > 0
    return first.select(
        "series_id", "i", "j",
        F.when(found, F.col("r")).otherwise(0.0).alias("r"),
        F.when(found, F.when(F.col("back") == 1, -F.col("lag")).otherwise(F.col("lag"))).otherwise(0).alias("lag"),
    )
