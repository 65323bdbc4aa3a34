"""Per-dimension signals: differences, local scale, scores, rolling statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import KEYS, windowed

EPS = 1e-10


def difference(panel: DataFrame, value: str = "value", size: int | None = None) -> DataFrame:
    """d at frame t is x(t+1) - x(t); the last frame has none."""
    step = lambda r, w: r.withColumn("d", F.lead(value).over(w) - F.col(value))
    return windowed(panel, step, after=1, size=size).where("d IS NOT NULL")


def local_std(panel: DataFrame, half: int, name: str = "s", value: str = "value", size: int | None = None) -> DataFrame:
    """Population deviation of the frames within half of a frame."""
    sd = lambda r, w: r.withColumn(name, F.stddev_pop(value).over(w.rowsBetween(-half, half)))
    return windowed(panel, sd, half, half, size=size)


def rho_tension(panel: DataFrame, window: int, name: str = "rho", value: str = "value", size: int | None = None) -> DataFrame:
    """Deviation of the last window + 1 frames; 0 where there is only one."""

    def add(rows, w):
        w = w.rowsBetween(-window, 0)
        return rows.withColumn(name, F.when(F.count(value).over(w) < 2, 0.0).otherwise(F.stddev_pop(value).over(w)))

    return windowed(panel, add, before=window, size=size)


def displacement(panel: DataFrame, half: int | Sequence[int] = 20, value: str = "value", size: int | None = None) -> DataFrame:
    """Differences over the local scale of the frame they lead to. With several
    ``half``, the column local_window says which one a series has."""
    widths = [half] if isinstance(half, int) else list(half)

    def add(rows, w):
        scale = F.stddev_pop(value).over(w.rowsBetween(-widths[0], widths[0]))
        for h in widths[1:]:
            scale = F.when(F.col("local_window") == h, F.stddev_pop(value).over(w.rowsBetween(-h, h))).otherwise(scale)
        rows = rows.withColumn("_s", scale)
        return rows.withColumn("disp", (F.lead(value).over(w) - F.col(value)) / (F.lead("_s").over(w) + EPS))

    return windowed(panel, add, max(widths), max(widths) + 1, size=size).where("disp IS NOT NULL").drop("_s")


def _scaled(panel: DataFrame, name: str, value: str, z: Callable) -> DataFrame:
    """By means and deviations that are summed first and joined to the frames."""
    stats = panel.groupBy(*KEYS).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    kept = [c for c in panel.columns if c != name]
    return panel.join(stats, list(KEYS)).select(*kept, z(F.col(value), F.col("_mean"), F.col("_sd")).alias(name))


def zscore(panel: DataFrame, name: str = "z", value: str = "value", floor: float = EPS) -> DataFrame:
    """0 where the deviation is at most floor."""
    return _scaled(panel, name, value, lambda x, m, sd: F.when(sd > floor, (x - m) / sd).otherwise(0.0))


def zscore_unit(panel: DataFrame, name: str = "z", value: str = "value") -> DataFrame:
    """A deviation under 1e-12 counts as 1."""
    return _scaled(panel, name, value, lambda x, m, sd: (x - m) / F.when(sd < 1e-12, 1.0).otherwise(sd))


def rolling(panel: DataFrame, window: int, value: str = "value", size: int | None = None) -> DataFrame:
    """mean and sd of the last ``window`` frames."""

    def add(rows, w):
        w = w.rowsBetween(-(window - 1), 0)
        return rows.withColumn("mean", F.avg(value).over(w)).withColumn("sd", F.stddev_pop(value).over(w))

    return windowed(panel, add, before=window - 1, size=size)


def near(rows: DataFrame, flag: str, name: str, reach: int = 2, size: int | None = None) -> DataFrame:
    """1 where the flag is set within ``reach`` frames."""
    add = lambda r, w: r.withColumn(name, F.max(flag).over(w.rowsBetween(-reach, reach)))
    return windowed(rows, add, reach, reach, size=size)


def saturated(x: Column) -> Column:
    up = F.greatest(x, F.lit(0.0))
    return up / (1 + up)


def of_largest(x: Column, *keys: str) -> Column:
    """Share of the largest value of the series; negatives and all-zero: 0."""
    top = F.max(x).over(Window.partitionBy(*(keys or ("series_id",))))
    return F.when(top > 0, F.greatest(x, F.lit(0.0)) / top).otherwise(0.0)


def clipped(x: Column, lo, hi) -> Column:
    """As numpy clips: hi wins where lo > hi."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.least(F.greatest(x, lo), hi)
