"""Lagged second moments: one distributed sum that the solvers share.

For the columns x_d(t + c), c = 0..L, of a series, the sums of all products
over a block of frames. A product of two columns at offsets c and e is one of
their lagged products, so the joins and sums are the same for every pair.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.panel import to_arrays, windowed


def embedded(panel: DataFrame, lags: int, value: str = "value", size: int | None = None) -> DataFrame:
    """series_id, t, v: [x_d(t + c)] with c outer and d inner, and a last 1;
    only frames that have all offsets. One array for each frame, so the window
    below holds ``lags`` + 1 short arrays."""
    wide = to_arrays(panel.select("series_id", "t", "dim", F.col(value).alias("value")))

    def add(rows, w):
        parts = [F.col("x"), *(F.lead("x", c).over(w) for c in range(1, lags + 1))]
        return rows.withColumn("v", F.concat(*parts, F.array(F.lit(1.0))))

    return windowed(wide, add, after=lags, keys=("series_id",), size=size).select("series_id", "t", "v").where("v IS NOT NULL")


def gram_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, row, part: what each task adds to the sum of v v' of each key, by
    rows of the matrix from the diagonal on."""
    kept = rows.select(*keys, "v")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keys).schema), "row int, part array<double>"])

    def partial(batches):
        import numpy as np

        def frame(sums):
            out = [(*k, i, g[i, i:].tolist()) for k, g in sums.items() for i in range(len(g))]
            return pd.DataFrame(out, columns=[*keys, "row", "part"])

        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, part in b.groupby(list(keys), sort=False):
                v = np.array(part["v"].tolist(), dtype="f8")
                key = key if isinstance(key, tuple) else (key,)
                g = v.T @ v
                sums[key] = sums[key] + g if key in sums else g
            if len(sums) > 256:
                yield frame(sums)
                sums = {}
        yield frame(sums)

    return kept.mapInPandas(partial, schema)


def _added(parts: pd.Series) -> list[float]:
    total = None
    for p in parts:
        total = p if total is None else total + p
    return list(total)


def summed(parts: DataFrame, *keys: str) -> DataFrame:
    """keys, g: the rows of each matrix, added up, from the diagonal on."""
    add = F.pandas_udf(_added, "array<double>")
    rows = parts.groupBy(*keys, "row").agg(add("part").alias("part"))
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "part"))).alias("s"))
    return held.select(*keys, F.transform("s", lambda s: s["part"]).alias("g"))


def gram(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, g: the sum of v v' over the rows of each key (its upper half, row
    by row; ``symmetric`` makes it whole). Each task adds its rows into one
    matrix for each key it meets, and only rows of those are shuffled."""
    return summed(gram_rows(rows, *keys), *keys)


def symmetric(g):
    """The whole matrix of a gram's rows."""
    import numpy as np

    out = np.zeros((len(g), len(g)))
    for i, part in enumerate(g):
        out[i, i:] = out[i:, i] = part
    return out
