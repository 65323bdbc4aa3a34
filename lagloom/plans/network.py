"""Partial-correlation network: synchronous and lagged links of every series.

Two views of a panel (steps over their local scale; z-scored values) give
correlations by lagged moments; the stronger valid view wins for each pair;
links pass Fisher and Benjamini-Hochberg tests and two triangle filters.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals as sig
from ..functions.tails import fisher_p
from ..operators import graph as g
from ..operators.lagged import best_lag, pair_corr
from ..operators.moments import embedded, gram_rows, summed, symmetric
from ..operators.spectrum import amplitudes
from ..sources import panel as pn
from ..sources.written import written

PAIR = ["series_id", "i", "j"]


@dataclass(frozen=True)
class NetworkConfig:
    sync_threshold: float = 0.5
    causal_threshold: float = 0.4
    max_lag: int = 12
    adaptive: bool = True
    local_std_window: int = 20
    p_value: float = 0.05


@dataclass(frozen=True)
class Network:
    """Lazy results: pairs (merged correlations), links (after the filters),
    pattern, hubs and roles of each series, and the parameters used."""

    pairs: DataFrame
    links: DataFrame
    pattern: DataFrame
    hubs: DataFrame
    roles: DataFrame
    parameters: DataFrame


def diagnostics(panel: DataFrame) -> DataFrame:
    """The five measures that tune the thresholds, one row for each series."""
    whole = panel.groupBy("series_id").agg(
        F.stddev_pop("value").alias("gstd"), (F.stddev_pop("value") / (F.avg(F.abs("value")) + 1e-10)).alias("volatility")
    )
    step = sig.difference(panel).groupBy("series_id", "dim").agg(F.stddev_pop("d").alias("s"))
    temporal = step.groupBy("series_id").agg(F.avg("s").alias("temporal"))
    corr = pair_corr(panel).groupBy("series_id").agg(F.avg(F.abs("r")).alias("mean_corr"))
    rows = whole.join(temporal, "series_id").join(pn.shape(panel), "series_id").join(corr, "series_id", "left")
    rows = rows.withColumn("complexity", F.coalesce(1 - F.col("mean_corr"), F.lit(0.5))).na.fill(0.0, ["mean_corr"])
    return rows.join(block_variation(panel), "series_id", "left").na.fill(0.5, ["local_variation"]).join(low_frequency_share(panel), "series_id")


def block_variation(panel: DataFrame) -> DataFrame:
    """Spread over mean of the deviation in overlapping blocks of a tenth.

    A block of w frames starts every h = w div 2 frames, so it is two cells of h
    frames, and the first frame of the next cell where w is odd. Cells are summed
    once and put together; no frame is copied.
    """
    n = F.col("n_frames")
    size = F.greatest(F.lit(10), F.floor(n / 10))
    rows = panel.join(pn.shape(panel), "series_id").select("series_id", "t", "value", size.alias("w"), F.floor(size / 2).alias("h"), n.alias("n"))
    first = F.when(F.col("t") % F.col("h") == 0, F.col("value"))
    parts = [x for v, tag in ((F.col("value"), ""), (first, "1")) for x in (F.count(v).alias(f"n{tag}"), F.avg(v).alias(f"m{tag}"), F.var_pop(v).alias(f"v{tag}"))]
    cells = rows.groupBy("series_id", "n", "w", "h", F.floor(F.col("t") / F.col("h")).alias("k")).agg(*(x.alias(f"c{i}") for i, x in enumerate(parts)))
    cell = F.struct(F.col("c0").alias("n"), F.col("c1").alias("m"), F.col("c2").alias("v"))
    head = F.struct(F.col("c3").alias("n"), F.col("c4").alias("m"), F.col("c5").alias("v"))
    w = Window.partitionBy("series_id").orderBy("k")  # some twenty cells
    odd = F.when(F.col("w") % 2 == 1, F.lead(head, 2).over(w))
    blocks = cells.select("series_id", "k", "n", "w", "h", F.filter(F.array(cell, F.lead(cell).over(w), odd), lambda c: c.isNotNull()).alias("parts"))
    blocks = blocks.where(F.col("k") * F.col("h") < F.col("n") - F.col("w"))
    total = lambda f: F.aggregate(F.transform("parts", f), F.lit(0.0), lambda x, y: x + y)
    blocks = blocks.withColumn("count", total(lambda c: c["n"].cast("double"))).withColumn("mean", total(lambda c: c["n"] * c["m"]) / F.col("count"))
    sd = F.sqrt(total(lambda c: c["n"] * (c["v"] + F.pow(c["m"] - F.col("mean"), F.lit(2.0)))) / F.col("count"))
    cv = F.when(F.count("s") > 1, F.stddev_pop("s") / (F.avg("s") + 1e-10)).otherwise(0.5)
    return blocks.withColumn("s", sd).groupBy("series_id").agg(cv.alias("local_variation"))


def low_frequency_share(panel: DataFrame) -> DataFrame:
    """Share of the amplitude spectrum's first half that its first tenth holds."""
    n = F.col("n_frames")
    waves = amplitudes(panel).where(F.col("k") < F.greatest(F.lit(2), F.floor(n / 2)))
    low = F.col("k") < F.greatest(F.lit(1), F.floor(n / 10))
    amp = F.col("amplitude")
    return waves.groupBy("series_id").agg((F.sum(F.when(low, amp).otherwise(0.0)) / (F.sum(amp) + 1e-10)).alias("low_share"))


def adaptive_parameters(found: DataFrame, c: NetworkConfig) -> DataFrame:
    """sync_threshold, causal_threshold and max_lag of each series."""
    x = F.col
    sync = (
        F.when(x("volatility") > 2, 0.1).when(x("volatility") < 0.3, -0.1).otherwise(0.0)
        + F.when(x("mean_corr") > 0.6, 0.1).when(x("mean_corr") < 0.2, -0.1).otherwise(0.0)
        + F.when(x("local_variation") > 1, 0.05).otherwise(0.0)
    )
    causal = (
        F.when(x("temporal") < 0.3 * x("gstd"), -0.1).when(x("temporal") > 2 * x("gstd"), 0.1).otherwise(0.0)
        + F.when(x("n_dims") > 50, 0.1).when(x("n_dims") <= 5, -0.05).otherwise(0.0)
        + F.when(x("complexity") > 0.7, -0.05).otherwise(0.0)
    )
    scale = F.when(x("low_share") > 0.8, 1.5).when(x("low_share") < 0.3, 0.7).otherwise(1.0)
    scale = scale * F.when(x("complexity") > 0.7, 1.3).otherwise(1.0) * F.when(x("temporal") > 2 * x("gstd"), 0.8).otherwise(1.0)
    most = F.greatest(F.lit(5), F.floor(x("n_frames") / 5))
    return found.select(
        "series_id", "n_frames", "n_dims",
        sig.clipped(c.sync_threshold + sync, 0.15, 0.85).alias("sync_threshold"),
        sig.clipped(c.causal_threshold + causal, 0.15, 0.80).alias("causal_threshold"),
        sig.clipped(F.floor(F.lit(c.max_lag) * scale), 3, most).cast("int").alias("max_lag"),
    )


_LAGGED = "series_id string, src int, dst int, lag int, r double"


def view_correlations(panel: DataFrame, parameters: DataFrame, most_lag: int, value: str) -> DataFrame:
    """sync and best lagged partial correlation of every pair i < j.

    The moments for lag k run over the frames that have it. One sum over the
    frames that have all lags serves every lag; the last few frames are added
    for the lags they have. Each lag of a series is then solved by itself, all
    its pairs from one inverse of a matrix whose size depends on dimensions and
    lags alone.
    """
    ends = panel.groupBy("series_id").agg((F.max("t") + 1).alias("n"))
    wide = embedded_padded(panel, most_lag, value).join(ends, "series_id").withColumn("last", F.col("t") >= F.col("n") - most_lag)
    # Offsets beyond the lag are padding in the last frames; they are never read.
    own = F.when(F.col("last"), F.sequence(F.lit(0), (F.col("n") - F.col("t") - 1).cast("int"))).otherwise(F.array(F.lit(-1)))
    parts = gram_rows(wide.select("series_id", F.explode(own).alias("lag"), "v"), "series_id", "lag")
    # What all lags share is summed before each lag is given a copy of it.
    moments = written(summed(parts, "series_id", "lag"), "moments")
    every = F.when(F.col("lag") < 0, F.sequence(F.lit(0), F.col("max_lag"))).otherwise(F.array("lag"))
    sizes = parameters.select("series_id", "n_dims", "max_lag")
    rows = moments.join(sizes, "series_id").where("lag <= max_lag").select("series_id", "n_dims", F.explode(every).alias("lag"), "g")

    def solve(pdf):
        import numpy as np

        from ..functions.kernels import lagged_partials, precision_pcorr

        out, d, k = [], int(pdf["n_dims"].iloc[0]), int(pdf["lag"].iloc[0])
        g, name = sum(symmetric(x) for x in pdf["g"]), pdf["series_id"].iloc[0]
        n, s = g[-1, -1], g[-1, :d]
        if k == 0:
            cov = (g[:d, :d] - np.outer(s, s) / n) / max(n - 1, 1)
            if d >= 3:
                r = precision_pcorr(cov)
            else:
                sd = np.sqrt(np.maximum(np.diag(cov), 0))
                bottom = np.outer(sd, sd)
                r = np.where(bottom > 1e-20, cov / np.where(bottom > 1e-20, bottom, 1), 0.0)
            out = [(name, i, j, 0, float(r[i, j])) for i in range(d) for j in range(i + 1, d)]
        elif n > 1:  # a lag of all frames but one or more says nothing
            r = lagged_partials(g, d, k)
            out = [(name, a, b, k, float(r[a, b])) for a in range(d) for b in range(d) if a != b]
        return pd.DataFrame(out, columns=["series_id", "src", "dst", "lag", "r"])

    found = written(rows.groupBy("series_id", "lag").applyInPandas(solve, _LAGGED), "lagged")
    best = best_lag(found.where("lag > 0")).select(*PAIR, F.col("r").alias("causal"), "lag")
    sync = found.where("lag = 0").select("series_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("r").alias("sync"))
    return sync.join(best, PAIR, "left").select(*PAIR, "sync", F.coalesce("causal", F.lit(0.0)).alias("causal"), F.coalesce("lag", F.lit(0)).cast("int").alias("lag"))


def embedded_padded(panel: DataFrame, lags: int, value: str) -> DataFrame:
    """As embedded, the offsets past the end filled with 0."""
    tail = panel.groupBy("series_id", "dim").agg((F.max("t") + 1).alias("n")).select(
        "series_id", "dim", F.explode(F.sequence(F.col("n"), F.col("n") + lags - 1)).alias("t"), F.lit(0.0).alias(value)
    )
    return embedded(panel.select("series_id", "dim", "t", value).unionByName(tail), lags, value)


def merged_views(steps: DataFrame, raw: DataFrame) -> DataFrame:
    """Of each pair the view that holds; the raw one only where the steps agree."""
    d = steps.select(*PAIR, *(F.col(c).alias(f"d_{c}") for c in ("sync", "causal", "lag")))
    r = raw.select(*PAIR, *(F.col(c).alias(f"r_{c}") for c in ("sync", "causal", "lag")))
    use = F.expr(
        "abs(d_causal) > 0.1 AND abs(r_causal) > 1.1 * abs(r_sync) "
        "AND (NOT abs(d_causal) > 1.1 * abs(d_sync) OR abs(r_causal) > abs(d_causal))"
    )
    pick = lambda c: F.when(use, F.col(f"r_{c}")).otherwise(F.col(f"d_{c}")).alias(c)
    return d.join(r, PAIR).select(*PAIR, pick("sync"), pick("causal"), pick("lag"), use.cast("int").alias("from_raw"))


def tested_links(pairs: DataFrame, parameters: DataFrame, alpha: float) -> DataFrame:
    rows = pairs.join(parameters, "series_id").withColumn("n", F.col("n_frames") - 1)
    k = F.greatest(F.col("n_dims") - 2, F.lit(0))
    n_lag = F.greatest(F.col("n") - F.abs("lag"), F.lit(1))
    k_lag = F.greatest(F.least(F.col("n_dims") - 2, F.floor(n_lag / 4)), F.lit(0))
    rows = rows.select(
        "*",
        fisher_p(F.col("sync"), F.col("n"), k).alias("p_sync"),
        F.least(fisher_p(F.col("causal"), n_lag, k_lag) * 2 * F.col("max_lag"), F.lit(1.0)).alias("p_causal"),
    )
    return significant_links(g.with_bh(g.with_bh(rows, "p_sync", "q_sync"), "p_causal", "q_causal"), alpha)


def significant_links(rows: DataFrame, alpha: float) -> DataFrame:
    """The links that pairs with p and q of both kinds hold: a causal one runs
    the way of its lag."""
    common = ["series_id", "link_type", "src", "dst", "score", "corr", "lag", "sign", "p", "q"]
    sync = rows.where((F.col("q_sync") < alpha) & (F.abs("sync") > 0.15)).select(
        "series_id", F.lit("sync").alias("link_type"), F.col("i").alias("src"), F.col("j").alias("dst"), F.abs("sync").alias("score"),
        F.col("sync").alias("corr"), F.lit(0).alias("lag"), F.signum("sync").cast("int").alias("sign"), F.col("p_sync").alias("p"), F.col("q_sync").alias("q"),
    )
    forth = F.col("lag") > 0
    causal = rows.where(
        (F.col("q_causal") < alpha) & (F.abs("causal") > 0.8 * F.col("causal_threshold")) & (F.abs("causal") > 1.1 * F.abs("sync"))
    ).select(
        "series_id", F.lit("causal").alias("link_type"), F.when(forth, F.col("i")).otherwise(F.col("j")).alias("src"),
        F.when(forth, F.col("j")).otherwise(F.col("i")).alias("dst"), F.abs("causal").alias("score"), F.col("causal").alias("corr"),
        F.abs("lag").alias("lag"), F.signum("causal").cast("int").alias("sign"), F.col("p_causal").alias("p"), F.col("q_causal").alias("q"),
    )
    return sync.select(common).unionByName(causal.select(common))


def analyze(panel: DataFrame, config: NetworkConfig = NetworkConfig(), window: int | None = None) -> Network:
    """The network of every series; ``window`` keeps the first frames only for
    the correlations. Thresholds and scales still see the whole series."""
    panel = written(panel, "panel")
    if config.adaptive:
        parameters = adaptive_parameters(diagnostics(panel), config)
    else:
        parameters = pn.shape(panel).select(
            "*", F.lit(config.sync_threshold).alias("sync_threshold"), F.lit(config.causal_threshold).alias("causal_threshold"), F.lit(config.max_lag).alias("max_lag")
        )
    parameters = written(parameters, "parameters")
    # One number: how many offsets the moments must hold.
    most = parameters.agg(F.max("max_lag")).first()[0] or 1
    steps = sig.displacement(panel, config.local_std_window // 2)
    first = panel
    if window:
        steps, first = steps.where(F.col("t") < window - 1), panel.where(F.col("t") < window)
        parameters = parameters.withColumn("n_frames", F.least("n_frames", F.lit(window)))
    z = sig.zscore(first)
    pairs = merged_views(view_correlations(steps, parameters, most, "disp"), view_correlations(z, parameters, most, "z"))
    pairs = written(pairs, "pairs")
    links = written(tested_links(pairs, parameters, config.p_value), "links")
    causal = g.without_spurious(links.where("link_type = 'causal'"))
    links = links.where("link_type = 'sync'").unionByName(causal)
    dims = panel.select("series_id", "dim").distinct()
    series = dims.select("series_id").distinct()
    return Network(pairs, links, g.pattern(links, series), g.hubs(links, dims), g.roles(causal, dims), parameters)


def event_network(panel: DataFrame, event_frame: int, before: int = 24, after: int = 6, config: NetworkConfig = NetworkConfig()):
    """The network around an event, its initiators and the order of onset."""
    part = pn.frames_between(panel, max(0, event_frame - before), event_frame + after)
    return analyze(part, config), g.initiators(panel, event_frame, before), g.propagation_order(panel, event_frame, before)
