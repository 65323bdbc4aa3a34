"""Composing, fusing and cutting edge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import clipped, of_largest, saturated
from ..functions.tails import fisher_p
from ..sources.written import written
from .graph import indirect_support, rank_share, with_bh
from .quantiles import percentiles

EDGE = ["series_id", "src", "dst"]


def _with_percentile(rows: DataFrame, value: Column, share: float, keys=("series_id",), name: str = "_cut") -> DataFrame:
    """rows with the percentile of a value over the rows of their keys."""
    rows = written(rows, "scored")
    cut = percentiles(rows, keys, value, [share]).select(*keys, F.col("q")[0].alias(name))
    return rows.join(cut, list(keys), "left")


def binarized(edges: DataFrame, threshold: float | None = None, percentile: float = 65.0) -> DataFrame:
    """is_edge: score above the threshold, or above the percentile of the
    series' positive scores."""
    rows = edges.withColumn("_cut", F.lit(threshold)) if threshold is not None else _with_percentile(edges, F.when(F.col("score") > 0, F.col("score")), percentile / 100)
    return rows.withColumn("is_edge", F.coalesce(F.col("score") > F.col("_cut"), F.lit(False)).cast("int")).drop("_cut")


def binarized_at_least(edges: DataFrame, threshold: float | None = None, percentile: float = 75.0, symmetric: bool = False) -> DataFrame:
    """is_edge: score reaches the threshold, or the percentile of all the
    series' scores; if symmetric, an edge either way counts both ways."""
    rows = edges.withColumn("_cut", F.lit(threshold)) if threshold is not None else _with_percentile(edges, F.col("score"), percentile / 100)
    rows = rows.withColumn("is_edge", F.coalesce(F.col("score") >= F.col("_cut"), F.lit(False)).cast("int")).drop("_cut")
    if not symmetric:
        return rows
    pair = Window.partitionBy("series_id", F.least("src", "dst"), F.greatest("src", "dst"))
    return rows.withColumn("is_edge", F.max("is_edge").over(pair))


def confident(edges: DataFrame, quantile: float = 0.5, least: float = 1e-6) -> DataFrame:
    """Links whose confidence reaches the series' quantile of it."""
    rows = _with_percentile(edges, F.greatest("confidence", F.lit(0.0)), quantile)
    return rows.where(F.col("confidence") >= F.greatest("_cut", F.lit(least))).drop("_cut")


def strong(edges: DataFrame, least: float = 1e-6) -> DataFrame:
    return edges.where((F.col("score") > least) & (F.col("src") != F.col("dst")))


def mixed_score(block: str = "block_norm", delta: str = "delta_mse", confidence: str = "confidence") -> Column:
    """0.65 of the norm and 0.35 of (0.65 gain + 0.35 confidence), each as a
    share of the series' largest."""
    gain = 0.65 * of_largest(F.col(delta)) + 0.35 * of_largest(F.col(confidence))
    return 0.65 * of_largest(F.col(block)) + 0.35 * gain


def anomaly_score(rows: DataFrame, value: str = "block_norm") -> DataFrame:
    """Per target: distance from the median in robust deviations, boosted in
    steps (above 3, 1.5 and 0.5), as a share of the series' largest."""
    by = ("series_id", "dst")
    med = _with_percentile(rows, F.col(value), 0.5, by, "_m")
    mad = _with_percentile(med, F.abs(F.col(value) - F.col("_m")), 0.5, by, "_d")
    z = (F.col(value) - F.col("_m")) / (1.4826 * F.col("_d") + 1e-12)
    boost = F.when(F.col("_z") > 3, 2.0).when(F.col("_z") > 1.5, 1.5).when(F.col("_z") > 0.5, 1.0).otherwise(0.3)
    raw = mad.withColumn("_z", z).withColumn("_s", F.greatest(F.col(value), F.lit(0.0)) * boost)
    return raw.withColumn("anomaly", of_largest(F.col("_s"))).drop("_m", "_d", "_z", "_s")


def correlation_gate(pairs: DataFrame, sizes: DataFrame, ar_lag: int = 1, max_lag: int = 5) -> DataFrame:
    """Mean and largest |r|, features per sample and the regime of a series."""
    stats = pairs.groupBy("series_id").agg(F.avg(F.abs("r")).alias("mean_corr"), F.max(F.abs("r")).alias("max_corr"))
    rows = stats.join(sizes, "series_id")
    samples = F.greatest(F.col("n_frames") - max(ar_lag, max_lag), F.lit(1))
    kind = F.when(F.col("mean_corr") < 0.10, "weak").when(F.col("mean_corr") < 0.20, "moderate").otherwise("strong")
    return rows.withColumn("feature_ratio", (ar_lag + (F.col("n_dims") - 1) * max_lag) / samples).withColumn("regime", kind)


def direct_scores(edges: DataFrame, lam: float = 1.0, tau: float = 1.0, alpha: float = 0.35, eps: float = 1e-12) -> DataFrame:
    """Direct against indirect influence, from each edge's raw score, lag,
    delta_mse and its target's baseline, self_only, null and pair errors."""
    g_self = F.greatest(F.col("self_mse") - F.col("baseline_mse"), F.lit(0.0))
    g_null = F.greatest(F.col("null_mse") - F.col("baseline_mse"), F.lit(0.0))
    denom = F.greatest(g_self, 0.25 * g_null, F.lit(eps))
    ratio = g_self / (g_null + eps)
    eta, beta = clipped(1 - ratio, 0.2, 0.9), clipped(1 - 0.5 * ratio, 0.5, 0.9)
    rows = edges.select(
        "*",
        saturated(F.greatest(F.col("delta_mse"), F.lit(0.0)) / denom).alias("unique"),
        saturated(F.greatest(F.col("self_mse") - F.col("pair_mse"), F.lit(0.0)) / denom).alias("marginal"),
        eta.alias("_eta"),
        beta.alias("_beta"),
    ).withColumn("necessity", F.col("_eta") * F.col("unique") + (1 - F.col("_eta")) * F.col("marginal"))
    rows = indirect_support(rows, tau, eps)
    kept = clipped(F.col("necessity") / (F.col("necessity") + lam * F.col("indirect") + eps), 0.0, 1.0)
    rows = rows.withColumn("irreducibility", kept)
    base = alpha * of_largest(F.col("raw")) + (1 - alpha) * of_largest(F.col("necessity"))
    return rows.withColumn("direct_score", base * (F.col("_beta") + (1 - F.col("_beta")) * F.col("irreducibility"))).drop("_eta", "_beta")


def causal_q(pairs: DataFrame, max_lag: int, n_dims: Column, n: Column) -> DataFrame:
    """Directed p and q from one lagged correlation for each pair i < j: the
    lag's direction gets the p (lag 0: both), the other direction 1."""
    left = F.greatest(n - F.abs("lag"), F.lit(1))
    k = F.greatest(F.least(n_dims - 2, F.floor(left / 4)), F.lit(0))
    p = F.least(fisher_p(F.col("r"), left, k) * (2 * max_lag), F.lit(1.0))
    rows = pairs.withColumn("_p", p)
    forth = rows.select("series_id", F.col("i").alias("src"), F.col("j").alias("dst"), F.when(F.col("lag") >= 0, F.col("_p")).otherwise(1.0).alias("p"))
    back = rows.select("series_id", F.col("j").alias("src"), F.col("i").alias("dst"), F.when(F.col("lag") <= 0, F.col("_p")).otherwise(1.0).alias("p"))
    return with_bh(forth.unionByName(back))


def _decided(edges: DataFrame, alpha: float) -> DataFrame:
    rows = _with_percentile(edges, F.when(F.col("fused") > 0, F.col("fused")), 0.5)
    return rows.withColumn("is_edge", ((F.col("q") < alpha) & (F.col("fused") > F.coalesce("_cut", F.lit(0.0)))).cast("int")).drop("_cut")


def fuse_suppress(edges: DataFrame, alpha: float = 0.05, floor: float = 0.05) -> DataFrame:
    """raw, structure and q (and jump, jump_q if there) into fused, is_edge."""
    x = of_largest(F.col("raw")) * (0.7 + 0.3 * of_largest(F.col("structure"))) * F.when(F.col("q") < alpha, 1.0).otherwise(floor)
    if "jump" in edges.columns:
        x = x * (0.3 + 0.7 * of_largest(F.col("jump")))
    if "jump_q" in edges.columns:
        x = x * F.when(F.col("jump_q") < alpha, 1.0).otherwise(floor)
    return _decided(edges.withColumn("fused", x), alpha)


def fuse_geometric(edges: DataFrame, weights=(0.4, 0.3, 0.3), alpha: float = 0.05) -> DataFrame:
    """Weighted geometric mean of raw, significance and structure shares."""
    total = sum(weights)
    stat = -F.log10(F.col("q") + 1e-300)
    parts = (of_largest(F.col("raw")), of_largest(stat), of_largest(F.col("structure")))
    x = F.lit(1.0)
    for part, w in zip(parts, weights, strict=True):
        x = x * F.pow(F.greatest(part, F.lit(1e-300)), F.lit(w / total))
    return _decided(edges.withColumn("fused", x), alpha)


def consensus(edges: DataFrame, weights=(0.4, 0.3, 0.3)) -> DataFrame:
    """Weighted sum of the ranks of raw, significance and structure."""
    rows = edges.withColumn("_stat", -F.log10(F.col("q") + 1e-300))
    total = sum(weights)
    ranks = [rank_share(c, "series_id") * (w / total) for c, w in zip(("raw", "_stat", "structure"), weights, strict=True)]
    return rows.withColumn("consensus", ranks[0] + ranks[1] + ranks[2]).drop("_stat")
