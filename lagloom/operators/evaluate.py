"""Scoring found edges against the truth, and two baseline statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import difference
from ..sources.panel import windowed
from ..sources.written import written
from .lagged import lag_pairs
from .quantiles import percentiles


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)


def edge_metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per series: directed and undirected precision, recall, F1; lag error and
    sign accuracy over true positives (null without any); share of forbidden
    edges found (null without any)."""
    on = ["series_id", "src", "dst"]
    rows = truth.select(*on, "is_edge", F.col("lag").alias("true_lag"), F.col("sign").alias("true_sign"), "forbidden").join(
        found.select(*on, F.col("is_edge").alias("hit"), "lag", "sign"), on, "left"
    ).na.fill({"hit": 0})
    tp, fp, fn = (F.count_if(F.expr(c)) for c in ("is_edge = 1 AND hit = 1", "is_edge = 0 AND hit = 1", "is_edge = 1 AND hit = 0"))
    both = F.expr("is_edge = 1 AND hit = 1")
    directed = rows.groupBy("series_id").agg(
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_directed"),
        F.avg(F.when(both, F.abs(F.col("lag") - F.col("true_lag")))).alias("lag_mae"),
        F.avg(F.when(both, (F.col("sign") == F.col("true_sign")).cast("double"))).alias("sign_accuracy"),
        F.avg(F.when(F.col("forbidden") == 1, F.col("hit").cast("double"))).alias("spurious_rate"),
    )
    pairs = rows.groupBy("series_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max("is_edge").alias("is_edge"), F.max("hit").alias("hit")
    )
    plain = pairs.groupBy("series_id").agg(_ratio(2 * tp, 2 * tp + fp + fn).alias("f1_undirected"))
    return directed.join(plain, "series_id")


def composite(metrics: DataFrame) -> DataFrame:
    """(1.5 F1d + F1u + 1 / (1 + lag error) + 0.8 sign + 0.8 (1 - spurious)) / 5.1."""
    lag = F.coalesce(1 / (1 + F.col("lag_mae")), F.lit(0.0))
    sign, spur = F.coalesce("sign_accuracy", F.lit(0.0)), F.coalesce("spurious_rate", F.lit(0.5))
    return metrics.withColumn(
        "composite", (1.5 * F.col("f1_directed") + F.col("f1_undirected") + lag + 0.8 * sign + 0.8 * (1 - spur)) / 5.1
    )


def method_summary(metrics: DataFrame) -> DataFrame:
    """The mean of every metric for each method (nulls left out), the composite
    of the means and the method's place by it."""
    names = [c for c in metrics.columns if c not in ("method", "series_id")]
    means = composite(metrics.groupBy("method").agg(*(F.avg(c).alias(c) for c in names)))
    return means.withColumn("place", F.rank().over(Window.orderBy(F.desc("composite"))))


def boundary_f1(found: DataFrame, truth: DataFrame, tolerance: int = 5) -> DataFrame:
    """Per series, F1 of boundaries (series_id, t): each true one, in order, takes
    the first found one within the tolerance that no earlier one took; 1 without
    any on either side, 0 with some on one side only. A series' boundaries travel
    as one array: they are the ends of its segments, not its frames."""
    a = truth.groupBy("series_id").agg(F.sort_array(F.collect_list("t")).alias("truth"))
    b = found.groupBy("series_id").agg(F.sort_array(F.collect_list("t")).alias("found"))
    rows = a.join(b, "series_id", "full").select(
        "series_id", *(F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("truth", "found"))
    )
    near = lambda left, x: F.filter(left, lambda y: F.abs(x - y) <= tolerance)
    taken = F.aggregate(  # what is left of the found ones
        "truth", F.col("found"),
        lambda left, x: F.when(F.size(near(left, x)) == 0, left).otherwise(
            F.concat(F.slice(left, F.lit(1), F.array_position(left, F.get(near(left, x), F.lit(0))).cast("int") - 1),
                     F.slice(left, F.array_position(left, F.get(near(left, x), F.lit(0))).cast("int") + 1, F.size(left)))
        ),
    )
    hits = F.size("found") - F.size(taken)
    both = F.size("truth") + F.size("found")
    return rows.select("series_id", F.when(both == 0, 1.0).otherwise(2 * hits / F.greatest(both, F.lit(1))).alias("boundary_f1"))


def ranking_metrics(scores: DataFrame) -> DataFrame:
    """AUC, average precision, and F, FPR, TPR, true-lag share at the threshold
    of best F, from (series_id, score, label, lag_ok). Without positives, with
    only positives, or with equal scores, all are 0."""
    at = scores.groupBy("series_id", "score").agg(
        F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"), F.sum(F.col("label") * F.col("lag_ok")).alias("lag_hits")
    )
    w = Window.partitionBy("series_id")
    down = w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    below = w.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rows = at.select(
        "series_id", "score", "pos", "n",
        F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("called"), F.sum("lag_hits").over(down).alias("lags"),
        F.sum("pos").over(w).alias("all_pos"), F.sum("n").over(w).alias("all_n"), F.count(F.lit(1)).over(w).alias("levels"),
        F.coalesce(F.sum(F.col("n") - F.col("pos")).over(below), F.lit(0)).alias("neg_below"),
    )
    usable = F.expr("all_pos > 0 AND all_pos < all_n AND levels > 1")
    p, r = F.col("tp") / F.col("called"), F.col("tp") / F.nullif(F.col("all_pos"), F.lit(0))
    rows = rows.withColumn("f", 2 * p * r / (p + r + 1e-10)).withColumn("ap_part", F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * p)
    negatives = F.nullif(F.max("all_n") - F.max("all_pos"), F.lit(0))
    auc = F.sum(F.col("pos") * (F.col("neg_below") + (F.col("n") - F.col("pos")) / 2)) / (F.nullif(F.max("all_pos"), F.lit(0)) * negatives)
    totals = rows.groupBy("series_id").agg(auc.alias("auc"), F.sum("ap_part").alias("average_precision"), F.max(usable).alias("usable"))
    best = rows.withColumn("_n", F.row_number().over(w.orderBy(F.desc("f"), "score"))).where("_n = 1").select(
        "series_id", "f",
        ((F.col("called") - F.col("tp")) / F.nullif(F.col("all_n") - F.col("all_pos"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("all_pos"), F.lit(0))).alias("tpr"),
        (F.col("lags") / F.nullif(F.col("tp"), F.lit(0))).alias("true_lag_share"),
    )
    joined = totals.join(best, "series_id")
    names = ["auc", "average_precision", "f", "fpr", "tpr", "true_lag_share"]
    return joined.select("series_id", *(F.when(F.col("usable"), F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in names))


def quantile_bins(panel: DataFrame, bins: int = 4) -> DataFrame:
    """panel with bin: how many inner quantiles are <= value. Equal quantiles
    count once; a constant dimension has bin 0."""
    by = ["series_id", "dim"]
    cuts = [k / bins for k in range(bins + 1)]
    panel = written(panel, "panel")
    edges = percentiles(panel, by, "value", cuts).select(*by, F.array_sort(F.array_distinct("q")).alias("e"))
    n = F.size("e")
    even = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda k: F.element_at("e", 1) + (F.element_at("e", -1) - F.element_at("e", 1)) * k / bins)
    edges = edges.withColumn("e", F.when(n > 2, F.col("e")).when(n == 2, even).otherwise(F.array().cast("array<double>")))
    inner = F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0)))
    return panel.join(edges, by).select(*panel.columns, F.size(F.filter(inner, lambda c: c <= F.col("value"))).alias("bin"))


def transfer_entropy(panel: DataFrame, max_lag: int, bins: int = 4) -> DataFrame:
    """Per (src, dst, lag): information that the source's bin at t - lag adds
    about the target's at t beyond its own at t - 1; 0 for five frames or less."""
    binned = quantile_bins(panel, bins)
    # x at t - lag, y one frame before t, z at t; the lag join gives x and z.
    past = windowed(binned, lambda r, w: r.withColumn("before", F.lag("bin").over(w)), before=1)
    a = past.select("series_id", "t", F.col("dim").alias("src"), F.col("bin").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"))
    b = past.select("series_id", F.col("t").alias("at"), F.col("dim").alias("dst"), F.col("before").alias("y"), F.col("bin").alias("z"))
    rows = a.withColumn("at", F.col("t") + F.col("lag")).join(b, ["series_id", "at"]).where("src <> dst AND y IS NOT NULL")
    key = ["series_id", "src", "dst", "lag"]
    counts = rows.groupBy(*key, "x", "y", "z").agg(F.count(F.lit(1)).alias("c_xyz"))
    over = lambda *c: F.sum("c_xyz").over(Window.partitionBy(*key, *c))
    counts = counts.select("*", over("x", "y").alias("c_xy"), over("y", "z").alias("c_yz"), over("y").alias("c_y"), over().alias("n"))
    part = F.col("c_xyz") / F.col("n") * F.ln((F.col("c_xyz") / F.col("c_xy")) / (F.col("c_yz") / F.col("c_y")))
    return counts.groupBy(*key).agg(F.when(F.max("n") > 5, F.sum(part)).otherwise(0.0).alias("te"))


def event_cross_correlation(panel: DataFrame, max_lag: int, percentile: float = 97.0) -> DataFrame:
    """Per (src, dst, lag): mean product of large-step flags at that lag."""
    step = written(difference(panel).withColumn("d", F.abs("d")), "steps")
    cut = percentiles(step, ["series_id", "dim"], "d", [percentile / 100])
    # to nine decimals, so that a step that is the threshold isn't above it
    above = F.round("d", 9) > F.round(F.col("q")[0], 9)
    fired = step.join(cut, ["series_id", "dim"]).withColumn("e", above.cast("double"))
    return lag_pairs(fired, max_lag, "e").groupBy("series_id", "src", "dst", "lag").agg(F.avg(F.col("x") * F.col("y")).alias("score"))


def shuffled(panel: DataFrame, permutations: int, seed: int = 0) -> DataFrame:
    """panel with run, and in each run the frames of each dimension in an order
    of their own: that of md5 of seed, run, dimension and frame. A frame's place
    is counted inside its first four hex digits and over those before, so a long
    series is spread over tasks."""
    key = [*(c for c in ("series_id", "run", "dim")), "_part"]
    mark = F.md5(F.concat_ws(",", F.lit(seed), "run", "dim", "t"))
    runs = panel.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("_mark", mark).withColumn("_part", F.substring("_mark", 1, 4))
    before = F.sum("_n").over(Window.partitionBy(*key[:3]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(*key, F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.col("_base") + F.row_number().over(Window.partitionBy(*key).orderBy("_mark", "t")) - 1
    return runs.join(parts, key).withColumn("t", place.cast("long")).drop("_mark", "_part", "_base")


def permutation_p(panel: DataFrame, score, best: DataFrame, permutations: int = 30, seed: int = 0) -> DataFrame:
    """(1 + runs that reach the best score) / (runs + 1), each dimension's frames
    shuffled in each run: one job for all runs, as series of their own."""
    mixed = shuffled(panel, permutations, seed)
    named = mixed.withColumn("series_id", F.concat_ws("\u0001", "series_id", F.col("run").cast("string")))
    null = score(named.drop("run"))
    null = null.withColumn("series_id", F.substring_index("series_id", "\u0001", 1)).withColumnRenamed("score", "null_score")
    joined = best.join(null, ["series_id", "src", "dst"], "left")
    return joined.groupBy("series_id", "src", "dst", "score").agg(
        ((1 + F.count_if(F.col("null_score") >= F.col("score"))) / (permutations + 1)).alias("p")
    )
