"""Jump events and the signed responses that follow them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import clipped, difference, near, rho_tension
from ..functions.tails import student_p
from .lagged import lag_pairs, same_frame_pairs
from .quantiles import percentiles

EDGE = ["series_id", "src", "dst"]


#: Steps are set against their threshold to so many decimals: sums taken in
#: another order must not make an event of a step that is the threshold.
DIGITS = 12


def jump_events(disp: DataFrame, percentile: float | Sequence[float] = 90.0) -> DataFrame:
    """disp with the dimension's threshold and event (-1, 0, 1). With several
    percentiles, the column percentile says which one a series has."""
    shares = [percentile] if isinstance(percentile, (int, float)) else list(percentile)
    cut = percentiles(disp, ["series_id", "dim"], F.abs("disp"), [p / 100 for p in shares])
    rows = disp.join(cut, ["series_id", "dim"])
    threshold = F.col("q")[0]
    for k, p in enumerate(shares[1:], 1):
        threshold = F.when(F.col("percentile") == p, F.col("q")[k]).otherwise(threshold)
    above = F.round(F.abs("disp"), DIGITS) > F.round("threshold", DIGITS)
    sign = F.when(above, F.signum("disp")).otherwise(0).cast("int")
    return rows.withColumn("threshold", threshold).drop("q").withColumn("event", sign)


def event_statistics(events: DataFrame) -> DataFrame:
    """density (share of frames with a jump) and cofiring (mean product over
    pairs of dimensions) of each series."""
    flag = events.withColumn("fired", F.abs("event").cast("double"))
    density = flag.groupBy("series_id").agg(F.avg("fired").alias("density"))
    pairs = same_frame_pairs(flag, "fired").groupBy("series_id", "i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("p"))
    return density.join(pairs.groupBy("series_id").agg(F.avg("p").alias("cofiring")), "series_id", "left")


def tension_variation(panel: DataFrame, window: int = 30) -> DataFrame:
    """Spread over mean of the trailing deviation: a diagnostic."""
    return rho_tension(panel, window).groupBy("series_id").agg((F.stddev_pop("rho") / (F.avg("rho") + 1e-10)).alias("rho_cv"))


def volatility_ratio(panel: DataFrame) -> DataFrame:
    """Mean deviation of the differences over the overall deviation."""
    per = difference(panel).groupBy("series_id", "dim").agg(F.stddev_pop("d").alias("s"))
    whole = panel.groupBy("series_id").agg(F.stddev_pop("value").alias("g"))
    return per.groupBy("series_id").agg(F.avg("s").alias("temporal")).join(whole, "series_id").select(
        "series_id", (F.col("temporal") / (F.col("g") + 1e-10)).alias("vol_ratio")
    )


def adaptive_jump_parameters(
    statistics: DataFrame, sizes: DataFrame, ratio: DataFrame, percentile: float = 90.0, window: int = 20, rho_window: int = 30
) -> DataFrame:
    """percentile, local_window, rho_window of each series."""
    rows = statistics.join(sizes, "series_id").join(ratio, "series_id")
    p = F.lit(float(percentile))
    p = F.when(F.col("density") > 0.15, F.least(p + 2, F.lit(97.0))).when(F.col("density") < 0.03, F.greatest(p - 3, F.lit(80.0))).otherwise(p)
    p = F.when(F.col("cofiring") > 0.02, F.least(p + 1, F.lit(97.0))).otherwise(p)
    p = F.when(F.col("n_dims") > 10, F.least(p + 1, F.lit(97.0))).otherwise(p)
    scale = F.when(F.col("n_frames") < 200, 0.7).when(F.col("n_frames") > 1000, 1.3).otherwise(1.0)
    scale = scale * F.when(F.col("vol_ratio") > 1.5, 0.8).otherwise(1.0)
    fifth = F.floor(F.col("n_frames") / 5)
    return rows.select(
        "series_id",
        p.alias("percentile"),
        clipped(F.floor(F.lit(window) * scale), 5, fifth).cast("int").alias("local_window"),
        clipped(F.floor(F.lit(rho_window) * scale), 5, fifth).cast("int").alias("rho_window"),
    )


def signed_responses(disp: DataFrame, max_lag: int) -> DataFrame:
    """Mean of y * sign(x), its t statistic and count for each (src, dst, lag)."""
    pairs = lag_pairs(disp, max_lag, "disp").withColumn("s", F.col("y") * F.signum("x"))
    stats = pairs.groupBy(*EDGE, "lag").agg(
        F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"), F.count("s").alias("n")
    )
    t = F.when(F.col("sd") > 1e-12, F.col("mean") / (F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    return stats.withColumn("t_stat", t)


def response_p(stats: DataFrame) -> DataFrame:
    """Two-sided p of each mean; 1 with two observations or fewer."""
    flat = F.when(F.abs("mean") > 0, 0.0).otherwise(1.0)
    p = F.when(F.col("n") <= 2, 1.0).otherwise(F.coalesce(student_p(F.col("t_stat"), F.col("n") - 1), flat))
    return stats.withColumn("p", p)


def jump_consistency(events: DataFrame, max_lag: int, least: int = 5) -> DataFrame:
    """max(r, 1 - r) of the share r of a source's jumps that the target follows
    in sign; 0.5 with fewer than ``least``."""
    jumps = events.where("event <> 0").select("series_id", "t", F.col("dim").alias("src"), F.col("event").alias("e"))
    lags = jumps.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn("at", F.col("t") + F.col("lag"))
    reply = events.select("series_id", F.col("t").alias("at"), F.col("dim").alias("dst"), F.col("disp").alias("y"))
    joined = lags.join(reply, ["series_id", "at"]).where("src <> dst")
    share = F.avg((F.col("y") * F.col("e") > 0).cast("double"))
    found = joined.groupBy(*EDGE, "lag").agg(share.alias("r"), F.count(F.lit(1)).alias("n_jumps"))
    held = F.when(F.col("n_jumps") < least, 0.5).otherwise(F.greatest(F.col("r"), 1 - F.col("r")))
    return found.select(*EDGE, "lag", "n_jumps", held.alias("consistency"))


def best_response(stats: DataFrame, consistency: DataFrame) -> DataFrame:
    """Of each (src, dst) the lag of largest |mean| (1 + 2 (c - 0.5)); ties to
    the smaller lag. A score of 0: lag 0, sign 0, consistency 0.5, p 1."""
    joined = stats.join(consistency.select(*EDGE, "lag", "consistency"), [*EDGE, "lag"], "left").withColumn(
        "consistency", F.coalesce("consistency", F.lit(0.5))
    )
    score = F.abs("mean") * (1 + 2 * (F.col("consistency") - 0.5))
    w = Window.partitionBy(*EDGE).orderBy(F.desc("score"), "lag")
    first = joined.withColumn("score", score).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    some = F.col("score") > 0
    return first.select(
        *EDGE,
        "score",
        F.when(some, F.col("mean")).otherwise(0.0).alias("raw"),
        F.when(some, F.col("lag")).otherwise(0).cast("int").alias("lag"),
        F.when(some, F.signum("mean")).otherwise(0).cast("int").alias("sign"),
        F.when(some, F.col("consistency")).otherwise(0.5).alias("consistency"),
        *([F.when(some, F.col("p")).otherwise(1.0).alias("p")] if "p" in stats.columns else []),
    )


def conditional_propagation(events: DataFrame, triples: DataFrame) -> DataFrame:
    """For (a, z, b, lag): P(b fires at t + lag | a fires at t) where z is, or
    is not, active within two frames of t; 0 where nothing is left to count."""
    fired = events.withColumn("fired", F.abs("event"))
    active = near(fired, "fired", "active")
    last = fired.groupBy("series_id").agg(F.max("t").alias("last"))
    a = fired.where("fired = 1").join(last, "series_id").select("series_id", F.col("dim").alias("a"), "t", "last")
    z = active.select("series_id", F.col("dim").alias("z"), "t", "active")
    b = fired.select("series_id", F.col("dim").alias("b"), F.col("t").alias("at"), F.col("fired").alias("followed"))
    rows = a.join(triples, ["series_id", "a"]).withColumn("at", F.col("t") + F.col("lag"))
    rows = rows.where("at <= last").join(z, ["series_id", "z", "t"]).join(b, ["series_id", "b", "at"])
    with_z, without = F.col("active") == 1, F.col("active") == 0
    share = lambda c: F.coalesce(F.avg(F.when(c, F.col("followed").cast("double"))), F.lit(0.0))
    return rows.groupBy("series_id", "a", "z", "b", "lag").agg(
        share(with_z).alias("p_with"), share(without).alias("p_without"),
        F.count_if(with_z).alias("n_with"), F.count_if(without).alias("n_without"),
    )


def spurious_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    """(series_id, src, dst) that a common ancestor or a mediator explains.

    All tests read the unfiltered scores, so one pass settles every edge.
    """
    e = edges.where("score > 0").select(*EDGE, "score", "lag")
    ab = e.select("series_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("score").alias("s_ab"), F.col("lag").alias("l_ab"))
    out_of = lambda x, y, tag: e.select(
        "series_id", F.col("src").alias(x), F.col("dst").alias(y), F.col("score").alias(f"s_{tag}"), F.col("lag").alias(f"l_{tag}")
    )
    up = ab.join(out_of("z", "a", "za"), ["series_id", "a"]).join(out_of("z", "b", "zb"), ["series_id", "z", "b"]).where(
        "z <> b AND s_za > s_ab AND s_zb > s_ab AND abs(l_za + l_ab - l_zb) <= greatest(1, l_zb div 3)"
    )
    mid = ab.join(out_of("a", "z", "az"), ["series_id", "a"]).join(out_of("z", "b", "zb"), ["series_id", "z", "b"]).where(
        "z <> b AND abs(l_az + l_zb - l_ab) <= greatest(2, l_ab div 2)"
    )
    asked = up.selectExpr("series_id", "a", "z", "b", "l_ab AS lag").unionByName(
        mid.selectExpr("series_id", "a", "z", "b", "l_ab AS lag")
    ).distinct()
    p = conditional_propagation(events, asked).withColumnRenamed("lag", "l_ab")
    on = ["series_id", "a", "z", "b", "l_ab"]
    none = {"p_with": 0.0, "p_without": 0.0, "n_with": 0, "n_without": 0}
    ancestor = up.join(p, on, "left").na.fill(none).where(
        "p_without < 0.5 * s_ab AND p_with > 1.5 * p_without OR n_without < 3"
    )
    mediator = mid.join(p, on, "left").na.fill(none).where(
        "abs(l_az + l_zb - l_ab) <= 1 AND least(s_az, s_zb) >= s_ab OR p_without < 0.4 * s_ab AND p_with > 2 * p_without"
    )
    named = lambda d: d.selectExpr("series_id", "a AS src", "b AS dst")
    return named(ancestor).unionByName(named(mediator)).distinct()


def stronger_mediators(edges: DataFrame) -> DataFrame:
    """(series_id, src, dst, lag, m, m_lag) for each edge and each m with a
    higher score from the same source."""
    to_m = edges.where("lag > 0").select("series_id", "src", F.col("dst").alias("m"), F.col("score").alias("m_score"), F.col("lag").alias("m_lag"))
    rows = edges.where("lag > 0").join(to_m, ["series_id", "src"]).where("m <> dst AND m_score > score")
    return rows.select(*EDGE, "lag", "m", "m_lag")


def unexplained_jumps(events: DataFrame, mediators: DataFrame) -> DataFrame:
    """For each edge of ``stronger_mediators`` the source's jumps at t with none
    of m's jumps within one frame of t + lag(src, m), for any m."""
    jumps = events.where("event <> 0").select("series_id", "t", "dim", "event")
    own = mediators.select(*EDGE, "lag").distinct().join(jumps.withColumnRenamed("dim", "src"), ["series_id", "src"])
    near_m = jumps.select("series_id", F.col("dim").alias("m"), F.explode(F.array(F.col("t") - 1, F.col("t"), F.col("t") + 1)).alias("near"))
    hit = mediators.join(near_m, ["series_id", "m"]).select(*EDGE, (F.col("near") - F.col("m_lag")).alias("t")).distinct()
    return own.join(hit, [*EDGE, "t"], "left_anti")
