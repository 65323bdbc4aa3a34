"""Regimes: features, clusters, smoothing, segments, transitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import windowed
from ..sources.written import written
from .lagged import same_frame_pairs


def rolling_coherence(panel: DataFrame, window: int = 20, value: str = "value") -> DataFrame:
    """Mean |corr| over pairs of the last ``window`` frames; 0 under three."""

    def add(rows, w):
        w = w.rowsBetween(-(window - 1), 0)
        return rows.select(
            "*", F.count(F.lit(1)).over(w).alias("n"), F.covar_pop("x", "y").over(w).alias("c"),
            F.stddev_pop("x").over(w).alias("sx"), F.stddev_pop("y").over(w).alias("sy"),
        )

    pairs = windowed(same_frame_pairs(panel, value), add, before=window - 1, keys=("series_id", "i", "j"))
    r = F.when(F.expr("n < 3 OR sx < 1e-9 OR sy < 1e-9"), 0.0).otherwise(F.abs(F.col("c") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0))))
    return pairs.groupBy("series_id", "t").agg(F.avg(r).alias("coherence"))


def frame_features(panel: DataFrame, windows: tuple[int, ...] = (5, 20, 50)) -> DataFrame:
    """One row of z-scored features for each frame: moments over dimensions of
    the values and their steps, coherence, low-frequency share, and rolling
    statistics of the mean step and the mean square."""
    steps = windowed(panel, lambda r, w: r.withColumn("d", F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0))), before=1)
    base = steps.groupBy("series_id", "t").agg(
        F.avg(F.abs("value")).alias("f_abs"), F.stddev_pop("value").alias("f_sd"),
        F.avg(F.abs("d")).alias("f_step"), F.stddev_pop("d").alias("f_step_sd"),
        F.avg(F.col("value") * F.col("value")).alias("f_square"), F.avg(F.col("d") * F.col("d")).alias("f_step_square"),
    )
    rows = base.join(rolling_coherence(panel).withColumnRenamed("coherence", "f_coherence"), ["series_id", "t"], "left")
    rows = rows.join(low_frequency(panel), ["series_id", "t"], "left")

    def rolled(rows, w):
        over = {n: w.rowsBetween(-(n - 1), 0) for n in windows}
        pairs = [(c, n) for n in windows for c in ("f_step", "f_square")]
        return rows.select("*", *(x for c, n in pairs for x in (F.avg(c).over(over[n]).alias(f"{c}_mean{n}"), F.stddev_pop(c).over(over[n]).alias(f"{c}_sd{n}"))))

    rows = windowed(rows, rolled, before=max(windows) - 1, keys=("series_id",))
    names = [c for c in rows.columns if c.startswith("f_")]
    finite = {c: F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)) for c in names}
    rows = written(rows.select("series_id", "t", *(x.alias(c) for c, x in finite.items())), "features")
    stats = rows.groupBy("series_id").agg(*(x for c in names for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    z = [(F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-12, 1.0).otherwise(F.col(f"_s_{c}")) for c in names]
    return rows.join(stats, "series_id").select("series_id", "t", F.array(*z).alias("features"))


#: What frame_features holds, in order.
FEATURES = ["f_abs", "f_sd", "f_step", "f_step_sd", "f_square", "f_step_square", "f_coherence", "f_low"]
FEATURES += [f"{c}_{s}{n}" for n in (5, 20, 50) for c in ("f_step", "f_square") for s in ("mean", "sd")]


#: The longest window of low_frequency and the frames of one of its blocks.
WIDEST, SPECTRAL_BLOCK = 64, 4096


def low_frequency(panel: DataFrame, size: int | None = None) -> DataFrame:
    """f_low: share that the lowest quarter of the spectrum has in the amplitudes
    of all dimensions over the last frames; 0 with fewer than eight. A series'
    window is a quarter of its frames, 16 to 64 (all of under twenty).

    A sliding transform: per frequency the running sums of x cos and x sin, and
    their differences over the window's ends; the start of the phase doesn't
    change an amplitude. The row one window earlier is the one before in the
    order of its residue, so the differences take a sort and no shuffle. Frames
    before the first whole window are few and transformed by themselves.
    """
    n = panel.groupBy("series_id", "dim").agg(F.count(F.lit(1)).alias("n"))
    wide = F.greatest(F.lit(16), F.least(F.lit(WIDEST), F.when(F.col("n") >= 20, F.floor(F.col("n") / 4)).otherwise(F.col("n")))).cast("int")
    rows = panel.select("series_id", "dim", "t", "value").join(n.select("series_id", "dim", wide.alias("w")), ["series_id", "dim"])
    waves = range(WIDEST // 2 + 1)

    def slid(rows, w):
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        angle = [F.lit(2 * math.pi) * ((k * F.col("t")) % F.col("w")) / F.col("w") for k in waves]
        sums = [F.sum(F.col("value") * f(a)).over(upto) for a in angle for f in (F.cos, F.sin)]
        rows = rows.select("*", F.array(*sums).alias("_sums"))
        earlier = Window.partitionBy("series_id", "dim", "_block", F.col("t") % F.col("w")).orderBy("t")
        return rows.withColumn("_before", F.lag("_sums").over(earlier))

    found = windowed(rows, slid, before=WIDEST, size=size or SPECTRAL_BLOCK).where("t >= w - 1")
    part = lambda i: F.col("_sums")[i] - F.coalesce(F.col("_before")[i], F.lit(0.0))
    size_of = [F.when(F.lit(k) <= F.floor(F.col("w") / 2), F.sqrt(part(2 * k) * part(2 * k) + part(2 * k + 1) * part(2 * k + 1))).otherwise(0.0) for k in waves]
    found = found.select("series_id", "t", F.array(*size_of).alias("a"), F.expr("greatest(1, (w div 2 + 1) div 4)").alias("low"))
    first = rows.where("t < w - 1").groupBy("series_id", "dim", "w").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("x"))
    first = first.select("series_id", F.transform("x", lambda x: x["value"]).alias("x"), F.posexplode("x").alias("t", "_"))
    first = first.select("series_id", F.col("t").cast("long").alias("t"), F.slice("x", F.lit(1), F.col("t") + 1).alias("x")).where("t >= 7")

    def amplitude(k):
        def summed(f):
            turned = F.transform("x", lambda v, i: v * f(F.lit(2 * math.pi) * ((k * i) % F.size("x")) / F.size("x")))
            return F.aggregate(turned, F.lit(0.0), lambda a, b: a + b)

        return F.sqrt(F.pow(summed(F.cos), F.lit(2.0)) + F.pow(summed(F.sin), F.lit(2.0)))

    first = first.select(
        "series_id", "t", F.transform(F.sequence(F.lit(0), F.expr("size(x) div 2")), amplitude).alias("a"), F.expr("greatest(1, (size(x) div 2 + 1) div 4)").alias("low")
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    shares = found.unionByName(first).select("series_id", "t", total(F.slice("a", F.lit(1), F.col("low").cast("int"))).alias("low"), total("a").alias("all"))
    shares = shares.groupBy("series_id", "t").agg((F.sum("low") / (F.sum("all") + 1e-12)).alias("f_low"))
    return panel.select("series_id", "t").distinct().join(shares, ["series_id", "t"], "left").na.fill(0.0)


def clusters(
    features: DataFrame, k: int = 3, least: int = 1, rounds: int = 100, tolerance: float = 1e-8, starts: int = 8, seed: int = 0
) -> DataFrame:
    """series_id, t, label: k-means of each series by itself, all series and all
    starts at once; of a series' starts the one of least inertia is kept.

    A series has at most one cluster for each ``least`` frames, and one alone if
    it has fewer than that or than 12. A start's first centers are frames drawn
    one after another with a chance in proportion to their squared distance from
    those before; a center left without frames is drawn anew. Draws are md5 of
    seed, start, round and frame, so they don't depend on how rows are dealt.
    A round sums the frames of each series, start and label; what moves between
    tasks is sums and centers, never frames.
    """
    rows = written(features.select("series_id", "t", "features"), "frame-features")
    width = rows.select(F.size("features").alias("n")).first()
    if not width:
        return rows.select("series_id", "t", F.lit(0).alias("label"))
    n = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    k_of = F.when(F.col("n") < max(12, least), 1).otherwise(F.least(F.lit(k), F.greatest(F.lit(1), F.floor(F.col("n") / least)))).cast("int")
    none = F.array().cast("array<array<double>>")
    centers = n.select("series_id", k_of.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"), none.alias("centers"))

    def draw(step):  # above 0, at most 1
        mark = F.conv(F.substring(F.md5(F.concat_ws(",", F.lit(seed), "start", F.lit(step), "t")), 1, 12), 16, 10)
        return (mark.cast("double") + 1) / 16.0**12

    near = F.array_min(F.transform("centers", lambda x: _distance(F.col("features"), x)))
    for step in range(k):
        chance = F.coalesce(near, F.lit(1.0))
        wait = F.when(chance > 0, -F.ln(draw(step)) / chance).otherwise(float("inf"))
        first = rows.join(centers.where(F.size("centers") < F.col("k")), "series_id").groupBy("series_id", "start").agg(F.min_by("features", F.struct(wait, "t")).alias("drawn"))
        added = F.when(F.col("drawn").isNotNull(), F.concat("centers", F.array("drawn"))).otherwise(F.col("centers"))
        centers = written(centers.join(first, ["series_id", "start"], "left").select("series_id", "k", "start", added.alias("centers")), "centers")
    label = F.array_min(F.transform("centers", lambda x, i: F.struct(_distance(F.col("features"), x).alias("d"), i.alias("label"))))
    sums = [F.avg(F.col("features")[i]) for i in range(width["n"])]
    for step in range(rounds):
        told = rows.join(centers, "series_id").select("series_id", "start", "t", "features", label["label"].alias("label"))
        spare = F.min(F.struct(draw(k + step).alias("u"), F.col("features").alias("x")))
        found = told.groupBy("series_id", "start", "label").agg(F.array(*sums).alias("c"), spare.alias("spare"))
        found = found.groupBy("series_id", "start").agg(F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("c"), F.min("spare").alias("spare"))
        renewed = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.coalesce(F.try_element_at("c", j), F.col("spare.x")))
        moved = F.aggregate(F.zip_with("centers", "renewed", _distance), F.lit(0.0), lambda x, y: x + y)
        centers = centers.join(found, ["series_id", "start"]).withColumn("renewed", renewed).withColumn("moved", moved)
        centers = written(centers.select("series_id", "k", "start", F.col("renewed").alias("centers"), "moved"), "centers")
        if centers.agg(F.max("moved")).first()[0] < tolerance * tolerance:
            break
    inertia = rows.join(centers, "series_id").groupBy("series_id", "start").agg(F.sum(near).alias("inertia"))
    best = inertia.groupBy("series_id").agg(F.min(F.struct("inertia", "start"))["start"].alias("start"))
    kept = written(centers.join(best, ["series_id", "start"]).select("series_id", "centers"), "best-centers")
    return rows.join(kept, "series_id").select("series_id", "t", label["label"].alias("label"))


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def smoothed(labels: DataFrame, window: int = 5) -> DataFrame:
    """The commonest label within window // 2 frames, ties to the smallest."""
    half = window // 2
    votes = labels.select("series_id", F.explode(F.sequence(F.col("t") - half, F.col("t") + half)).alias("t"), "label")
    counts = votes.groupBy("series_id", "t", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("series_id", "t").orderBy(F.desc("n"), "label")
    best = counts.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("series_id", "t", F.col("label").alias("smooth"))
    return labels.join(best, ["series_id", "t"])


def segments(labels: DataFrame, label: str = "label", least: int = 1) -> DataFrame:
    """Runs of one label: segment_id, regime_id, start, end (exclusive)."""
    change = lambda r, w: r.withColumn("_new", F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(True)))
    starts = windowed(labels, change, before=1, keys=("series_id",)).where("_new")
    ends = labels.groupBy("series_id").agg((F.max("t") + 1).alias("_last"))
    # one row for each run from here on
    nxt = F.lead("t").over(Window.partitionBy("series_id").orderBy("t"))
    found = starts.join(ends, "series_id").select("series_id", F.col(label).alias("regime_id"), F.col("t").alias("start"), F.coalesce(nxt, F.col("_last")).alias("end"))
    kept = found.withColumn("n_frames", F.col("end") - F.col("start")).where(F.col("n_frames") >= least)
    w = Window.partitionBy("series_id").orderBy("start")
    return kept.select("series_id", (F.row_number().over(w) - 1).alias("segment_id"), "regime_id", "start", "end", "n_frames")


def transitions(labels: DataFrame, label: str = "label") -> DataFrame:
    """Share of each next regime after each regime, where it occurs."""
    nxt = lambda r, w: r.withColumn("b", F.lead("a").over(w))
    steps = windowed(labels.select("series_id", "t", F.col(label).alias("a")), nxt, after=1, keys=("series_id",)).where("b IS NOT NULL")
    counts = steps.groupBy("series_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    row = F.sum("n").over(Window.partitionBy("series_id", "a"))
    return counts.select("series_id", "a", "b", (F.col("n") / (row + 1e-12)).alias("share"))


def edge_frequency(links: DataFrame, analyzed: DataFrame) -> DataFrame:
    """Share of the analyzed segments that hold each link, with mean strength
    and lag; synchronous links count both ways."""
    sync = links.where("link_type = 'sync'")
    both = links.select("series_id", "segment_id", "src", "dst", "link_type", "score", "lag").unionByName(
        sync.select("series_id", "segment_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "link_type", "score", "lag")
    )
    n = analyzed.groupBy("series_id").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_segments"))
    found = both.groupBy("series_id", "src", "dst", "link_type").agg(
        F.count_distinct("segment_id").alias("n"), F.avg("score").alias("mean_score"), F.avg("lag").alias("mean_lag")
    )
    return found.join(n, "series_id").select("series_id", "src", "dst", "link_type", (F.col("n") / F.col("n_segments")).alias("frequency"), "mean_score", "mean_lag")
