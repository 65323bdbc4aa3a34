"""Operators on edge tables (series_id, src, dst, score, lag, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["series_id", "src", "dst"]


def pair_spine(dims: DataFrame, ordered: bool = True) -> DataFrame:
    """Every pair of dimensions of a series, from (series_id, dim)."""
    a = dims.select("series_id", F.col("dim").alias("src"))
    b = dims.select("series_id", F.col("dim").alias("dst"))
    return a.join(b, "series_id").where("src <> dst" if ordered else "src < dst")


def strongest(links: DataFrame) -> DataFrame:
    """One link for each (src, dst): the strongest; ties to the smaller lag."""
    w = Window.partitionBy(*EDGE).orderBy(F.desc("score"), "lag")
    return links.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def undirected(edges: DataFrame, flag: str = "is_edge") -> DataFrame:
    back = edges.select("series_id", F.col("dst").alias("src"), F.col("src").alias("dst"), flag)
    return edges.select(*EDGE, flag).unionByName(back).groupBy(*EDGE).agg(F.max(flag).alias(flag))


def _triangle(edges: DataFrame, first: tuple[str, str], tag: str) -> DataFrame:
    x, y = first
    return edges.select(
        "series_id", F.col("src").alias(x), F.col("dst").alias(y), F.col("score").alias(f"s_{tag}"), F.col("lag").alias(f"l_{tag}")
    )


def _explained(edges: DataFrame, ancestor: str | None, mediator: str | None) -> DataFrame:
    ab = _triangle(edges, ("a", "b"), "ab")
    out = []
    if ancestor:
        t = ab.join(_triangle(edges, ("z", "a"), "za"), ["series_id", "a"]).join(_triangle(edges, ("z", "b"), "zb"), ["series_id", "z", "b"])
        out.append(t.where(f"z <> a AND z <> b AND {ancestor}"))
    if mediator:
        t = ab.join(_triangle(edges, ("a", "z"), "az"), ["series_id", "a"]).join(_triangle(edges, ("z", "b"), "zb"), ["series_id", "z", "b"])
        out.append(t.where(f"z <> a AND z <> b AND {mediator}"))
    found = out[0].select("series_id", "a", "b")
    for more in out[1:]:
        found = found.unionByName(more.select("series_id", "a", "b"))
    return found.distinct().selectExpr("series_id", "a AS src", "b AS dst")


# Fixed rules of the two filters.
_ANCESTOR = "s_za > s_ab AND abs(l_za + l_ab - l_zb) <= greatest(1, l_zb div 3)"
_MEDIATOR = "least(s_az, s_zb) >= 0.8 * s_ab AND abs(l_az + l_zb - l_ab) <= greatest(2, l_ab div 2)"


def without_ancestors(edges: DataFrame) -> DataFrame:
    """Drops a -> b where some z drives both, z -> a the stronger, lags fitting."""
    return edges.join(_explained(strongest(edges), _ANCESTOR, None), EDGE, "left_anti")


def without_mediated(edges: DataFrame) -> DataFrame:
    """Drops a -> b where a -> m -> b is nearly as strong and the lags fit."""
    return edges.join(_explained(strongest(edges), None, _MEDIATOR), EDGE, "left_anti")


def without_spurious(edges: DataFrame) -> DataFrame:
    return edges.join(_explained(strongest(edges), _ANCESTOR, _MEDIATOR), EDGE, "left_anti")


def textbook_filter(
    edges: DataFrame, ancestor_ratio: float = 0.95, mediator_ratio: float = 0.85, tolerance: int = 1
) -> DataFrame:
    """The same triangles by ratios; series of under three links are left."""
    a = (
        f"s_za >= {ancestor_ratio} * s_ab AND s_zb >= {ancestor_ratio} * s_ab "
        f"AND abs(l_za + l_ab - l_zb) <= {tolerance}"
    )
    m = f"least(s_az, s_zb) >= {mediator_ratio} * s_ab AND abs(l_az + l_zb - l_ab) <= {tolerance}"
    few = edges.groupBy("series_id").count().where("count >= 3").select("series_id")
    drop = _explained(strongest(edges), a, m).join(few, "series_id", "left_semi")
    return edges.join(drop, EDGE, "left_anti")


def indirect_support(edges: DataFrame, tau: float = 1.0, eps: float = 1e-12) -> DataFrame:
    """Of each edge the best two-step path: min(raw) * min(marginal) * exp(-gap / tau)."""
    im = edges.select("series_id", "src", F.col("dst").alias("m"), F.col("raw").alias("r1"), F.col("marginal").alias("g1"), F.col("lag").alias("l1"))
    mj = edges.select("series_id", F.col("src").alias("m"), "dst", F.col("raw").alias("r2"), F.col("marginal").alias("g2"), F.col("lag").alias("l2"))
    paths = im.where("r1 > 0").join(mj.where("r2 > 0"), ["series_id", "m"]).where("src <> dst")
    paths = paths.join(edges.select(*EDGE, "lag"), EDGE)
    gap = F.abs(F.col("lag") - (F.col("l1") + F.col("l2")))
    s = F.least("r1", "r2") * F.least(F.col("g1") + eps, F.col("g2") + eps) * F.exp(-gap / tau)
    best = paths.groupBy(*EDGE).agg(F.max(s).alias("indirect"))
    return edges.join(best, EDGE, "left").withColumn("indirect", F.coalesce("indirect", F.lit(0.0)))


def _stretch(p: Column) -> Column:
    """A number that never falls as p grows from 0 to 1: even steps, and by
    magnitude below 2^-10, where steps of one width would be too coarse."""
    return F.when(p >= 2.0**-10, F.floor(p * 65536)).when(p > 0, F.floor(F.log2(F.greatest(p, F.lit(5e-324))) * 64)).otherwise(-(1 << 20)).cast("int")


def with_bh(rows: DataFrame, p: str = "p", q: str = "q", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Benjamini-Hochberg q of column p among the rows that share keys (not null); a
    null p counts for nothing and has a null q.

    Ranks and running minima go in two steps, so that no task holds all rows of
    a key: rows of equal p are counted first; stretches of p, at most some
    hundred thousand of them, carry counts and minima over to one another; and
    inside a stretch a window does the rest. Equal p get equal q.
    """
    by, stretch = list(keys), [*keys, "_s"]
    each = rows.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    each = each.withColumn("_s", _stretch(F.col("_p")))
    over, inside = Window.partitionBy(*by), Window.partitionBy(*stretch).orderBy("_p")
    counts = each.groupBy(*stretch).agg(F.sum("_n").alias("_c"))
    base = F.sum("_c").over(over.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*stretch, F.coalesce(base, F.lit(0)).alias("_base"), F.sum("_c").over(over).alias("_m"))
    rank = F.col("_base") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ranked = each.join(counts, stretch).select(*stretch, "_p", (F.col("_p") * F.col("_m") / rank).alias("_raw"))
    least = ranked.groupBy(*stretch).agg(F.min("_raw").alias("_least"))
    later = F.min("_least").over(over.orderBy("_s").rowsBetween(1, Window.unboundedFollowing))
    rest = F.min("_raw").over(inside.rowsBetween(0, Window.unboundedFollowing))
    found = ranked.join(least.select(*stretch, later.alias("_later")), stretch)
    found = found.select(*by, "_p", F.least(rest, "_later", F.lit(1.0)).alias("_q"))
    asked = rows.drop(q).withColumn("_p", F.col(p).cast("double"))
    return asked.join(found, [*by, "_p"], "left").select(*(c for c in rows.columns if c != q), F.col("_q").alias(q))


def rank_share(x: str, *keys: str) -> Column:
    """(rank - 1) / (n - 1) in ascending order, ties by src then dst."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    return F.when(n > 1, (F.row_number().over(w.orderBy(x, "src", "dst")) - 1) / (n - 1)).otherwise(0.0)


def hubs(links: DataFrame, dims: DataFrame) -> DataFrame:
    """Dimensions whose summed strength exceeds mean + deviation of all, with
    their place among them."""
    ends = links.select("series_id", F.col("src").alias("dim"), "score").unionByName(links.select("series_id", F.col("dst").alias("dim"), "score"))
    sums = ends.groupBy("series_id", "dim").agg(F.sum("score").alias("connectivity"))
    every = dims.join(sums, ["series_id", "dim"], "left").na.fill(0.0, ["connectivity"])
    w = Window.partitionBy("series_id")
    every = every.select(
        "series_id", "dim", "connectivity",
        (F.avg("connectivity").over(w) + F.stddev_pop("connectivity").over(w)).alias("cut"),
    ).where("connectivity > cut")
    return ranked(every, "connectivity", "dim").select("series_id", "dim", "connectivity", "place")


def roles(causal: DataFrame, dims: DataFrame) -> DataFrame:
    """out and in strength; driver, follower or null, and the place among those
    of one role by the strength that makes it."""
    out = causal.groupBy("series_id", F.col("src").alias("dim")).agg(F.sum("score").alias("out_strength"))
    into = causal.groupBy("series_id", F.col("dst").alias("dim")).agg(F.sum("score").alias("in_strength"))
    every = dims.join(out, ["series_id", "dim"], "left").join(into, ["series_id", "dim"], "left").na.fill(0.0)
    role = F.when(F.expr("out_strength > 0 AND out_strength > 1.5 * in_strength"), "driver").when(
        F.expr("in_strength > 0 AND in_strength > 1.5 * out_strength"), "follower"
    )
    strength = F.when(F.col("role") == "driver", F.col("out_strength")).otherwise(F.col("in_strength"))
    placed = ranked(every.withColumn("role", role).withColumn("_s", strength), "_s", "dim", keys=("series_id", "role")).drop("_s")
    return placed.withColumn("place", F.when(F.col("role").isNotNull(), F.col("place")))


def pattern(links: DataFrame, series: DataFrame) -> DataFrame:
    counts = links.groupBy("series_id").agg(
        F.count_if(F.col("link_type") == "sync").alias("n_sync"), F.count_if(F.col("link_type") == "causal").alias("n_causal")
    )
    every = series.join(counts, "series_id", "left").na.fill(0)
    kind = (
        F.when(F.expr("n_sync + n_causal = 0"), "independent")
        .when(F.expr("n_sync > 2 * n_causal"), "parallel")
        .when(F.expr("n_causal > 2 * n_sync"), "cascade")
        .otherwise("mixed")
    )
    return every.withColumn("pattern", kind)


def initiators(panel: DataFrame, event_frame: int, lookback: int = 24) -> DataFrame:
    """Dimensions whose weighted displacement in the frames up to the event
    exceeds mean + deviation of all, with their place; later steps weigh more
    (0.5 to 2)."""
    first = max(0, event_frame - lookback)
    w = Window.partitionBy("series_id", "dim").orderBy("t")
    part = panel.where(F.col("t").between(first, event_frame)).withColumn("d", F.abs(F.col("value") - F.lag("value").over(w))).where("d IS NOT NULL")
    k = F.row_number().over(w) - 1
    m = F.count(F.lit(1)).over(Window.partitionBy("series_id", "dim"))
    sums = part.withColumn("weight", 0.5 + 1.5 * k / F.greatest(m - 1, F.lit(1))).withColumn("m", m).where("m >= 2")
    sums = sums.groupBy("series_id", "dim").agg(F.sum(F.col("d") * F.col("weight")).alias("score"))
    s = Window.partitionBy("series_id")
    found = sums.withColumn("cut", F.avg("score").over(s) + F.stddev_pop("score").over(s)).where("score > cut")
    return ranked(found, "score", "dim").select("series_id", "dim", "score", "place")


def propagation_order(panel: DataFrame, event_frame: int, lookback: int = 24) -> DataFrame:
    """Onset (first step beyond mean + 1.5 deviations) and place of each
    dimension; without onset, the number of steps."""
    first = max(0, event_frame - lookback)
    w = Window.partitionBy("series_id", "dim").orderBy("t")
    part = panel.where(F.col("t").between(first, event_frame)).withColumn("d", F.abs(F.col("value") - F.lag("value").over(w))).where("d IS NOT NULL")
    every = Window.partitionBy("series_id", "dim")
    part = part.select(
        "series_id", "dim", "d", (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(every).alias("m"),
        (F.avg("d").over(every) + 1.5 * F.stddev_pop("d").over(every)).alias("cut"),
    )
    onset = part.groupBy("series_id", "dim").agg(
        F.coalesce(F.min(F.when(F.col("d") > F.col("cut"), F.col("k"))), F.max("m")).cast("long").alias("onset")
    )
    return onset.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy("onset", "dim")).cast("int"))


def ranked(rows: DataFrame, by: str, *ties: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """rows with place: 1 for the largest ``by`` among the rows that share keys."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), *ties)
    return rows.withColumn("place", F.row_number().over(w))


def summary(links: DataFrame, hubs: DataFrame, roles: DataFrame) -> DataFrame:
    """A network as lines to read: (series_id, section, place, line), sections in
    order of strength."""
    arrow = F.when(F.col("link_type") == "sync", F.lit(" <-> ")).otherwise(F.lit(" -> "))
    tail = F.when(F.col("link_type") == "sync", F.lit("")).otherwise(F.format_string(", lag %d", F.col("lag")))
    text = F.concat(F.col("src").cast("string"), arrow, F.col("dst").cast("string"), F.format_string(": %.3f", F.col("score")), tail)
    first = ranked(links, "score", "src", "dst", keys=("series_id", "link_type")).select("series_id", F.col("link_type").alias("section"), "place", text.alias("line"))
    hub = hubs.select("series_id", F.lit("hub").alias("section"), "place", F.format_string("%d: %.3f", "dim", "connectivity").alias("line"))
    some = roles.where("role IS NOT NULL").withColumn("strength", F.when(F.col("role") == "driver", F.col("out_strength")).otherwise(F.col("in_strength")))
    role = some.select("series_id", F.col("role").alias("section"), "place", F.format_string("%d: %.3f", "dim", "strength").alias("line"))
    return first.unionByName(hub).unionByName(role)
