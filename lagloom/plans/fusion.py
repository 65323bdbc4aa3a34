"""Methods with one result schema, and the fusions of the three engines.

edges(series_id, src, dst, score, is_edge, lag, sign): every ordered pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signals import of_largest
from ..functions.tails import coin_p, student_p
from ..operators import graph as g
from ..operators import jumps as jmp
from ..operators import scores as sc
from ..sources import panel as pn
from ..sources.written import written
from .inverse import InverseConfig, inverse_edges
from .jump import JumpConfig, jump_edges
from .network import NetworkConfig, analyze

EDGE = ["series_id", "src", "dst"]
OUT = [*EDGE, "score", "is_edge", "lag", "sign"]


def _spine(panel: DataFrame) -> DataFrame:
    return g.pair_spine(panel.select("series_id", "dim").distinct())


def network_method(panel: DataFrame, config: NetworkConfig = NetworkConfig(0.3, 0.25, 8, True, 20)) -> DataFrame:
    """score = |sync| + |causal|; a causal link's lag and sign go before those
    of a synchronous one, which holds both ways."""
    net = analyze(panel, config)
    score = F.abs("sync") + F.when(F.col("lag") == 0, F.abs("causal")).otherwise(0.0)
    forth, back = F.when(F.col("lag") > 0, F.abs("causal")).otherwise(0.0), F.when(F.col("lag") < 0, F.abs("causal")).otherwise(0.0)
    ways = net.pairs.select("series_id", F.col("i").alias("src"), F.col("j").alias("dst"), (score + forth).alias("score")).unionByName(
        net.pairs.select("series_id", F.col("j").alias("src"), F.col("i").alias("dst"), (score + back).alias("score"))
    )
    sync = net.links.where("link_type = 'sync'").select(*EDGE, F.col("sign").alias("s_sign"))
    sync = sync.unionByName(sync.select("series_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "s_sign"))
    causal = net.links.where("link_type = 'causal'").select(*EDGE, F.col("sign").alias("c_sign"), F.col("lag").alias("c_lag"))
    rows = ways.join(sync, EDGE, "left").join(causal, EDGE, "left")
    return rows.select(
        *EDGE, "score",
        (F.col("s_sign").isNotNull() | F.col("c_sign").isNotNull()).cast("int").alias("is_edge"),
        F.coalesce("c_lag", F.lit(0)).alias("lag"), F.coalesce("c_sign", "s_sign", F.lit(0)).alias("sign"),
    )


def inverse_method(panel: DataFrame, max_lag: int = 5, solver: str = "auto", threshold: float | None = None) -> DataFrame:
    rows = inverse_edges(panel, InverseConfig(max_lag=max_lag, solver=solver, textbook=False))
    return sc.binarized(rows.withColumn("score", F.col("direct_score")), threshold).select(*OUT)


def jump_method(panel: DataFrame, config: JumpConfig = JumpConfig()) -> DataFrame:
    return jump_edges(panel, config)[0].select(*OUT)


def _evidence(panel: DataFrame, max_lag: int, solver: str) -> DataFrame:
    """raw (network), structure (direct score), q, and the inverse lag and sign."""
    panel = written(panel, "panel")
    net = analyze(panel, NetworkConfig(max_lag=max_lag, adaptive=False))
    inverse = inverse_edges(panel, InverseConfig(max_lag=max_lag, solver=solver, textbook=False))
    pairs = net.pairs
    sizes = pn.shape(panel)
    q = sc.causal_q(
        pairs.join(sizes, "series_id").select("series_id", "i", "j", F.col("causal").alias("r"), "lag", "n_dims", "n_frames"),
        max_lag, F.col("n_dims"), F.col("n_frames") - 1,
    )
    either = pairs.select("series_id", F.col("i").alias("src"), F.col("j").alias("dst"), F.abs("causal").alias("raw")).unionByName(
        pairs.select("series_id", F.col("j").alias("src"), F.col("i").alias("dst"), F.abs("causal").alias("raw"))
    )
    held = inverse.select(*EDGE, F.col("direct_score").alias("structure"), "lag", "sign")
    return _spine(panel).join(either, EDGE).join(held, EDGE).join(q, EDGE)


def fusion_method(panel: DataFrame, max_lag: int = 5, solver: str = "auto", alpha: float = 0.05, mode: str = "suppress") -> DataFrame:
    fuse = sc.fuse_suppress if mode == "suppress" else sc.fuse_geometric
    return fuse(_evidence(panel, max_lag, solver), alpha=alpha).withColumn("score", F.col("fused")).select(*OUT)


def triple_fusion_method(panel: DataFrame, max_lag: int = 5, solver: str = "auto", alpha: float = 0.05) -> DataFrame:
    panel = written(panel, "panel")
    jumps = jump_edges(panel, JumpConfig(max_lag=max_lag))[0].select(*EDGE, F.col("score").alias("jump"), F.col("q").alias("jump_q"))
    rows = _evidence(panel, max_lag, solver).join(jumps, EDGE, "left").na.fill({"jump": 0.0, "jump_q": 1.0})
    return sc.fuse_suppress(rows, alpha).withColumn("score", F.col("fused")).select(*OUT)


def rescued(edges: DataFrame, events: DataFrame, segments: DataFrame, max_lag: int, alpha: float = 0.05) -> DataFrame:
    """Edges that are not found, replaced where one segment shows a response of
    larger score with consistency over 0.9 and p under alpha. Frames are joined
    to segments on the frame; pairs never cross a segment's end."""
    last = events.groupBy("series_id").agg((F.max("t") + 1).alias("n"))
    spans = segments.join(last, "series_id").withColumn("end", F.least("end", "n")).where("end - start >= 30")
    frames = spans.select("series_id", "segment_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("t"))
    inside = events.join(frames, ["series_id", "t"]).withColumn("series_id", F.concat_ws("\u0001", "series_id", F.col("segment_id").cast("string")))
    inside = written(inside, "segment-events")
    stats = jmp.signed_responses(inside, max_lag)
    jumps = jmp.jump_consistency(inside, max_lag, 3)
    rows = stats.join(jumps, [*EDGE, "lag"], "left").na.fill({"consistency": 0.5, "n_jumps": 0})
    same = F.round(F.col("consistency") * F.col("n_jumps"))
    p_t = F.when(F.col("n") > 5, student_p(F.col("t_stat"), F.col("n") - 1)).otherwise(1.0)
    p_coin = F.when(F.expr("n_jumps >= 3 AND consistency > 0.5"), F.least(2 * coin_p(same, F.col("n_jumps")), F.lit(1.0))).otherwise(1.0)
    score = F.abs("mean") * (1 + 2 * (F.col("consistency") - 0.5))
    rows = rows.withColumn("p", F.greatest(F.coalesce(p_t, F.lit(1.0)), p_coin)).withColumn("score", score)
    rows = rows.where((F.col("consistency") > 0.9) & (F.col("p") < alpha)).withColumn("series_id", F.substring_index("series_id", "\u0001", 1))
    best = g.strongest(rows.select(*EDGE, "score", "lag", "mean", "p", "consistency")).select(
        *EDGE, F.col("score").alias("r_score"), F.col("lag").alias("r_lag"), F.signum("mean").cast("int").alias("r_sign"), F.col("p").alias("r_p"), F.col("consistency").alias("r_c")
    )
    joined = edges.join(best, EDGE, "left")
    use = F.coalesce((F.col("is_edge") == 0) & (F.col("r_score") > F.col("score")), F.lit(False))
    pick = lambda a, b: F.when(use, F.col(b)).otherwise(F.col(a)).alias(a)
    kept = joined.select(*EDGE, pick("score", "r_score"), pick("lag", "r_lag"), pick("sign", "r_sign"), pick("p", "r_p"), pick("consistency", "r_c"), "is_edge", "n_dims")
    return g.with_bh(kept, keys=("series_id", "src"))


def jump_inverse_method(
    panel: DataFrame, max_lag: int = 5, solver: str = "ridge", alpha: float = 0.05, regimes: DataFrame | None = None, floor: float = 0.05
) -> DataFrame:
    """Jump edges, rescued inside regimes (segments of ``regimes``, if given),
    gated by the direct scores."""
    panel = written(panel, "panel")
    edges, events = jump_edges(panel, JumpConfig(max_lag=max_lag, alpha=alpha))
    if regimes is not None:
        edges = rescued(edges, events, regimes, max_lag, alpha)
    inverse = inverse_edges(panel, InverseConfig(max_lag=max_lag, solver=solver))
    gate = inverse.select(*EDGE, (0.3 + 0.7 * of_largest(F.col("direct_score"))).alias("gate"))
    least = F.when(F.col("n_dims") <= 5, 0.70).otherwise(0.65)
    rows = edges.join(gate, EDGE)
    x = F.col("score") * F.col("gate")
    x = x * F.when(F.col("q") >= alpha, floor).otherwise(1.0) * F.when(F.col("consistency") <= least, floor).otherwise(1.0)
    edge = (F.col("q") < alpha) & (F.col("consistency") > least) & (F.col("is_edge") > 0)
    return rows.select(*EDGE, x.alias("score"), edge.cast("int").alias("is_edge"), "lag", "sign")
