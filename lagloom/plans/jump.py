"""Jump-triggered responses: edges from what follows large steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signals as sig
from ..operators import graph as g
from ..operators import jumps as jmp
from ..sources import panel as pn
from ..sources.written import written

EDGE = ["series_id", "src", "dst"]


@dataclass(frozen=True)
class JumpConfig:
    max_lag: int = 5
    local_std_window: int = 20
    rho_window: int = 30
    percentile: float = 90.0
    alpha: float = 0.05
    min_jumps: int = 5
    adaptive: bool = True
    floor: float = 0.05


def adapted_events(panel: DataFrame, parameters: DataFrame) -> DataFrame:
    """Steps, thresholds and events with each series' own window and percentile.

    A window's width must be fixed in a plan, so each one in use has its own
    branch. Both follow from fixed scale factors and steps, and the widths are at
    most ``local_std_window`` * 1.3: a few values, whatever the series.
    """
    used = parameters.agg(F.collect_set("local_window").alias("w"), F.collect_set("percentile").alias("p")).first()
    rows = panel.join(parameters.select("series_id", "percentile", "local_window"), "series_id")
    if not used["w"]:
        return jmp.jump_events(sig.displacement(rows)).drop("percentile", "local_window")
    steps = written(sig.displacement(rows, sorted(used["w"])), "steps")
    return jmp.jump_events(steps, sorted(used["p"])).drop("percentile", "local_window")


def jump_edges(panel: DataFrame, config: JumpConfig = JumpConfig()) -> tuple[DataFrame, DataFrame]:
    """(edges, events). edges: score after suppression, raw_score before,
    filtered, lag, sign, p, q, consistency, is_edge."""
    panel = written(panel, "panel")
    events = jmp.jump_events(written(sig.displacement(panel, config.local_std_window), "steps"), config.percentile)
    if config.adaptive:
        found = jmp.adaptive_jump_parameters(
            jmp.event_statistics(events), pn.shape(panel), jmp.volatility_ratio(panel), config.percentile, config.local_std_window, config.rho_window
        )
        events = adapted_events(panel, written(found, "jump-parameters"))
    events = written(events, "events")
    stats = jmp.response_p(jmp.signed_responses(events, config.max_lag))
    best = written(jmp.best_response(stats, jmp.jump_consistency(events, config.max_lag, config.min_jumps)), "best-responses")
    spurious = jmp.spurious_edges(best, events).withColumn("filtered", F.lit(True))
    rows = written(best.join(spurious, EDGE, "left").na.fill({"filtered": False}), "filtered")
    rows = with_conditional_p(rows, events, config.min_jumps)
    return suppressed(g.with_bh(rows, keys=("series_id", "src")), pn.shape(panel), config), events


def with_conditional_p(rows: DataFrame, events: DataFrame, least: int) -> DataFrame:
    """rows, p replaced for edges with a mediator; edges without one, and
    filtered ones, keep their p over all frames."""
    given = conditional_p(events, rows.where("NOT filtered AND score > 0"), least).withColumnRenamed("p", "given")
    return rows.join(given, EDGE, "left").withColumn("p", F.coalesce("given", "p")).drop("given")


def conditional_p(events: DataFrame, kept: DataFrame, least: int) -> DataFrame:
    """For each kept edge with a mediator, p of its mean signed response after
    the source's jumps that no mediator explains; 1 with fewer than ``least``."""
    mediators = jmp.stronger_mediators(kept)
    clean = jmp.unexplained_jumps(events, mediators)
    reply = events.select("series_id", F.col("t").alias("at"), F.col("dim").alias("dst"), F.col("disp").alias("y"))
    rows = clean.withColumn("at", F.col("t") + F.col("lag")).join(reply, ["series_id", "dst", "at"])
    s = F.col("y") * F.col("event")
    stats = rows.groupBy(*EDGE).agg(F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), F.count(s).alias("n"))
    t = F.when(F.col("sd") > 1e-12, F.col("mean") / (F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    p = jmp.response_p(stats.withColumn("t_stat", t)).select(*EDGE, F.when(F.col("n") < least, 1.0).otherwise(F.col("p")).alias("p"))
    return mediators.select(*EDGE).distinct().join(p, EDGE, "left").na.fill({"p": 1.0})


def suppressed(rows: DataFrame, sizes: DataFrame, config: JumpConfig) -> DataFrame:
    rows = rows.join(sizes.select("series_id", "n_dims"), "series_id")
    least = F.when(F.col("n_dims") <= 5, 0.70).otherwise(0.65)
    x = F.col("score")
    for weak in (F.col("filtered"), F.col("q") >= config.alpha, F.col("consistency") <= least):
        x = x * F.when(weak, config.floor).otherwise(1.0)
    edge = (F.col("q") < config.alpha) & ~F.col("filtered") & (F.col("score") > 0) & (F.col("consistency") > least)
    return rows.select(
        *EDGE, x.alias("score"), F.col("score").alias("raw_score"), "raw", "filtered", "lag", "sign", "p", "q", "consistency", edge.cast("int").alias("is_edge"), "n_dims"
    )
