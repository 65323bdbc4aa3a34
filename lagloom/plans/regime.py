"""Regime-aware networks: one network for each long enough segment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regimes as rg
from ..sources.written import written
from .network import Network, NetworkConfig, analyze


@dataclass(frozen=True)
class RegimeConfig:
    n_regimes: int = 3
    min_segment: int = 40
    smooth: int = 5
    windows: tuple[int, ...] = (5, 20, 50)


def detect(panel: DataFrame, config: RegimeConfig = RegimeConfig()) -> tuple[DataFrame, DataFrame]:
    """(labels, segments). Each series has its own clusters; one too short for
    two of min_segment frames is a single regime."""
    labels = rg.clusters(rg.frame_features(panel, config.windows), config.n_regimes, config.min_segment)
    labels = written(rg.smoothed(labels, config.smooth).select("series_id", "t", F.col("smooth").alias("label")), "regimes")
    return labels, rg.segments(labels, least=config.min_segment)


@dataclass(frozen=True)
class RegimeNetworks:
    whole: Network
    labels: DataFrame
    segments: DataFrame
    transitions: DataFrame
    segment_links: DataFrame
    edge_frequency: DataFrame


def analyze_regimes(panel: DataFrame, config: RegimeConfig = RegimeConfig(), network: NetworkConfig = NetworkConfig()) -> RegimeNetworks:
    """Each segment is a series of its own, so all are analyzed in one plan."""
    panel = written(panel, "panel")
    labels, segments = detect(panel, config)
    segments = written(segments, "segments")
    used = segments.where(F.col("n_frames") >= max(12, config.min_segment))
    frames = used.select("series_id", "segment_id", "start", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("t"))
    parts = panel.join(frames, ["series_id", "t"]).select(
        F.concat_ws("\u0001", "series_id", F.col("segment_id").cast("string")).alias("series_id"), (F.col("t") - F.col("start")).alias("t"), "dim", "name", "value"
    )
    links = analyze(parts, network).links.select(
        F.substring_index("series_id", "\u0001", 1).alias("series_id"), F.substring_index("series_id", "\u0001", -1).cast("int").alias("segment_id"),
        "src", "dst", "link_type", "score", "lag",
    )
    return RegimeNetworks(
        analyze(panel, network), labels, segments, rg.transitions(labels), links, rg.edge_frequency(links, used.select("series_id", "segment_id"))
    )
