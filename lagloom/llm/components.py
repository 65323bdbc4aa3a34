"""Connected components of a large edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored


def _lowest(pairs: DataFrame, name: str, stored) -> DataFrame:
    """u and the least v beside it. Written out, so that the join that follows
    can split a hub's rows."""
    return stored(pairs.groupBy("u").agg(F.min("v").alias("m")), name)


def _are_stars(links: DataFrame) -> bool:
    """Every node has one link to a lesser one, or is only linked to. As the
    lesser end is the second one, it is then its component's least node."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 OR n = 1 AND least = 0")
    return not odd.agg(F.count(F.lit(1))).first()[0]


def stars(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, least node) that tie together what a few pairs tie together."""
    over: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := over.setdefault(x, x)) != x:
            over[x] = over[y]
            x = y
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        over[max(a, b)] = min(a, b)
    return [(x, least) for x in list(over) if (least := top(x)) != x]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (least node reachable) for every node of edges (a, b),
    written out.

    Each round hangs every node's larger neighbours on its least neighbour
    (large star), then its smaller ones (small star), until all links are stars:
    a number of rounds near the logarithm of the longest path, none if the edges
    are stars already.
    """
    with Scratch() as scratch:
        return stored(_components(edges, most_rounds, scratch), "components")


def _components(edges: DataFrame, most_rounds: int, stored) -> DataFrame:
    links = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links"
    )
    for _ in range(most_rounds):
        if _are_stars(links):
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, "large-star", stored).withColumn("m", F.least("u", "m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u > v").distinct(), "large-links")
        low = _lowest(large, "small-star", stored)
        hung = large.join(low.hint("merge"), "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        links = stored(small.distinct(), "links")
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    # Every link now points at its component's least node.
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
