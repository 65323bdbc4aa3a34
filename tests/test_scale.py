"""Forms that spread one group over many tasks give what one task would."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.functions import signals as sig
from lagloom.operators import graph as g
from lagloom.operators import moments
from lagloom.operators import quantiles as qt
from lagloom.operators import regimes as rg
from lagloom.sources import panel as pn

PANEL = "series_id string, t long, dim int, name string, value double"


@pytest.fixture(scope="module")
def long_panel(spark):
    """One series of many frames beside one of few."""
    rng = np.random.default_rng(2)
    rows = [(s, t, d, f"x{d}", float(v)) for s, n in (("long", 700), ("short", 9)) for d in range(3) for t, v in enumerate(np.cumsum(rng.normal(size=n)))]
    return spark.createDataFrame(rows, PANEL).repartition(5)


def _rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("series_id", "t", *columns).collect())


@pytest.mark.parametrize("size", [64, 7])
def test_blocks_give_the_rows_of_one_window(long_panel, size):
    cases = [
        (lambda n: sig.difference(long_panel, size=n), ("dim", "d")),
        (lambda n: sig.local_std(long_panel, 10, size=n), ("dim", "s")),
        (lambda n: sig.rho_tension(long_panel, 30, size=n), ("dim", "rho")),
        (lambda n: sig.displacement(long_panel, 20, size=n), ("dim", "disp")),
        (lambda n: sig.rolling(long_panel, 5, size=n), ("dim", "mean", "sd")),
        (lambda n: sig.near(long_panel.withColumn("e", (F.col("value") > 5).cast("int")), "e", "close", size=n), ("dim", "close")),
    ]
    for made, columns in cases:
        assert _rows(made(size), *columns) == _rows(made(None), *columns)
    a, b = (sorted((r["series_id"], r["t"], tuple(r["v"])) for r in moments.embedded(long_panel, 4, size=n).collect()) for n in (size, None))
    assert a == b and len(a) == 696 + 5


def test_block_windows_are_spread(long_panel):
    rows = sig.local_std(long_panel, 10, size=64).withColumn("task", F.spark_partition_id())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan
    one = pn.windowed(long_panel.where("series_id = 'long' AND dim = 0"), lambda r, w: r.withColumn("rows", F.count(F.lit(1)).over(w.rowsBetween(-10**6, 10**6))), 10, 10, size=64)
    assert one.agg(F.max("rows")).first()[0] == 84 and one.count() == 700


def test_sliding_spectrum_equals_transforms(long_panel):
    found = {(r["series_id"], r["t"]): r["f_low"] for r in rg.low_frequency(long_panel, size=100).collect()}
    x = {}
    for r in long_panel.collect():
        x.setdefault((r["series_id"], r["dim"]), {})[r["t"]] = r["value"]
    for s, n in (("long", 700), ("short", 9)):
        w = max(16, min(64, n // 4 if n >= 20 else n))
        for t in range(n):
            low = whole = 0.0
            m = min(w, t + 1)
            if m >= 8:
                for d in range(3):
                    a = np.abs(np.fft.rfft([x[s, d][k] for k in range(t - m + 1, t + 1)]))
                    low, whole = low + a[: max(1, len(a) // 4)].sum(), whole + a.sum()
            assert found[s, t] == pytest.approx(low / (whole + 1e-12), abs=1e-9)
    assert len(found) == 709


@pytest.mark.parametrize(("few", "buckets"), [(10_000, 4096), (5, 16), (1, 3)])
def test_percentiles_equal_the_built_in(spark, few, buckets):
    rows = spark.range(6000).selectExpr(
        "if(id % 3 = 0, 'a', if(id % 1000 = 1, 'b', 'c')) AS g",
        "CASE WHEN id % 101 = 5 THEN null WHEN id % 77 = 0 THEN 0D WHEN id % 50 = 0 THEN 1e300 * randn(3) WHEN id % 51 = 0 THEN 1e-300 * randn(4) ELSE exp(randn(1) * 5) * signum(randn(2)) END AS v",
    )
    rows = rows.unionByName(spark.createDataFrame([("one", 2.5), ("two", 1.0), ("two", 2.0), ("none", None), ("same", 7.0), ("same", 7.0), ("same", 7.0), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 3.0)], "g string, v double"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.97, 1.0]
    wanted = {r["g"]: r["q"] for r in rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    found = {r["g"]: r["q"] for r in qt.percentiles(rows, ["g"], "v", shares, few, buckets).collect()}
    assert wanted.pop("none") is None and found == wanted
    assert qt.percentiles(rows.where("false"), ["g"], "v", shares).collect() == []


def _bh(p):
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_benjamini_hochberg_in_stretches(spark, partitions):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.uniform(size=300), 10.0 ** rng.uniform(-300, -1, 60), np.ones(200), np.zeros(3), np.full(40, 0.02)])
    rows = [(("a", "b")[i % 5 == 0], i, float(x)) for i, x in enumerate(p)] + [("a", 10_000, None), ("lone", 10_001, 0.3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r["n"]: r["q"] for r in g.with_bh(spark.createDataFrame(rows, "series_id string, n int, p double")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found.pop(10_000) is None and found.pop(10_001) == 0.3
    for s in "ab":
        part = [(n, x) for k, n, x in rows if k == s and x is not None]
        for (n, _), q in zip(part, _bh([x for _, x in part]), strict=True):
            assert found[n] == pytest.approx(q, rel=1e-12)
