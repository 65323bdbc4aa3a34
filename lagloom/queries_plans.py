"""Queries that run whole methods. Fits and tails are beyond SQL; tests hold
them against direct computation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import signals as sig
from .operators import graph as g
from .operators import jumps as jmp
from .operators import regimes as rg
from .operators import scores as sc
from .operators.lagged import covariance
from .plans import fusion, inverse, jump, network, regime
from .queries_edges import EDGES, edges
from .queries_signals import SPURIOUS
from .tables import ADAPTED, EVENTS, LINEITEM, ORDERS, RESPONSES, events_hourly, lineitem_daily, normal_sql, orders_daily, r6, response_p_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return named


_Z = f"{LINEITEM}, z AS (SELECT t, dim, (value - avg(value) OVER (PARTITION BY dim)) / stddev_pop(value) OVER (PARTITION BY dim) AS z FROM panel)"


@query(
    f"""WITH {_Z}, c AS (SELECT a.dim AS i, b.dim AS j, corr(a.z, b.z) AS r FROM z a JOIN z b ON a.t = b.t AND a.dim < b.dim GROUP BY ALL),
    r AS (SELECT max(r) FILTER (i = 0 AND j = 1) AS ab, max(r) FILTER (i = 0 AND j = 2) AS ac, max(r) FILTER (i = 1 AND j = 2) AS bc FROM c)
    SELECT 0 AS i, 1 AS j, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) + 0.0 AS pcorr FROM r
    UNION ALL SELECT 0, 2, round((ac - ab * bc) / sqrt((1 - ab * ab) * (1 - bc * bc)), 6) + 0.0 FROM r
    UNION ALL SELECT 1, 2, round((bc - ab * ac) / sqrt((1 - ab * ab) * (1 - ac * ac)), 6) + 0.0 FROM r"""
)
def partial_corr_3d(spark, sf_dir):
    return _partials(lineitem_daily(spark, sf_dir))


def _partials(panel):
    """All pairs given the rest, from the covariances of z-scored values."""
    cells = covariance(sig.zscore(panel), "z").groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("i", "j", "cov"))).alias("s"))

    def solve(pdf):
        import numpy as np
        import pandas as pd

        from .functions.kernels import precision_pcorr

        c = np.array([x["cov"] for x in pdf["s"].iloc[0]])
        r = precision_pcorr(c.reshape(int(len(c) ** 0.5), -1))
        return pd.DataFrame([(i, j, r[i, j]) for i in range(len(r)) for j in range(i + 1, len(r))], columns=["i", "j", "pcorr"])

    rows = cells.groupBy("series_id").applyInPandas(solve, "i int, j int, pcorr double")
    return rows.select("i", "j", r6("pcorr").alias("pcorr"))


@query(
    f"""WITH {EVENTS}, r0 AS (SELECT a.dim AS i, b.dim AS j, corr(a.value, b.value) AS r FROM panel a JOIN panel b ON a.t = b.t GROUP BY ALL),
    r1 AS (SELECT x.i, x.j, y.j AS k, (x.r - y.r * z.r) / sqrt((1 - y.r * y.r) * (1 - z.r * z.r)) AS r FROM r0 x JOIN r0 y ON y.i = x.i AND y.j <> x.j AND y.j <> x.i JOIN r0 z ON z.i = x.j AND z.j = y.j WHERE x.i <> x.j),
    r2 AS (SELECT x.i, x.j, x.k, y.j AS l, (x.r - y.r * z.r) / sqrt((1 - y.r * y.r) * (1 - z.r * z.r)) AS r FROM r1 x JOIN r1 y ON y.i = x.i AND y.k = x.k AND y.j <> x.j JOIN r1 z ON z.i = x.j AND z.k = x.k AND z.j = y.j),
    r3 AS (SELECT x.i, x.j, (x.r - y.r * z.r) / sqrt((1 - y.r * y.r) * (1 - z.r * z.r)) AS r FROM r2 x JOIN r2 y ON y.i = x.i AND y.k = x.k AND y.l = x.l AND y.j <> x.j JOIN r2 z ON z.i = x.j AND z.k = x.k AND z.l = x.l AND z.j = y.j WHERE x.k < x.l AND x.l < y.j)
    SELECT i, j, round(r, 6) + 0.0 AS pcorr FROM r3 WHERE i < j"""
)
def partial_corr_5d(spark, sf_dir):
    return _partials(events_hourly(spark, sf_dir))


@query(f"WITH {LINEITEM} SELECT round(stddev_pop(value) / (avg(abs(value)) + 1e-10), 6) + 0.0 AS volatility FROM panel")
def global_volatility(spark, sf_dir):
    return network.diagnostics(lineitem_daily(spark, sf_dir)).select(r6("volatility").alias("volatility"))


@query(f"WITH {LINEITEM} SELECT round(avg(s), 3) + 0.0 AS temporal FROM (SELECT stddev_pop(d) AS s FROM (SELECT dim, lead(value) OVER (PARTITION BY dim ORDER BY t) - value AS d FROM panel) GROUP BY dim)")
def temporal_volatility(spark, sf_dir):
    return network.diagnostics(lineitem_daily(spark, sf_dir)).select((F.round("temporal", 3) + 0.0).alias("temporal"))


@query(f"WITH {LINEITEM} SELECT round(1 - avg(abs(r)), 6) + 0.0 AS complexity FROM (SELECT corr(a.value, b.value) AS r FROM panel a JOIN panel b ON a.t = b.t AND a.dim < b.dim GROUP BY a.dim, b.dim)")
def corr_complexity(spark, sf_dir):
    return network.diagnostics(lineitem_daily(spark, sf_dir)).select(r6("complexity").alias("complexity"))


_BLOCKS = """SELECT k, stddev_pop(value) AS s FROM panel JOIN (SELECT CAST(range AS BIGINT) AS k FROM range(0, 2499 - 249, 124)) b ON t >= k AND t < k + 249 GROUP BY k"""


@query(f"WITH {LINEITEM} SELECT round(stddev_pop(s) / (avg(s) + 1e-10), 6) + 0.0 AS local_variation FROM ({_BLOCKS})")
def local_vol_variation(spark, sf_dir):
    return network.block_variation(lineitem_daily(spark, sf_dir)).select(r6("local_variation").alias("local_variation"))


@query(
    f"""WITH {LINEITEM}, f AS (SELECT dim, k, sqrt(pow(sum(value * cos(2 * pi() * ((k * t) % 2499) / 2499)), 2) + pow(sum(value * sin(2 * pi() * ((k * t) % 2499) / 2499)), 2)) AS a
      FROM panel CROSS JOIN (SELECT CAST(range AS BIGINT) AS k FROM range(1249)) GROUP BY ALL)
    SELECT round(sum(a) FILTER (k < 249) / (sum(a) + 1e-10), 6) + 0.0 AS low_share FROM f"""
)
def low_freq_ratio(spark, sf_dir):
    return network.low_frequency_share(lineitem_daily(spark, sf_dir)).select(r6("low_share").alias("low_share"))


def _diagnosed(name: str, panel: str, n: int) -> str:
    w, h = max(10, n // 10), max(1, max(10, n // 10) // 2)
    return f"""SELECT * FROM (WITH {panel},
      whole AS (SELECT stddev_pop(value) / (avg(abs(value)) + 1e-10) AS vol, stddev_pop(value) AS gstd, count(DISTINCT dim) AS k FROM panel),
      tmp AS (SELECT avg(s) AS tmp FROM (SELECT stddev_pop(d) AS s FROM (SELECT dim, lead(value) OVER (PARTITION BY dim ORDER BY t) - value AS d FROM panel) GROUP BY dim)),
      mc AS (SELECT avg(abs(r)) AS mc FROM (SELECT corr(a.value, b.value) AS r FROM panel a JOIN panel b ON a.t = b.t AND a.dim < b.dim GROUP BY a.dim, b.dim)),
      lv AS (SELECT stddev_pop(s) / (avg(s) + 1e-10) AS lv FROM (
        SELECT stddev_pop(value) AS s FROM panel JOIN (SELECT range AS k FROM range(0, {n - w}, {h})) b ON t >= k AND t < k + {w} GROUP BY k)),
      wave AS (SELECT dim, k, sqrt(pow(sum(value * cos(2 * pi() * ((k * t) % {n}) / {n})), 2) + pow(sum(value * sin(2 * pi() * ((k * t) % {n}) / {n})), 2)) AS a
        FROM panel CROSS JOIN (SELECT CAST(range AS BIGINT) AS k FROM range({max(2, n // 2)})) GROUP BY ALL),
      low AS (SELECT sum(a) FILTER (k < {max(1, n // 10)}) / (sum(a) + 1e-10) AS low FROM wave)
      SELECT '{name}' AS panel, {n} AS n, *, 1 - mc AS cx FROM whole, tmp, mc, lv, low)"""


@query(
    f"""WITH d AS ({_diagnosed("lineitem", LINEITEM, 2499)} UNION ALL {_diagnosed("orders", ORDERS, 2405)} UNION ALL {_diagnosed("events", EVENTS, 720)})
    SELECT panel,
      CAST(round(least(greatest(0.5 + CASE WHEN vol > 2 THEN 0.1 WHEN vol < 0.3 THEN -0.1 ELSE 0 END + CASE WHEN mc > 0.6 THEN 0.1 WHEN mc < 0.2 THEN -0.1 ELSE 0 END
        + CASE WHEN lv > 1 THEN 0.05 ELSE 0 END, 0.15), 0.85), 6) AS DOUBLE) AS sync_threshold,
      CAST(round(least(greatest(0.4 + CASE WHEN tmp < 0.3 * gstd THEN -0.1 WHEN tmp > 2 * gstd THEN 0.1 ELSE 0 END + CASE WHEN k > 50 THEN 0.1 WHEN k <= 5 THEN -0.05 ELSE 0 END
        + CASE WHEN cx > 0.7 THEN -0.05 ELSE 0 END, 0.15), 0.80), 6) AS DOUBLE) AS causal_threshold,
      CAST(least(greatest(floor(12 * CASE WHEN low > 0.8 THEN 1.5 WHEN low < 0.3 THEN 0.7 ELSE 1.0 END * CASE WHEN cx > 0.7 THEN 1.3 ELSE 1.0 END
        * CASE WHEN tmp > 2 * gstd THEN 0.8 ELSE 1.0 END), 3), greatest(5, n // 5)) AS INTEGER) AS max_lag FROM d"""
)
def adaptive_params(spark, sf_dir):
    """The parameters of three panels, by the measures of each."""
    panels = {"lineitem": lineitem_daily, "orders": orders_daily, "events": events_hourly}
    found = [network.diagnostics(made(spark, sf_dir)).withColumn("series_id", F.lit(name)) for name, made in panels.items()]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    out = network.adaptive_parameters(every, network.NetworkConfig())
    return out.select(F.col("series_id").alias("panel"), r6("sync_threshold").alias("sync_threshold"), r6("causal_threshold").alias("causal_threshold"), "max_lag")


@query(
    f"""WITH {EDGES}, z AS (
      SELECT series_id, src AS i, dst AS j, least(raw, 0.99) AS r, lag * sign AS lag, CAST(greatest(100 + b - abs(lag), 1) AS BIGINT) AS n FROM (SELECT *, lag * 10 AS b FROM edges WHERE src < dst)),
    p AS (SELECT *, least(9 - 2, floor(n / 4)) AS k FROM z),
    t AS (SELECT *, least(CASE WHEN n - k - 3 >= 1 THEN {normal_sql("(atanh(r) * sqrt(n - k - 3))")} ELSE 1.0 END * 12, 1.0) AS p1 FROM p),
    d AS (SELECT series_id, i AS src, j AS dst, CASE WHEN lag >= 0 THEN p1 ELSE 1.0 END AS p FROM t UNION ALL SELECT series_id, j, i, CASE WHEN lag <= 0 THEN p1 ELSE 1.0 END FROM t),
    o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p) AS k, count(*) OVER (PARTITION BY series_id) AS m FROM d)
    SELECT series_id, src, dst, round(p, 9) + 0.0 AS p, round(least(1.0, min(p * m / k) OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) + 0.0 AS q FROM o"""
)
def causal_q(spark, sf_dir):
    pairs = edges(spark, sf_dir).where("src < dst").select(
        "series_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.least("raw", F.lit(0.99)).alias("r"), (F.col("lag") * F.col("sign")).alias("lag"), (100 + F.col("lag") * 10).alias("n")
    )
    rows = sc.causal_q(pairs, 6, F.lit(9), F.col("n"))
    return rows.select("series_id", "src", "dst", (F.round("p", 9) + 0.0).alias("p"), (F.round("q", 9) + 0.0).alias("q"))


@query(f"WITH {LINEITEM} SELECT count(*) AS n_rows, round(sum(value), 2) + 0.0 AS total FROM panel WHERE t >= 3")
def lag_embedding(spark, sf_dir):
    from .operators.moments import embedded

    v = embedded(lineitem_daily(spark, sf_dir), 3).withColumn("x", F.slice("v", 10, 3))
    total = F.sum(F.aggregate("x", F.lit(0.0), lambda a, b: a + b))
    return v.agg((F.count(F.lit(1)) * 3).alias("n_rows"), (F.round(total, 2) + 0.0).alias("total"))


def _fisher(r: str, n: str, k: str) -> str:
    z = normal_sql(f"(atanh(least(greatest({r}, -0.9999999999), 0.9999999999)) * sqrt(greatest({n} - ({k}) - 3, 0)))")
    return f"CASE WHEN {n} - ({k}) - 3 >= 1 AND abs({r}) < 1 THEN {z} WHEN abs({r}) < 1 THEN 1.0 ELSE 0.0 END"


# The network of the hourly events with fixed thresholds. What
# all other columns leave of a pair's is found by eliminating them from the
# moments, on lists of rows.
def _network_sql(lags: int, least: float = 0.1, alpha: float = 0.5) -> str:
    return f"""{EVENTS},
near AS (SELECT *, stddev_pop(value) OVER (PARTITION BY dim ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS s FROM panel),
steps AS (SELECT t, dim, (lead(value) OVER w - value) / (lead(s) OVER w + 1e-10) AS x FROM near WINDOW w AS (PARTITION BY dim ORDER BY t)),
v AS (
  SELECT 'd' AS view, t, dim AS m, x FROM steps WHERE x IS NOT NULL
  UNION ALL SELECT 'r', t, dim, (value - avg(value) OVER (PARTITION BY dim)) / stddev_pop(value) OVER (PARTITION BY dim) FROM panel
),
ends AS (SELECT view, max(t) + 1 AS n FROM v GROUP BY view),
col AS (
  SELECT view, k, v.t - c AS t, m, c, c * 5 + m AS col, x FROM v JOIN ends USING (view) CROSS JOIN (SELECT range AS k FROM range({lags + 1})) CROSS JOIN (SELECT range AS c FROM range({lags + 1}))
  WHERE c <= k AND v.t - c >= 0 AND v.t - c < n - k
  UNION ALL SELECT DISTINCT view, k, t, -1, 0, 99, 1.0 FROM v JOIN ends USING (view) CROSS JOIN (SELECT range AS k FROM range({lags + 1})) WHERE t < n - k
),
g AS (SELECT a.view, a.k, a.col AS p, a.m AS pm, b.col AS q, b.m AS qm, sum(a.x * b.x) AS v FROM col a JOIN col b USING (view, k, t) GROUP BY ALL),
ask AS (SELECT DISTINCT view, k, a.dim AS a, b.dim AS b FROM g CROSS JOIN dims a CROSS JOIN dims b WHERE a.dim <> b.dim),
pick AS (
  SELECT ask.*, p, CASE WHEN p = a THEN 100 WHEN p = k * 5 + b THEN 101 WHEN p = 99 THEN 102 ELSE p END AS i FROM ask JOIN (SELECT DISTINCT view, k, p, pm FROM g) USING (view, k)
  WHERE pm NOT IN (a, b) OR p = a OR p = k * 5 + b
),
line AS (SELECT x.view, x.k, x.a, x.b, x.i, list(g.v ORDER BY y.i) AS line FROM pick x JOIN pick y USING (view, k, a, b) JOIN g ON g.view = x.view AND g.k = x.k AND g.p = x.p AND g.q = y.p GROUP BY ALL),
sys AS (SELECT view, k, a, b, list(line ORDER BY i) AS m, count(*)::INT AS s FROM line GROUP BY ALL),
left_ AS (
  SELECT view, k, a, b, s, list_reduce(list_prepend(m, list_transform(range(1, s - 2), lambda j: [[j::DOUBLE]])), lambda m, j:
    list_transform(m, lambda line, i: CASE WHEN i <= j[1][1] THEN line
      ELSE list_transform(line, lambda v, h: v - line[j[1][1]::INT] * m[j[1][1]::INT][h] / m[j[1][1]::INT][j[1][1]::INT]) END)) AS m FROM sys
),
mom AS (SELECT view, k, a, b, n - k AS n, m[s-2][s-2] AS aa, m[s-1][s-1] AS bb, m[s-2][s-1] AS ab, m[s-2][s] AS sa, m[s-1][s] AS sb FROM left_ JOIN ends USING (view)),
lagged AS (SELECT view, k, a, b, (ab / n - sa * sb / n / n) / sqrt((aa / n - sa * sa / n / n) * (bb / n - sb * sb / n / n)) AS r FROM mom WHERE k > 0),
centred AS (SELECT view, p AS i, q AS j, (v - v1 * v2 / n) / (n - 1) AS v FROM g JOIN (SELECT view, p, v AS v1 FROM g WHERE k = 0 AND q = 99) USING (view, p) JOIN (SELECT view, p AS q, v AS v2 FROM g WHERE k = 0 AND q = 99) USING (view, q) JOIN ends USING (view) WHERE g.k = 0 AND p < 99 AND q < 99),
c0 AS (SELECT a.view, a.i, a.j, a.v / sqrt(b.v * c.v) AS r FROM centred a JOIN centred b ON b.view = a.view AND b.i = a.i AND b.j = a.i JOIN centred c ON c.view = a.view AND c.i = a.j AND c.j = a.j WHERE a.i <> a.j),
c1 AS (SELECT x.view, x.i, x.j, y.j AS k, (x.r - y.r * z.r) / sqrt((1 - y.r * y.r) * (1 - z.r * z.r)) AS r FROM c0 x JOIN c0 y ON y.view = x.view AND y.i = x.i AND y.j <> x.j JOIN c0 z ON z.view = x.view AND z.i = x.j AND z.j = y.j),
c2 AS (SELECT x.view, x.i, x.j, x.k, y.j AS l, (x.r - y.r * z.r) / sqrt((1 - y.r * y.r) * (1 - z.r * z.r)) AS r FROM c1 x JOIN c1 y ON y.view = x.view AND y.i = x.i AND y.k = x.k AND y.j <> x.j JOIN c1 z ON z.view = x.view AND z.i = x.j AND z.k = x.k AND z.j = y.j),
sync AS (SELECT x.view, x.i, x.j, (x.r - y.r * z.r) / sqrt((1 - y.r * y.r) * (1 - z.r * z.r)) AS sync FROM c2 x JOIN c2 y ON y.view = x.view AND y.i = x.i AND y.k = x.k AND y.l = x.l AND y.j <> x.j
  JOIN c2 z ON z.view = x.view AND z.i = x.j AND z.k = x.k AND z.l = x.l AND z.j = y.j WHERE x.k < x.l AND x.l < y.j AND x.i < x.j),
best AS (
  SELECT view, least(a, b) AS i, greatest(a, b) AS j, r AS causal, CASE WHEN a > b THEN -k ELSE k END AS lag
  FROM lagged QUALIFY row_number() OVER (PARTITION BY view, least(a, b), greatest(a, b) ORDER BY abs(r) DESC, k, a > b) = 1
),
views AS (SELECT view, i, j, sync, causal, lag FROM sync JOIN best USING (view, i, j)),
merged AS (
  SELECT d.i, d.j, use, if(use, r.sync, d.sync) AS sync, if(use, r.causal, d.causal) AS causal, if(use, r.lag, d.lag) AS lag FROM (SELECT * FROM views WHERE view = 'd') d JOIN (SELECT * FROM views WHERE view = 'r') r USING (i, j)
  CROSS JOIN LATERAL (SELECT abs(d.causal) > 0.1 AND abs(r.causal) > 1.1 * abs(r.sync) AND (NOT abs(d.causal) > 1.1 * abs(d.sync) OR abs(r.causal) > abs(d.causal)) AS use)
),
sizes AS (SELECT *, 719 AS n, greatest(719 - abs(lag), 1) AS nl, least(3, floor(greatest(719 - abs(lag), 1) / 4)) AS kl FROM merged),
tested AS (SELECT *, {_fisher("sync", "n", "3")} AS p_sync, least(({_fisher("causal", "nl", "kl")}) * {2 * lags}, 1.0) AS p_causal FROM sizes),
ranked AS (SELECT *, row_number() OVER (ORDER BY p_sync) AS ks, row_number() OVER (ORDER BY p_causal) AS kc, count(*) OVER () AS m FROM tested),
q AS (
  SELECT *, least(1.0, min(p_sync * m / ks) OVER (ORDER BY ks ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_sync,
         least(1.0, min(p_causal * m / kc) OVER (ORDER BY kc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_causal FROM ranked
),
causal_links AS (
  SELECT 'causal' AS link_type, if(lag > 0, i, j) AS src, if(lag > 0, j, i) AS dst, abs(causal) AS score, causal AS corr, CAST(abs(lag) AS INTEGER) AS lag, p_causal AS p, q_causal AS q
  FROM q WHERE q_causal < {alpha} AND abs(causal) > 0.8 * {least} AND abs(causal) > 1.1 * abs(sync)
),
explained AS (
  SELECT DISTINCT ab.src, ab.dst FROM causal_links ab JOIN causal_links za ON za.dst = ab.src AND za.src <> ab.dst JOIN causal_links zb ON zb.src = za.src AND zb.dst = ab.dst
  WHERE za.score > ab.score AND abs(za.lag + ab.lag - zb.lag) <= greatest(1, zb.lag // 3)
  UNION
  SELECT ab.src, ab.dst FROM causal_links ab JOIN causal_links az ON az.src = ab.src AND az.dst <> ab.dst JOIN causal_links zb ON zb.src = az.dst AND zb.dst = ab.dst
  WHERE least(az.score, zb.score) >= 0.8 * ab.score AND abs(az.lag + zb.lag - ab.lag) <= greatest(2, ab.lag // 2)
),
links AS (
  SELECT 'sync' AS link_type, i AS src, j AS dst, abs(sync) AS score, sync AS corr, 0 AS lag, p_sync AS p, q_sync AS q FROM q WHERE q_sync < {alpha} AND abs(sync) > 0.15
  UNION ALL SELECT c.* FROM causal_links c LEFT JOIN explained e USING (src, dst) WHERE e.src IS NULL
)"""


def _events_network(spark, sf_dir):
    return network.analyze(events_hourly(spark, sf_dir), network.NetworkConfig(0.3, 0.1, 3, False, 20, 0.5))


@query(f"WITH {_network_sql(3)} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sync, 6) + 0.0 AS sync, round(causal, 6) + 0.0 AS causal, CAST(lag AS INTEGER) AS lag, CAST(use AS INTEGER) AS from_raw FROM merged")
def network_pairs(spark, sf_dir):
    rows = _events_network(spark, sf_dir).pairs
    return rows.select("i", "j", r6("sync").alias("sync"), r6("causal").alias("causal"), "lag", "from_raw")


@query(
    f"""WITH {_network_sql(3)} SELECT link_type, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, round(score, 6) + 0.0 AS score, lag, CAST(sign(corr) AS INTEGER) AS sign,
      round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q FROM links"""
)
def network_analyze(spark, sf_dir):
    rows = _events_network(spark, sf_dir).links
    return rows.select("link_type", "src", "dst", r6("score").alias("score"), "lag", "sign", r6("p").alias("p"), r6("q").alias("q"))


@query()
def network_summary(spark, sf_dir):
    net = network.analyze(events_hourly(spark, sf_dir), network.NetworkConfig(0.3, 0.1, 3, False, 20, 0.5))
    return g.summary(net.links, net.hubs, net.roles)


_ROLLED = ", ".join(
    f"{f}({c}) OVER (ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {c}_{s}{n}" for n in (5, 20, 50) for c in ("f_step", "f_square") for f, s in (("avg", "mean"), ("stddev_pop", "sd"))
)
_SCALED = ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () < 1e-12 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) + 0.0 AS {c}" for c in rg.FEATURES)


@query(
    f"""WITH {EVENTS}, d AS (SELECT t, dim, value, coalesce(value - lag(value) OVER (PARTITION BY dim ORDER BY t), 0) AS d FROM panel),
    base AS (SELECT t, avg(abs(value)) AS f_abs, stddev_pop(value) AS f_sd, avg(abs(d)) AS f_step, stddev_pop(d) AS f_step_sd, avg(value * value) AS f_square, avg(d * d) AS f_step_square FROM d GROUP BY t),
    p AS (SELECT a.t, a.dim AS i, b.dim AS j, a.value AS x, b.value AS y FROM panel a JOIN panel b ON a.t = b.t AND a.dim < b.dim),
    w AS (SELECT t, count(*) OVER w AS n, covar_pop(x, y) OVER w AS c, stddev_pop(x) OVER w AS sx, stddev_pop(y) OVER w AS sy FROM p WINDOW w AS (PARTITION BY i, j ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    co AS (SELECT t, avg(CASE WHEN n < 3 OR sx < 1e-9 OR sy < 1e-9 THEN 0 ELSE abs(c / (sx * sy)) END) AS f_coherence FROM w GROUP BY t),
    wide AS (SELECT dim, greatest(16, least(64, CASE WHEN count(*) >= 20 THEN count(*) // 4 ELSE count(*) END)) AS w FROM panel GROUP BY dim),
    own AS (SELECT t, dim, least(w, t + 1) AS m FROM panel JOIN wide USING (dim) WHERE least(w, t + 1) >= 8),
    wave AS (SELECT a.t, a.dim, k.k, m, sqrt(pow(sum(b.value * cos(2 * pi() * ((k.k * b.t) % m) / m)), 2) + pow(sum(b.value * sin(2 * pi() * ((k.k * b.t) % m) / m)), 2)) AS amp
      FROM own a JOIN panel b ON b.dim = a.dim AND b.t > a.t - m AND b.t <= a.t JOIN (SELECT range AS k FROM range(33)) k ON k.k <= m // 2 GROUP BY ALL),
    lf AS (SELECT t, sum(CASE WHEN k < greatest(1, (m // 2 + 1) // 4) THEN amp ELSE 0 END) / (sum(amp) + 1e-12) AS f_low FROM wave GROUP BY t),
    f AS (SELECT base.*, coalesce(f_coherence, 0) AS f_coherence, coalesce(f_low, 0) AS f_low FROM base LEFT JOIN co USING (t) LEFT JOIN lf USING (t)),
    r AS (SELECT *, {_ROLLED} FROM f)
    SELECT t, {_SCALED} FROM r"""
)
def regime_features(spark, sf_dir):
    """The features of every frame."""
    rows = rg.frame_features(events_hourly(spark, sf_dir))
    return rows.select("t", *(r6(F.col("features")[k]).alias(c) for k, c in enumerate(rg.FEATURES)))


@query(f"WITH {LINEITEM} SELECT t, dim, round((value - avg(value) OVER (PARTITION BY dim)) / stddev_pop(value) OVER (PARTITION BY dim), 6) + 0.0 AS z FROM panel")
def zscore_unit(spark, sf_dir):
    return sig.zscore_unit(lineitem_daily(spark, sf_dir)).select("t", "dim", r6("z").alias("z"))


@query()
def network_roles(spark, sf_dir):
    return network.analyze(orders_daily(spark, sf_dir)).roles


@query()
def event_network(spark, sf_dir):
    return network.event_network(events_hourly(spark, sf_dir), 400, 120, 60)[0].pairs


@query()
def regime_aware(spark, sf_dir):
    return regime.analyze_regimes(lineitem_daily(spark, sf_dir)).edge_frequency


# The ridge fits of every target: five lags of each source and one of its own,
# 536 frames to fit and 179 to judge by, forward and in reversed time, solved by
# elimination on lists of rows.
_RIDGE = f"""{EVENTS}, z AS (SELECT t, dim, (value - avg(value) OVER (PARTITION BY dim)) / stddev_pop(value) OVER (PARTITION BY dim) AS z FROM panel),
zz AS (SELECT 'f' AS dir, t, dim, z FROM z UNION ALL SELECT 'b', 719 - t, dim, z FROM z),
y AS (SELECT dir, dim AS y, t - 5 AS r, z - avg(z) OVER (PARTITION BY dir, dim) AS v FROM zz WHERE t >= 5),
x AS (
  SELECT y.dir, y.y, y.r, y.v AS target, s.dim AS s, l.k, CASE WHEN s.dim = y.y THEN 0 ELSE 1 + 10 * s.dim + l.k END AS c, s.z AS v
  FROM y CROSS JOIN (SELECT range AS k FROM range(1, 6)) l JOIN zz s ON s.dir = y.dir AND s.t = y.r + 5 - l.k WHERE s.dim <> y.y OR l.k = 1
),
xx AS (SELECT a.dir, a.y, a.c AS c1, b.c AS c2, sum(a.v * b.v) AS v FROM x a JOIN x b USING (dir, y, r) WHERE r < 536 GROUP BY ALL),
xy AS (SELECT dir, y, c, sum(v * target) AS v FROM x WHERE r < 536 GROUP BY ALL),
own AS (SELECT xy.dir, xy.y, xy.v / xx.v AS w FROM xy JOIN xx ON xx.dir = xy.dir AND xx.y = xy.y AND xx.c1 = 0 AND xx.c2 = 0 WHERE xy.c = 0),
columns AS (SELECT DISTINCT dir, y, s, k, c FROM x),
part AS (
  SELECT 'rest' AS kind, dir, y, -1 AS s, c, (c - 1) // 10 AS blk FROM columns WHERE dir = 'f' AND c > 0
  UNION ALL SELECT 'every', dir, y, -1, c, CASE WHEN c = 0 THEN -1 ELSE (c - 1) // 10 END FROM columns WHERE dir = 'b'
  UNION ALL SELECT 'pair', c.dir, c.y, o.dim, c.c, CASE WHEN c.c = 0 THEN -1 ELSE o.dim END FROM columns c JOIN dims o ON o.dim <> c.y AND (c.c = 0 OR c.s = o.dim) WHERE c.dir = 'f'
),
place AS (
  SELECT kind, dir, y, s, c, CASE WHEN c = 0 THEN -1 ELSE (c - 1) // 10 END AS blk, row_number() OVER w AS i, count(*) OVER (PARTITION BY kind, dir, y, s) AS p,
         count(*) OVER (PARTITION BY kind, dir, y, s, CASE WHEN c = 0 THEN -1 ELSE (c - 1) // 10 END) AS width
  FROM part WINDOW w AS (PARTITION BY kind, dir, y, s ORDER BY c)
),
cells AS (
  SELECT a.kind, a.dir, a.y, a.s, a.i, b.i AS j, xx.v + 0.01 * sqrt(ln(greatest(a.p, 2)) / 536) / 0.1 * (
           CASE WHEN a.c = b.c THEN 1 + CASE WHEN a.width = 1 THEN 0 WHEN (a.c - 1) % 10 IN (1, 5) THEN 1 ELSE 2 END WHEN a.blk = b.blk AND abs(a.c - b.c) = 1 THEN -1 ELSE 0 END) AS v
  FROM place a JOIN place b USING (kind, dir, y, s) JOIN xx ON xx.dir = a.dir AND xx.y = a.y AND xx.c1 = a.c AND xx.c2 = b.c
  UNION ALL
  SELECT a.kind, a.dir, a.y, a.s, a.i, a.p + 1, xy.v - CASE WHEN a.kind = 'rest' THEN xx.v * own.w ELSE 0 END
  FROM place a JOIN xy ON xy.dir = a.dir AND xy.y = a.y AND xy.c = a.c JOIN xx ON xx.dir = a.dir AND xx.y = a.y AND xx.c1 = a.c AND xx.c2 = 0 JOIN own ON own.dir = a.dir AND own.y = a.y
),
lines AS (SELECT kind, dir, y, s, i, list(v ORDER BY j) AS line FROM cells GROUP BY ALL),
systems AS (SELECT kind, dir, y, s, list(line ORDER BY i) AS m, count(*) AS p FROM lines GROUP BY ALL),
solved AS (
  SELECT kind, dir, y, s, p, list_reduce(list_prepend(m, list_transform(range(1, p + 1), lambda k: [[k::DOUBLE]])), lambda m, k:
    list_transform(m, lambda line, i: CASE WHEN i = k[1][1] THEN list_transform(line, lambda v: v / m[k[1][1]::INT][k[1][1]::INT])
      ELSE list_transform(line, lambda v, j: v - line[k[1][1]::INT] * m[k[1][1]::INT][j] / m[k[1][1]::INT][k[1][1]::INT]) END)) AS m FROM systems
),
w AS (SELECT p.kind, p.dir, p.y, p.s, p.c, p.blk, q.m[p.i::INT][(q.p + 1)::INT] AS w FROM place p JOIN solved q USING (kind, dir, y, s)),
weights AS (
  SELECT dir, y, c, blk, w FROM w WHERE kind <> 'pair' UNION ALL SELECT dir, y, 0, -1, w FROM own WHERE dir = 'f'
),
told AS (SELECT x.dir, x.y, x.r, x.target, g.blk, sum(x.v * g.w) AS v FROM x JOIN weights g ON g.dir = x.dir AND g.y = x.y AND g.c = x.c WHERE x.r >= 536 GROUP BY ALL),
whole AS (SELECT dir, y, r, target, sum(v) AS v FROM told GROUP BY ALL),
base AS (SELECT dir, y, avg(pow(target - v, 2)) AS base FROM whole GROUP BY ALL),
drops AS (SELECT w.dir, w.y, t.blk AS s, avg(pow(w.target - w.v + t.v, 2)) AS mse FROM whole w JOIN told t USING (dir, y, r) WHERE t.blk >= 0 GROUP BY ALL),
means AS (SELECT y, avg(v) AS m FROM y WHERE dir = 'f' AND r < 536 GROUP BY y),
nulls AS (SELECT y, avg(pow(v - m, 2)) AS null_mse FROM y JOIN means USING (y) WHERE dir = 'f' AND r >= 536 GROUP BY y),
alone AS (SELECT x.y, avg(pow(target - v * w, 2)) AS self_mse FROM x JOIN own USING (dir, y) WHERE dir = 'f' AND c = 0 AND r >= 536 GROUP BY x.y),
pairs AS (
  SELECT y, s, avg(pow(target - v, 2)) AS pair_mse FROM (
    SELECT x.y, w.s, x.r, x.target, sum(x.v * w.w) AS v FROM x JOIN w ON w.kind = 'pair' AND w.y = x.y AND w.c = x.c WHERE x.dir = 'f' AND x.r >= 536 GROUP BY ALL) GROUP BY ALL
),
kernels AS (SELECT y, blk AS s, sqrt(sum(w * w)) AS block_norm, CAST(arg_max((c - 1) % 10, abs(w)) AS INTEGER) AS lag, CAST(sign(arg_max(w, abs(w))) AS INTEGER) AS sign FROM w WHERE kind = 'rest' GROUP BY ALL),
fits AS (
  SELECT CAST(s AS INTEGER) AS src, y AS dst, block_norm, lag, sign, f.base AS baseline_mse, null_mse, self_mse, pair_mse, d.mse - f.base AS delta_mse, e.mse - b.base AS delta_mse_backward
  FROM kernels JOIN base f USING (y) JOIN base b USING (y) JOIN drops d USING (y, s) JOIN drops e USING (y, s) JOIN nulls USING (y) JOIN alone USING (y) JOIN pairs USING (y, s)
  WHERE f.dir = 'f' AND b.dir = 'b' AND d.dir = 'f' AND e.dir = 'b'
),
confident AS (SELECT *, greatest(0, delta_mse - delta_mse_backward) AS asymmetry, greatest(0, delta_mse) + 0.25 * greatest(0, delta_mse - delta_mse_backward) AS confidence FROM fits),
mixed AS (
  SELECT *, 0.65 * block_norm / max(block_norm) OVER () + 0.35 * (0.65 * greatest(delta_mse, 0) / max(delta_mse) OVER () + 0.35 * confidence / max(confidence) OVER ()) AS raw FROM confident
)"""
_DIRECT = f"""{_RIDGE},
strong AS (SELECT src, dst, raw AS score, lag FROM mixed WHERE raw > 1e-6),
bad AS (
  SELECT DISTINCT ab.src, ab.dst FROM strong ab JOIN strong za ON za.dst = ab.src AND za.src <> ab.dst JOIN strong zb ON zb.src = za.src AND zb.dst = ab.dst
  WHERE za.score >= 0.95 * ab.score AND zb.score >= 0.95 * ab.score AND abs(za.lag + ab.lag - zb.lag) <= 1
  UNION
  SELECT ab.src, ab.dst FROM strong ab JOIN strong az ON az.src = ab.src AND az.dst <> ab.dst JOIN strong zb ON zb.src = az.dst AND zb.dst = ab.dst
  WHERE least(az.score, zb.score) >= 0.85 * ab.score AND abs(az.lag + zb.lag - ab.lag) <= 1
),
gains AS (
  SELECT m.*, CASE WHEN raw > 1e-6 AND b.src IS NULL THEN raw ELSE 0 END AS score, greatest(self_mse - baseline_mse, 0) AS gs, greatest(null_mse - baseline_mse, 0) AS gn
  FROM mixed m LEFT JOIN bad b ON b.src = m.src AND b.dst = m.dst
),
per AS (SELECT *, greatest(gs, 0.25 * gn, 1e-12) AS dn, gs / (gn + 1e-12) AS ra FROM gains),
sides AS (
  SELECT *, (greatest(delta_mse, 0) / dn) / (1 + greatest(delta_mse, 0) / dn) AS u, (greatest(self_mse - pair_mse, 0) / dn) / (1 + greatest(self_mse - pair_mse, 0) / dn) AS mg,
    least(greatest(1 - ra, 0.2), 0.9) AS eta, least(greatest(1 - 0.5 * ra, 0.5), 0.9) AS beta FROM per
),
needed AS (SELECT *, eta * u + (1 - eta) * mg AS necessity FROM sides),
two AS (
  SELECT e.src, e.dst, max(least(x.raw, y.raw) * least(x.mg + 1e-12, y.mg + 1e-12) * exp(-abs(e.lag - (x.lag + y.lag)))) AS ind
  FROM needed e JOIN needed x ON x.src = e.src JOIN needed y ON y.src = x.dst AND y.dst = e.dst WHERE x.raw > 0 AND y.raw > 0 GROUP BY ALL
),
direct AS (SELECT n.*, least(greatest(necessity / (necessity + coalesce(ind, 0) + 1e-12), 0), 1) AS irreducibility FROM needed n LEFT JOIN two USING (src, dst)),
scored AS (SELECT *, (0.35 * raw / max(raw) OVER () + 0.65 * necessity / max(necessity) OVER ()) * (beta + (1 - beta) * irreducibility) AS direct_score FROM direct)"""
_FITTED = ("block_norm", "baseline_mse", "null_mse", "self_mse", "pair_mse", "delta_mse", "delta_mse_backward", "asymmetry", "confidence", "raw", "score", "necessity", "irreducibility", "direct_score")


@query(f"WITH {_DIRECT} SELECT src, dst, lag, sign, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _FITTED)} FROM scored")
def inverse_ridge(spark, sf_dir):
    rows = inverse.inverse_edges(events_hourly(spark, sf_dir), inverse.InverseConfig(solver="ridge"))
    return rows.select("src", "dst", "lag", "sign", *(r6(c).alias(c) for c in _FITTED))


@query()
def inverse_lasso(spark, sf_dir):
    return inverse.inverse_edges(events_hourly(spark, sf_dir)).drop("kernel")


@query()
def predict_adjacency(spark, sf_dir):
    return inverse.adjacency_scores(lineitem_daily(spark, sf_dir))


_ENGINE = f"""{ADAPTED}{RESPONSES}{SPURIOUS},
kept AS (
  SELECT e.*, {response_p_sql("s.mean", "s.sd", "s.n")} AS p, b.a IS NOT NULL AS filtered
  FROM edges e JOIN stats s USING (src, dst, lag) LEFT JOIN bad b ON b.a = e.src AND b.b = e.dst
),
med AS (
  SELECT e.src, e.dst, e.lag, m.dst AS m, m.lag AS m_lag FROM kept e JOIN kept m ON m.src = e.src AND m.dst <> e.dst
  WHERE NOT e.filtered AND NOT m.filtered AND e.score > 0 AND m.score > e.score
),
asked_edges AS (SELECT DISTINCT src, dst, lag FROM med),
clean AS (
  SELECT e.src, e.dst, e.lag, j.t, j.event FROM asked_edges e JOIN jumps j ON j.dim = e.src AND j.event <> 0 WHERE NOT EXISTS (
    SELECT 1 FROM med x JOIN jumps k ON k.dim = x.m AND k.event <> 0 WHERE x.src = e.src AND x.dst = e.dst AND abs(j.t + x.m_lag - k.t) <= 1)
),
after AS (SELECT c.src, c.dst, avg(y.disp * c.event) AS mean, stddev_samp(y.disp * c.event) AS sd, count(*) AS n FROM clean c JOIN jumps y ON y.dim = c.dst AND y.t = c.t + c.lag GROUP BY ALL),
given AS (SELECT src, dst, CASE WHEN coalesce(n, 0) < 5 THEN 1.0 ELSE {response_p_sql()} END AS given FROM asked_edges LEFT JOIN after USING (src, dst)),
final AS (SELECT kept.* EXCLUDE (p), coalesce(given, p) AS p FROM kept LEFT JOIN given USING (src, dst)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY p) AS k, count(*) OVER (PARTITION BY src) AS m FROM final),
engine AS (SELECT *, least(1.0, min(p * m / k) OVER (PARTITION BY src ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ranks)"""


@query(
    f"""WITH {_ENGINE} SELECT src, dst, round(score * if(filtered, 0.05, 1) * if(q >= 0.05, 0.05, 1) * if(consistency <= 0.7, 0.05, 1), 6) + 0.0 AS score,
      round(score, 6) + 0.0 AS raw_score, filtered, lag, sign, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q, round(consistency, 6) + 0.0 AS consistency,
      CAST(q < 0.05 AND NOT filtered AND score > 0 AND consistency > 0.7 AS INTEGER) AS is_edge FROM engine"""
)
def jump_engine(spark, sf_dir):
    rows = jump.jump_edges(events_hourly(spark, sf_dir))[0]
    return rows.select(
        "src", "dst", r6("score").alias("score"), r6("raw_score").alias("raw_score"), "filtered", "lag", "sign", r6("p").alias("p"), r6("q").alias("q"),
        r6("consistency").alias("consistency"), "is_edge",
    )


@query()
def jump_inverse(spark, sf_dir):
    panel = lineitem_daily(spark, sf_dir)
    return fusion.jump_inverse_method(panel, regimes=regime.detect(panel)[1])


_VIEWS = f"""{EDGES}, d AS (SELECT series_id, src AS i, dst AS j, raw * sign AS sync, score AS causal, lag FROM edges WHERE src < dst),
    r AS (SELECT series_id, dst AS i, src AS j, raw * sign AS sync, score AS causal, -lag AS lag FROM edges WHERE src > dst)"""


def _views(spark, sf_dir):
    e = edges(spark, sf_dir)
    corr = [(F.col("raw") * F.col("sign")).alias("sync"), F.col("score").alias("causal")]
    steps = e.where("src < dst").select("series_id", F.col("src").alias("i"), F.col("dst").alias("j"), *corr, "lag")
    raw = e.where("src > dst").select("series_id", F.col("dst").alias("i"), F.col("src").alias("j"), *corr, (-F.col("lag")).alias("lag"))
    return steps, raw


@query(
    f"""WITH {_VIEWS}, v AS (SELECT d.*, r.sync AS rs, r.causal AS rc, r.lag AS rl, abs(d.causal) > 1.1 * abs(d.sync) AS d_holds, abs(r.causal) > 1.1 * abs(r.sync) AS r_holds
      FROM d JOIN r USING (series_id, i, j)),
    u AS (SELECT *, CASE WHEN abs(causal) <= 0.1 OR NOT r_holds THEN 0 WHEN NOT d_holds THEN 1 WHEN abs(rc) > abs(causal) THEN 1 ELSE 0 END AS from_raw FROM v)
    SELECT series_id, i, j, if(from_raw = 1, rs, sync) AS sync, if(from_raw = 1, rc, causal) AS causal, if(from_raw = 1, rl, lag) AS lag, from_raw FROM u"""
)
def merged_views(spark, sf_dir):
    return network.merged_views(*_views(spark, sf_dir))


@query(
    f"""WITH {EDGES}, k AS (SELECT series_id, src AS i, dst AS j, raw * sign AS sync, score AS causal, lag * sign AS lag, p, structure AS q FROM edges WHERE src < dst)
    SELECT series_id, 'sync' AS link_type, i AS src, j AS dst, abs(sync) AS score, 0 AS lag FROM k WHERE p < 0.5 AND abs(sync) > 0.15
    UNION ALL
    SELECT series_id, 'causal', if(lag > 0, i, j), if(lag > 0, j, i), abs(causal), abs(lag) FROM k
    WHERE q < 0.5 AND abs(causal) > 0.8 * 0.4 AND abs(causal) > 1.1 * abs(sync)"""
)
def significant_links(spark, sf_dir):
    k = edges(spark, sf_dir).where("src < dst").select(
        "series_id", F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("raw") * F.col("sign")).alias("sync"), F.col("score").alias("causal"),
        (F.col("lag") * F.col("sign")).alias("lag"), F.lit(0.4).alias("causal_threshold"), F.col("p").alias("p_sync"), F.col("p").alias("q_sync"),
        F.col("structure").alias("p_causal"), F.col("structure").alias("q_causal"),
    )
    return network.significant_links(k, 0.5).select("series_id", "link_type", "src", "dst", "score", "lag")


@query(f"WITH {EDGES} SELECT series_id, src, dst, CAST(score > 0.5 AS INTEGER) AS is_edge FROM edges")
def binarize_threshold(spark, sf_dir):
    return sc.binarized(edges(spark, sf_dir), threshold=0.5).select("series_id", "src", "dst", "is_edge")


@query(
    f"""WITH {EVENTS}, r AS (SELECT stddev_pop(value) OVER (PARTITION BY dim ORDER BY t ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS rho FROM panel)
    SELECT round(stddev_pop(rho) / (avg(rho) + 1e-10), 6) + 0.0 AS rho_cv FROM r"""
)
def tension_variation(spark, sf_dir):
    return jmp.tension_variation(events_hourly(spark, sf_dir)).select(r6("rho_cv").alias("rho_cv"))


@query(f"WITH {_ENGINE} SELECT src, dst, round(score * if(filtered, 0.05, 1) * if(q >= 0.05, 0.05, 1) * if(consistency <= 0.7, 0.05, 1), 6) + 0.0 AS score, lag, sign FROM engine")
def jump_method(spark, sf_dir):
    return fusion.jump_method(events_hourly(spark, sf_dir)).select("src", "dst", r6("score").alias("score"), "lag", "sign")


@query(
    f"""WITH {_network_sql(3)}, ways AS (
      SELECT i AS src, j AS dst, abs(sync) + CASE WHEN lag >= 0 THEN abs(causal) ELSE 0 END AS score FROM merged
      UNION ALL SELECT j, i, abs(sync) + CASE WHEN lag <= 0 THEN abs(causal) ELSE 0 END FROM merged),
    s AS (SELECT src, dst, sign(corr) AS s_sign FROM links WHERE link_type = 'sync' UNION ALL SELECT dst, src, sign(corr) FROM links WHERE link_type = 'sync'),
    c AS (SELECT src, dst, sign(corr) AS c_sign, lag AS c_lag FROM links WHERE link_type = 'causal')
    SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, round(score, 6) + 0.0 AS score, CAST(s_sign IS NOT NULL OR c_sign IS NOT NULL AS INTEGER) AS is_edge,
      CAST(coalesce(c_lag, 0) AS INTEGER) AS lag, CAST(coalesce(c_sign, s_sign, 0) AS INTEGER) AS sign FROM ways LEFT JOIN s USING (src, dst) LEFT JOIN c USING (src, dst)"""
)
def network_method(spark, sf_dir):
    rows = fusion.network_method(events_hourly(spark, sf_dir), network.NetworkConfig(0.3, 0.1, 3, False, 20, 0.5))
    return rows.select("src", "dst", r6("score").alias("score"), "is_edge", "lag", "sign")


@query(
    f"""WITH {_DIRECT}, cut AS (SELECT quantile_cont(direct_score, 0.65) AS cut FROM scored WHERE direct_score > 0)
    SELECT src, dst, round(direct_score, 6) + 0.0 AS score, CAST(direct_score > cut AS INTEGER) AS is_edge, lag, sign FROM scored, cut"""
)
def direct_irreducibility(spark, sf_dir):
    rows = fusion.inverse_method(events_hourly(spark, sf_dir), solver="ridge")
    return rows.select("src", "dst", r6("score").alias("score"), "is_edge", "lag", "sign")


def _of_largest(x: str) -> str:
    return f"greatest({x}, 0) / max({x}) OVER ()"


# The three engines' evidence for each ordered pair, each from its own names.
_EVIDENCE = f"""n AS (SELECT i, j, causal, lag FROM (WITH {_network_sql(5)} SELECT * FROM merged)),
t AS (SELECT *, greatest(719 - abs(lag), 1) AS nl, least(3, floor(greatest(719 - abs(lag), 1) / 4)) AS kl FROM n),
p1 AS (SELECT *, least(({_fisher("causal", "nl", "kl")}) * 10, 1.0) AS p FROM t),
either AS (
  SELECT i AS src, j AS dst, abs(causal) AS raw, CASE WHEN lag >= 0 THEN p ELSE 1.0 END AS p FROM p1 UNION ALL SELECT j, i, abs(causal), CASE WHEN lag <= 0 THEN p ELSE 1.0 END FROM p1
),
ord AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM either),
net AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ord),
inv AS (SELECT * FROM (WITH {_DIRECT} SELECT src, dst, direct_score AS structure, lag, sign FROM scored)),
jmp AS (SELECT * FROM (WITH {_ENGINE} SELECT src, dst, score * if(filtered, 0.05, 1) * if(q >= 0.05, 0.05, 1) * if(consistency <= 0.7, 0.05, 1) AS jump, q AS jump_q, consistency, lag AS jump_lag,
  sign AS jump_sign, q < 0.05 AND NOT filtered AND score > 0 AND consistency > 0.7 AS jump_edge FROM engine)),
pair AS (
  SELECT *, {_of_largest("raw")} * (0.7 + 0.3 * {_of_largest("structure")}) * CASE WHEN q < 0.05 THEN 1 ELSE 0.05 END AS two FROM net JOIN inv USING (src, dst) JOIN jmp USING (src, dst)
),
three AS (SELECT *, two * (0.3 + 0.7 * {_of_largest("jump")}) * CASE WHEN jump_q < 0.05 THEN 1 ELSE 0.05 END AS three FROM pair)"""


def _fused_sql(x: str) -> str:
    return f"""WITH {_EVIDENCE}, cut AS (SELECT quantile_cont({x}, 0.5) AS tau FROM three WHERE {x} > 0)
    SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, round({x}, 6) + 0.0 AS score, CAST(q < 0.05 AND {x} > coalesce(tau, 0) AS INTEGER) AS is_edge, lag, sign FROM three LEFT JOIN cut ON TRUE"""


@query(_fused_sql("two"))
def fusion_suppress(spark, sf_dir):
    return fusion.fusion_method(events_hourly(spark, sf_dir), solver="ridge").select("src", "dst", r6("score").alias("score"), "is_edge", "lag", "sign")


@query(_fused_sql("three"))
def triple_fusion(spark, sf_dir):
    return fusion.triple_fusion_method(events_hourly(spark, sf_dir), solver="ridge").select("src", "dst", r6("score").alias("score"), "is_edge", "lag", "sign")


@query(
    f"""WITH {_EVIDENCE} SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst,
      round(jump * (0.3 + 0.7 * {_of_largest("structure")}) * if(jump_q >= 0.05, 0.05, 1) * if(consistency <= 0.7, 0.05, 1), 6) + 0.0 AS score, CAST(jump_edge AS INTEGER) AS is_edge,
      jump_lag AS lag, jump_sign AS sign FROM three"""
)
def jump_inverse_gate(spark, sf_dir):
    """Jump edges gated by the direct scores, without regimes."""
    return fusion.jump_inverse_method(events_hourly(spark, sf_dir)).select("src", "dst", r6("score").alias("score"), "is_edge", "lag", "sign")
