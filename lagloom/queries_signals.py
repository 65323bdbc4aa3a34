"""Queries on panels, signals, lags and jumps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import signals as sig
from .operators import jumps as jmp
from .operators import lagged as lg
from .sources import panel as pn
from .sources.written import fresh_folder, written
from .tables import (
    ADAPTIVE, DISP, EVENTS, FRAMES, JUMPS, LAGGED, LINEITEM, ORDERS, RESPONSES, events_hourly, lineitem_daily, orders_daily, r6, response_p_sql, table,
)

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return named


def displaced(spark, sf_dir):
    return sig.displacement(events_hourly(spark, sf_dir))


def jumped(spark, sf_dir):
    return written(jmp.jump_events(written(displaced(spark, sf_dir), "steps")), "events")


@query(f"WITH {EVENTS} SELECT t, dim, name, round(value, 6) + 0.0 AS value FROM panel")
def panel_events_hourly(spark, sf_dir):
    return events_hourly(spark, sf_dir).select("t", "dim", "name", r6("value").alias("value"))


@query(f"WITH {EVENTS} SELECT t, dim, name, round(value, 6) + 0.0 AS value FROM panel")
def panel_streamed(spark, sf_dir):
    """The hourly panel by way of a stream over the table's files."""
    from .streaming import panel as live

    # a pattern, as a stream's plain path must be a folder and a table may be one file
    files = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/[e]vents.parquet")
    folder = fresh_folder(spark, "streamed")
    buckets = live.bucketed(files, "ts", "event_type", "value", "HOUR", "60 days")
    live.writer(buckets, f"{folder}/buckets", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return live.read(spark, f"{folder}/buckets", "2024-01-01 00:00:00", "HOUR", FRAMES).select("t", "dim", "name", r6("value").alias("value"))


@query(f"WITH {ORDERS} SELECT t, dim, name, round(value, 2) + 0.0 AS value FROM panel")
def panel_orders_daily(spark, sf_dir):
    return orders_daily(spark, sf_dir).select("t", "dim", "name", (F.round("value", 2) + 0.0).alias("value"))


@query(
    "SELECT l_orderkey * 10 + l_linenumber AS t, CAST(i AS INTEGER) AS dim, names[i + 1] AS name, vals[i + 1] AS value FROM ("
    "SELECT *, ['l_quantity', 'l_extendedprice', 'l_discount'] AS names, [l_quantity, l_extendedprice, l_discount] AS vals, unnest([0, 1, 2]) AS i FROM lineitem)"
)
def panel_unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").withColumn("t", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return pn.from_columns(wide, ["l_quantity", "l_extendedprice", "l_discount"], "t").select("t", "dim", "name", "value")


@query(f"WITH {EVENTS} SELECT t, len(list(value)) AS n_dims, round(sum(value), 5) + 0.0 AS total FROM panel GROUP BY t")
def panel_arrays(spark, sf_dir):
    wide = pn.to_arrays(events_hourly(spark, sf_dir))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return wide.select("t", F.size("x").cast("long").alias("n_dims"), (F.round(total, 5) + 0.0).alias("total"))


@query("SELECT vec_id AS t, CAST(i AS INTEGER) AS dim, CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)")
def panel_from_arrays(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("series_id"), F.col("vec_id").alias("t"), F.col("embedding").alias("x"))
    return pn.from_arrays(rows).select("t", "dim", "value")


@query(f"WITH {EVENTS} SELECT t - 100 AS t, dim, round(value, 6) + 0.0 AS value FROM panel WHERE t BETWEEN 100 AND 199")
def row_range(spark, sf_dir):
    return pn.frames_between(events_hourly(spark, sf_dir), 100, 200).select("t", "dim", r6("value").alias("value"))


@query(f"WITH {EVENTS} SELECT 719 - t AS t, dim, round(value, 6) + 0.0 AS value FROM panel")
def time_reversal(spark, sf_dir):
    return pn.reversed_time(events_hourly(spark, sf_dir)).select("t", "dim", r6("value").alias("value"))


@query(f"WITH {EVENTS} SELECT * FROM (SELECT t, dim, round(lead(value) OVER (PARTITION BY dim ORDER BY t) - value, 6) + 0.0 AS d FROM panel) WHERE d IS NOT NULL")
def diff(spark, sf_dir):
    return sig.difference(events_hourly(spark, sf_dir)).select("t", "dim", r6("d").alias("d"))


def _window(body: str) -> str:
    return f"WITH {EVENTS} SELECT t, dim, {body} FROM panel"


@query(_window("round(stddev_pop(value) OVER (PARTITION BY dim ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) + 0.0 AS s"))
def local_std_centered(spark, sf_dir):
    return sig.local_std(events_hourly(spark, sf_dir), 10).select("t", "dim", r6("s").alias("s"))


@query(_window("round(stddev_pop(value) OVER (PARTITION BY dim ORDER BY t ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING), 6) + 0.0 AS s"))
def local_std_wide(spark, sf_dir):
    return sig.local_std(events_hourly(spark, sf_dir), 20).select("t", "dim", r6("s").alias("s"))


@query(_window("round(stddev_pop(value) OVER (PARTITION BY dim ORDER BY t ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), 6) + 0.0 AS rho"))
def rho_t(spark, sf_dir):
    return sig.rho_tension(events_hourly(spark, sf_dir), 30).select("t", "dim", r6("rho").alias("rho"))


@query(f"WITH {DISP} SELECT t, dim, round(disp, 6) + 0.0 AS disp FROM disp")
def displacement(spark, sf_dir):
    return displaced(spark, sf_dir).select("t", "dim", r6("disp").alias("disp"))


@query(_window("round((value - avg(value) OVER (PARTITION BY dim)) / stddev_pop(value) OVER (PARTITION BY dim), 6) + 0.0 AS z"))
def zscore(spark, sf_dir):
    return sig.zscore(events_hourly(spark, sf_dir)).select("t", "dim", r6("z").alias("z"))


@query(
    _window(
        "round(avg(value) OVER (PARTITION BY dim ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) + 0.0 AS mean, "
        "round(stddev_pop(value) OVER (PARTITION BY dim ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) + 0.0 AS sd"
    )
)
def rolling_mean_std(spark, sf_dir):
    return sig.rolling(events_hourly(spark, sf_dir), 5).select("t", "dim", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(
    f"""WITH {LINEITEM}, p AS (
      SELECT a.t, a.dim AS i, b.dim AS j, a.value AS x, b.value AS y FROM panel a JOIN panel b ON a.t = b.t AND a.dim < b.dim
    ), w AS (
      SELECT t, i, j, count(*) OVER w AS n, covar_pop(x, y) OVER w AS c, stddev_pop(x) OVER w AS sx, stddev_pop(y) OVER w AS sy
      FROM p WINDOW w AS (PARTITION BY i, j ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
    ) SELECT t, round(avg(CASE WHEN n < 3 OR sx < 1e-9 OR sy < 1e-9 THEN 0 ELSE abs(c / (sx * sy)) END), 5) + 0.0 AS coherence FROM w GROUP BY t"""
)
def rolling_coherence(spark, sf_dir):
    from .operators.regimes import rolling_coherence as coherence

    return coherence(lineitem_daily(spark, sf_dir), 20).select("t", (F.round("coherence", 5) + 0.0).alias("coherence"))


@query(f"WITH {DISP}{LAGGED} SELECT src, dst, lag, round(corr(x, y), 6) + 0.0 AS r FROM pairs GROUP BY ALL")
def lag_join_corr(spark, sf_dir):
    return lg.lag_corr(displaced(spark, sf_dir), 5, "disp").select("src", "dst", "lag", r6("r").alias("r"))


@query(f"WITH {EVENTS} SELECT a.dim AS i, b.dim AS j, round(corr(a.value, b.value), 6) + 0.0 AS r FROM panel a JOIN panel b ON a.t = b.t AND a.dim < b.dim GROUP BY ALL")
def pair_corr(spark, sf_dir):
    return lg.pair_corr(events_hourly(spark, sf_dir)).select("i", "j", r6("r").alias("r"))


@query(f"WITH {EVENTS} SELECT a.dim AS i, b.dim AS j, round(covar_samp(a.value, b.value), 4) + 0.0 AS cov FROM panel a JOIN panel b ON a.t = b.t GROUP BY ALL")
def cov_matrix(spark, sf_dir):
    return lg.covariance(events_hourly(spark, sf_dir)).select("i", "j", (F.round("cov", 4) + 0.0).alias("cov"))


@query(
    f"""WITH {DISP}{LAGGED}, r AS (SELECT src, dst, lag, corr(x, y) AS r FROM pairs GROUP BY ALL),
    n AS (
      SELECT least(src, dst) AS i, greatest(src, dst) AS j, r,
             CASE WHEN src > dst THEN -lag ELSE lag END AS lag,
             row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY abs(r) DESC, lag, src > dst) AS n
      FROM r
    ) SELECT i, j, round(r, 6) + 0.0 AS r, lag FROM n WHERE n = 1"""
)
def best_lag(spark, sf_dir):
    rows = lg.best_lag(lg.lag_corr(displaced(spark, sf_dir), 5, "disp"))
    return rows.select("i", "j", r6("r").alias("r"), "lag")


@query(f"WITH {JUMPS} SELECT t, dim, round(threshold, 6) + 0.0 AS threshold, event FROM jumps")
def jump_events(spark, sf_dir):
    return jumped(spark, sf_dir).select("t", "dim", r6("threshold").alias("threshold"), "event")


@query(
    f"""WITH {JUMPS}, f AS (SELECT t, dim, abs(event) AS e FROM jumps),
    p AS (SELECT a.dim AS i, b.dim AS j, avg(a.e * b.e) AS p FROM f a JOIN f b ON a.t = b.t AND a.dim < b.dim GROUP BY ALL)
    SELECT round((SELECT avg(e) FROM f), 6) + 0.0 AS density, round((SELECT avg(p) FROM p), 6) + 0.0 AS cofiring"""
)
def event_density(spark, sf_dir):
    return jmp.event_statistics(jumped(spark, sf_dir)).select(r6("density").alias("density"), r6("cofiring").alias("cofiring"))


@query(f"WITH {JUMPS}{RESPONSES} SELECT src, dst, lag, n, round(mean, 6) + 0.0 AS mean, round(mean / (sd / sqrt(n)), 6) + 0.0 AS t_stat FROM stats")
def signed_mean_tstat(spark, sf_dir):
    rows = jmp.signed_responses(displaced(spark, sf_dir), 5)
    return rows.select("src", "dst", "lag", "n", r6("mean").alias("mean"), r6("t_stat").alias("t_stat"))


@query(f"WITH {JUMPS}{RESPONSES} SELECT src, dst, lag, n, round({response_p_sql()}, 6) + 0.0 AS p FROM stats")
def response_p_values(spark, sf_dir):
    rows = jmp.response_p(jmp.signed_responses(displaced(spark, sf_dir), 5))
    return rows.select("src", "dst", "lag", "n", r6("p").alias("p"))


@query(f"WITH {JUMPS}{RESPONSES} SELECT src, dst, lag, n_jumps, round(consistency, 6) + 0.0 AS consistency FROM cons")
def jump_consistency(spark, sf_dir):
    return jmp.jump_consistency(jumped(spark, sf_dir), 5).select("src", "dst", "lag", "n_jumps", r6("consistency").alias("consistency"))


@query(f"WITH {JUMPS}{RESPONSES} SELECT src, dst, lag, sign, round(score, 6) + 0.0 AS score, round(consistency, 6) + 0.0 AS consistency FROM edges")
def signed_best_lag(spark, sf_dir):
    return response_edges(jumped(spark, sf_dir)).select("src", "dst", "lag", "sign", r6("score").alias("score"), r6("consistency").alias("consistency"))


def response_edges(events):
    return jmp.best_response(jmp.signed_responses(events, 5), jmp.jump_consistency(events, 5))


_PROPAGATION = """,
fired AS (SELECT t, dim, abs(event) AS e, max(abs(event)) OVER (PARTITION BY dim ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS active FROM jumps),
asked AS (SELECT a.dim AS a, z.dim AS z, b.dim AS b, 2 AS lag FROM dims a JOIN dims z ON z.dim <> a.dim JOIN dims b ON b.dim <> a.dim AND b.dim <> z.dim),
seen AS (
  SELECT q.a, q.z, q.b, q.lag, z.active, b.e FROM asked q
  JOIN fired x ON x.dim = q.a AND x.e = 1 JOIN fired z ON z.dim = q.z AND z.t = x.t JOIN fired b ON b.dim = q.b AND b.t = x.t + q.lag
)"""


@query(
    f"""WITH {JUMPS}{_PROPAGATION} SELECT CAST(a AS INTEGER) AS a, CAST(z AS INTEGER) AS z, CAST(b AS INTEGER) AS b,
    round(coalesce(avg(e) FILTER (active = 1), 0), 6) + 0.0 AS p_with, round(coalesce(avg(e) FILTER (active = 0), 0), 6) + 0.0 AS p_without,
    count(*) FILTER (active = 1) AS n_with, count(*) FILTER (active = 0) AS n_without FROM seen GROUP BY ALL"""
)
def conditional_propagation(spark, sf_dir):
    events = jumped(spark, sf_dir)
    d = events.select("series_id", "dim").distinct()
    asked = (
        d.withColumnRenamed("dim", "a").join(d.withColumnRenamed("dim", "z"), "series_id").join(d.withColumnRenamed("dim", "b"), "series_id")
        .where("a <> z AND a <> b AND z <> b").withColumn("lag", F.lit(2))
    )
    rows = jmp.conditional_propagation(events, asked)
    return rows.select("a", "z", "b", r6("p_with").alias("p_with"), r6("p_without").alias("p_without"), "n_with", "n_without")


#: The edges that the conditional tests explain: (a, b) of bad.
SPURIOUS = """,
e AS (SELECT * FROM edges WHERE score > 0),
act AS (SELECT t, dim, abs(event) AS e, max(abs(event)) OVER (PARTITION BY dim ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS active FROM jumps),
tri AS (
  SELECT ab.src AS a, ab.dst AS b, z.dim AS z, ab.score AS s, ab.lag AS l,
         za.score AS s_za, za.lag AS l_za, zb.score AS s_zb, zb.lag AS l_zb, az.score AS s_az, az.lag AS l_az
  FROM e ab JOIN dims z ON z.dim NOT IN (ab.src, ab.dst)
  LEFT JOIN e za ON za.src = z.dim AND za.dst = ab.src LEFT JOIN e zb ON zb.src = z.dim AND zb.dst = ab.dst
  LEFT JOIN e az ON az.src = ab.src AND az.dst = z.dim
),
prob AS (
  SELECT q.a, q.z, q.b, coalesce(avg(y.e) FILTER (w.active = 1), 0) AS p_with, coalesce(avg(y.e) FILTER (w.active = 0), 0) AS p_without,
         count(*) FILTER (w.active = 0) AS n_without
  FROM tri q JOIN act x ON x.dim = q.a AND x.e = 1 JOIN act w ON w.dim = q.z AND w.t = x.t JOIN act y ON y.dim = q.b AND y.t = x.t + q.l
  GROUP BY ALL
),
bad AS (
  SELECT DISTINCT tri.a, tri.b FROM tri JOIN prob USING (a, z, b)
  WHERE (s_za > s AND s_zb > s AND abs(l_za + l - l_zb) <= greatest(1, l_zb // 3) AND (p_without < 0.5 * s AND p_with > 1.5 * p_without OR n_without < 3))
     OR (s_az > 0 AND s_zb > 0 AND (abs(l_az + l_zb - l) <= 1 AND least(s_az, s_zb) >= s
         OR abs(l_az + l_zb - l) <= greatest(2, l // 2) AND p_without < 0.4 * s AND p_with > 2 * p_without))
)"""


@query(f"WITH {JUMPS}{RESPONSES}{SPURIOUS} SELECT CAST(a AS INTEGER) AS src, CAST(b AS INTEGER) AS dst FROM bad")
def spurious_filter(spark, sf_dir):
    events = jumped(spark, sf_dir)
    return jmp.spurious_edges(response_edges(events), events).select("src", "dst")


@query(
    f"""WITH {JUMPS}{RESPONSES}, med AS (
      SELECT e.src, e.dst, e.lag, m.dst AS m, m.lag AS m_lag FROM edges e JOIN edges m ON m.src = e.src AND m.dst <> e.dst WHERE m.score > e.score AND e.lag > 0 AND m.lag > 0
    ) SELECT e.src, e.dst, count(j.t) AS n_jumps, count(j.t) FILTER (NOT EXISTS (
        SELECT 1 FROM med x JOIN jumps k ON k.dim = x.m AND k.event <> 0 WHERE x.src = e.src AND x.dst = e.dst AND abs(j.t + x.m_lag - k.t) <= 1)) AS n_clean
    FROM (SELECT DISTINCT src, dst FROM med) e JOIN jumps j ON j.dim = e.src AND j.event <> 0 GROUP BY ALL"""
)
def clean_jumps(spark, sf_dir):
    """Jumps of a source, and those that no mediator of higher score explains."""
    events = jumped(spark, sf_dir)
    mediators = jmp.stronger_mediators(response_edges(events))
    all_ = mediators.select("src", "dst").distinct().join(events.where("event <> 0").select(F.col("dim").alias("src"), "t"), "src").groupBy("src", "dst").agg(F.count("t").alias("n_jumps"))
    clean = jmp.unexplained_jumps(events, mediators).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_clean"))
    return all_.join(clean, ["src", "dst"], "left").na.fill(0, ["n_clean"])


@query(f"WITH {ADAPTIVE} SELECT * FROM parameters")
def adaptive_jump_params(spark, sf_dir):
    panel = events_hourly(spark, sf_dir)
    rows = jmp.adaptive_jump_parameters(jmp.event_statistics(jumped(spark, sf_dir)), pn.shape(panel), jmp.volatility_ratio(panel))
    return rows.select("percentile", "local_window", "rho_window")
