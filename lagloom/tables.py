"""The driver's tables as panels, and the same panels as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.panel import panelize

FRAMES = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panelize(table(spark, sf_dir, "events"), "ts", "event_type", "value", "2024-01-01 00:00:00", "HOUR", FRAMES)


def user_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panelize(table(spark, sf_dir, "events"), "ts", "event_type", "value", "2024-01-01 00:00:00", "HOUR", FRAMES, "user_id")


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panelize(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_returnflag", "l_extendedprice", "1995-01-02 00:00:00", "DAY", 2499)


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panelize(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority", "o_totalprice", "1995-01-01 00:00:00", "DAY", 2405)


def r6(c) -> F.Column:
    """Rounded to six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _panel_sql(source: str, ts: str, dim: str, value: str, origin: str, unit: str, frames: int) -> str:
    return f"""
dims AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS dim FROM (SELECT DISTINCT {dim} AS name FROM {source})),
sums AS (
  SELECT date_diff('{unit}', TIMESTAMP '{origin}', {ts}) AS t, {dim} AS name, sum({value}) AS value FROM {source} GROUP BY 1, 2
),
panel AS (
  SELECT s.t, CAST(d.dim AS INTEGER) AS dim, d.name, coalesce(v.value, 0.0) AS value
  FROM (SELECT CAST(range AS BIGINT) AS t FROM range({frames})) s CROSS JOIN dims d
  LEFT JOIN sums v ON v.t = s.t AND v.name = d.name
)"""


EVENTS = _panel_sql("events", "ts", "event_type", "value", "2024-01-01", "hour", FRAMES)
LINEITEM = _panel_sql("lineitem", "l_shipdate", "l_returnflag", "l_extendedprice", "1995-01-02", "day", 2499)
ORDERS = _panel_sql("orders", "o_orderdate", "o_orderpriority", "o_totalprice", "1995-01-01", "day", 2405)

DISP = EVENTS + """,
scaled AS (SELECT *, stddev_pop(value) OVER (PARTITION BY dim ORDER BY t ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS s FROM panel),
disp AS (
  SELECT * FROM (
    SELECT t, dim, name, (lead(value) OVER w - value) / (lead(s) OVER w + 1e-10) AS disp FROM scaled
    WINDOW w AS (PARTITION BY dim ORDER BY t)
  ) WHERE disp IS NOT NULL
)"""

JUMPS = DISP + """,
cuts AS (SELECT dim, quantile_cont(abs(disp), 0.9) AS threshold FROM disp GROUP BY dim),
jumps AS (
  SELECT d.*, threshold, CAST(CASE WHEN round(abs(disp), 12) > round(threshold, 12) THEN sign(disp) ELSE 0 END AS INTEGER) AS event
  FROM disp d JOIN cuts USING (dim)
)"""

LAGGED = """,
pairs AS (
  SELECT a.dim AS src, b.dim AS dst, l.lag, a.t, a.disp AS x, b.disp AS y
  FROM disp a CROSS JOIN (SELECT CAST(range AS INTEGER) AS lag FROM range(1, 6)) l
  JOIN disp b ON b.t = a.t + l.lag AND b.dim <> a.dim
)"""

RESPONSES = LAGGED + """,
stats AS (
  SELECT src, dst, lag, avg(y * sign(x)) AS mean, stddev_samp(y * sign(x)) AS sd, count(*) AS n FROM pairs GROUP BY ALL
),
cons AS (
  SELECT a.dim AS src, b.dim AS dst, l.lag, count(*) AS n_jumps,
         CASE WHEN count(*) < 5 THEN 0.5 ELSE greatest(avg((b.disp * a.event > 0)::INT), 1 - avg((b.disp * a.event > 0)::INT)) END AS consistency
  FROM jumps a CROSS JOIN (SELECT CAST(range AS INTEGER) AS lag FROM range(1, 6)) l
  JOIN jumps b ON b.t = a.t + l.lag AND b.dim <> a.dim
  WHERE a.event <> 0 GROUP BY ALL
),
best AS (
  SELECT * FROM (
    SELECT src, dst, lag, mean, coalesce(consistency, 0.5) AS c,
           abs(mean) * (1 + 2 * (coalesce(consistency, 0.5) - 0.5)) AS score,
           row_number() OVER (PARTITION BY src, dst ORDER BY abs(mean) * (1 + 2 * (coalesce(consistency, 0.5) - 0.5)) DESC, lag) AS n
    FROM stats LEFT JOIN cons USING (src, dst, lag)
  ) WHERE n = 1
),
edges AS (
  SELECT src, dst, score, mean AS raw, lag, CAST(sign(mean) AS INTEGER) AS sign, c AS consistency FROM best
)"""


def student_sql(t: str, df: str) -> str:
    """Two-sided p of t with whole degrees of freedom, by the finite series in
    the angle atan(t / sqrt(df))."""
    angle, c = f"atan(abs({t}) / sqrt({df}))", f"(({df}) / (({df}) + ({t}) * ({t})))"
    down = lambda top: f"list_prepend(1.0::DOUBLE, list_transform(range(CAST({top} AS BIGINT), 0, -1), lambda j: j::DOUBLE))"
    odd = f"list_reduce({down(f'(({df}) - 3) // 2')}, lambda s, j: 1 + s * {c} * 2 * j / (2 * j + 1))"
    even = f"list_reduce({down(f'(({df}) - 2) // 2')}, lambda s, j: 1 + s * {c} * (2 * j - 1) / (2 * j))"
    return f"CASE WHEN ({df}) % 2 = 1 THEN 1 - 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {odd}) ELSE 1 - sin({angle}) * {even} END"


def normal_sql(z: str) -> str:
    """Two-sided p of z: erfc(|z| / sqrt 2) by its series or its fraction."""
    x = f"(abs({z}) / sqrt(2))"
    series = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(30, 0, -1), lambda j: j::DOUBLE)), lambda s, j: 1 + s * 2 * {x} * {x} / (2 * j + 1))"
    fraction = f"list_reduce(list_prepend({x}, list_transform(range(80, 0, -1), lambda j: j::DOUBLE)), lambda s, j: {x} + j / 2 / s)"
    return f"CASE WHEN {x} < 1.5 THEN 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {x} * {series} ELSE exp(-{x} * {x}) / sqrt(pi()) / {fraction} END"


def response_p_sql(mean: str = "mean", sd: str = "sd", n: str = "n") -> str:
    return f"CASE WHEN {n} <= 2 THEN 1.0 WHEN {sd} > 1e-12 THEN {student_sql(f'({mean} / ({sd} / sqrt({n})))', f'({n} - 1)')} WHEN abs({mean}) > 0 THEN 0.0 ELSE 1.0 END"


#: The two measures of the first events and the parameters that follow.
_ADAPTIVE = """,
flags AS (SELECT t, dim, abs(event) AS e FROM jumps),
measures AS (
  SELECT (SELECT avg(e) FROM flags) AS density,
         (SELECT avg(p) FROM (SELECT avg(a.e * b.e) AS p FROM flags a JOIN flags b ON a.t = b.t AND a.dim < b.dim GROUP BY a.dim, b.dim)) AS cofiring,
         (SELECT avg(s) FROM (SELECT stddev_pop(d) AS s FROM (SELECT dim, lead(value) OVER (PARTITION BY dim ORDER BY t) - value AS d FROM panel) GROUP BY dim))
           / ((SELECT stddev_pop(value) FROM panel) + 1e-10) AS ratio
),
parameters AS (
  SELECT least(CASE WHEN density > 0.15 THEN 92.0 WHEN density < 0.03 THEN 87.0 ELSE 90.0 END + CASE WHEN cofiring > 0.02 THEN 1 ELSE 0 END, 97.0)::DOUBLE AS percentile,
         CAST(least(greatest(floor(20 * CASE WHEN ratio > 1.5 THEN 0.8 ELSE 1.0 END), 5), 144) AS INTEGER) AS local_window,
         CAST(least(greatest(floor(30 * CASE WHEN ratio > 1.5 THEN 0.8 ELSE 1.0 END), 5), 144) AS INTEGER) AS rho_window FROM measures
)"""
ADAPTIVE = JUMPS + _ADAPTIVE


def _renamed(sql: str) -> str:
    import re

    return re.sub(r"\b(disp|jumps|cuts|scaled)\b", r"first_\1", sql)


#: Events by the parameters that the first events led to.
ADAPTED = _renamed(ADAPTIVE) + """,
scaled AS (
  SELECT a.t, a.dim, a.name, any_value(a.value) AS value, stddev_pop(b.value) AS s
  FROM panel a CROSS JOIN parameters p JOIN panel b ON b.dim = a.dim AND b.t BETWEEN a.t - p.local_window AND a.t + p.local_window GROUP BY ALL
),
disp AS (
  SELECT * FROM (
    SELECT t, dim, name, (lead(value) OVER w - value) / (lead(s) OVER w + 1e-10) AS disp FROM scaled WINDOW w AS (PARTITION BY dim ORDER BY t)
  ) WHERE disp IS NOT NULL
),
sorted AS (SELECT dim, list_sort(list(abs(disp))) AS x, (count(*) - 1) * (SELECT percentile / 100 FROM parameters) AS place FROM disp GROUP BY dim),
cuts AS (SELECT dim, x[floor(place)::INT + 1] + (x[ceil(place)::INT + 1] - x[floor(place)::INT + 1]) * (place - floor(place)) AS threshold FROM sorted),
jumps AS (
  SELECT d.*, threshold, CAST(CASE WHEN round(abs(disp), 12) > round(threshold, 12) THEN sign(disp) ELSE 0 END AS INTEGER) AS event
  FROM disp d JOIN cuts USING (dim)
)"""
