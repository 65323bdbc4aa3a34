"""Queries on edge tables, regimes and evaluation, with their SQL.

The edges are sums of keys of lineitem: whole numbers, so both engines start
from equal values.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import evaluate as ev
from .operators import graph as g
from .operators import regimes as rg
from .operators import scores as sc
from .sources import panel as pn
from .tables import EVENTS, LINEITEM, events_hourly, lineitem_daily, r6, table

QUERIES, ORACLES = {}, {}

EDGES = """
raw_edges AS (
  SELECT l_returnflag AS series_id, CAST(l_partkey % 9 AS INTEGER) AS src, CAST(l_suppkey % 9 AS INTEGER) AS dst,
         CAST(sum(l_orderkey + l_linenumber) % 997 AS BIGINT) AS a, CAST(sum(l_partkey) % 991 AS BIGINT) AS b,
         CAST(sum(l_suppkey) % 983 AS BIGINT) AS c, CAST(sum(l_orderkey * 3 + l_partkey) % 977 AS BIGINT) AS d
  FROM lineitem WHERE l_partkey % 9 <> l_suppkey % 9 GROUP BY ALL
),
edges AS (
  SELECT series_id, src, dst, (a + 1) / 1000.0::DOUBLE AS score, CAST(1 + b % 6 AS INTEGER) AS lag, (c + 1) / 1000.0::DOUBLE AS raw,
         (d + 1) / 1000.0::DOUBLE AS marginal, (d + 1) * (d + 1) / 957003.0::DOUBLE AS p,
         CASE WHEN (a + b) % 3 = 0 THEN 'sync' ELSE 'causal' END AS link_type, CAST(CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS sign,
         (b + 1) / 1000.0::DOUBLE AS structure, CAST((a + c) % 4 = 0 AS INTEGER) AS is_edge
  FROM raw_edges
)"""


def edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_partkey % 9 <> l_suppkey % 9").groupBy(
        F.col("l_returnflag").alias("series_id"), F.expr("cast(l_partkey % 9 AS int)").alias("src"), F.expr("cast(l_suppkey % 9 AS int)").alias("dst")
    ).agg(
        F.expr("sum(l_orderkey + l_linenumber) % 997").alias("a"), F.expr("sum(l_partkey) % 991").alias("b"),
        F.expr("sum(l_suppkey) % 983").alias("c"), F.expr("sum(l_orderkey * 3 + l_partkey) % 977").alias("d"),
    )
    return rows.selectExpr(
        "series_id", "src", "dst", "(a + 1) / 1000.0D AS score", "cast(1 + b % 6 AS int) AS lag", "(c + 1) / 1000.0D AS raw",
        "(d + 1) / 1000.0D AS marginal", "(d + 1) * (d + 1) / 957003.0D AS p",
        "CASE WHEN (a + b) % 3 = 0 THEN 'sync' ELSE 'causal' END AS link_type", "CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END AS sign",
        "(b + 1) / 1000.0D AS structure", "cast((a + c) % 4 = 0 AS int) AS is_edge",
    )


def dims(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.select("series_id", F.col("src").alias("dim")).union(e.select("series_id", "dst")).distinct()


_DIMS = ", d AS (SELECT DISTINCT series_id, src AS dim FROM edges UNION SELECT DISTINCT series_id, dst FROM edges)"


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return named


_UP = "za.score > ab.score AND abs(za.lag + ab.lag - zb.lag) <= greatest(1, zb.lag // 3)"
_MID = "least(az.score, zb.score) >= 0.8 * ab.score AND abs(az.lag + zb.lag - ab.lag) <= greatest(2, ab.lag // 2)"


def _up(rule: str) -> str:
    return (
        "EXISTS (SELECT 1 FROM edges za JOIN edges zb ON zb.series_id = za.series_id AND zb.src = za.src "
        f"WHERE za.series_id = ab.series_id AND za.dst = ab.src AND zb.dst = ab.dst AND za.src NOT IN (ab.src, ab.dst) AND {rule})"
    )


def _mid(rule: str) -> str:
    return (
        "EXISTS (SELECT 1 FROM edges az JOIN edges zb ON zb.series_id = az.series_id AND zb.src = az.dst "
        f"WHERE az.series_id = ab.series_id AND az.src = ab.src AND zb.dst = ab.dst AND az.dst NOT IN (ab.src, ab.dst) AND {rule})"
    )


_KEEP = "SELECT series_id, src, dst, lag FROM edges ab WHERE NOT"


@query(f"WITH {EDGES} {_KEEP} {_up(_UP)}")
def ancestor_filter(spark, sf_dir):
    return g.without_ancestors(edges(spark, sf_dir)).select("series_id", "src", "dst", "lag")


@query(f"WITH {EDGES} {_KEEP} {_mid(_MID)}")
def mediator_filter(spark, sf_dir):
    return g.without_mediated(edges(spark, sf_dir)).select("series_id", "src", "dst", "lag")


@query(f"WITH {EDGES} {_KEEP} ({_up(_UP)} OR {_mid(_MID)})")
def spurious_edge_filter(spark, sf_dir):
    return g.without_spurious(edges(spark, sf_dir)).select("series_id", "src", "dst", "lag")


@query(
    f"WITH {EDGES} {_KEEP} ({_up('za.score >= 0.95 * ab.score AND zb.score >= 0.95 * ab.score AND abs(za.lag + ab.lag - zb.lag) <= 1')} "
    f"OR {_mid('least(az.score, zb.score) >= 0.85 * ab.score AND abs(az.lag + zb.lag - ab.lag) <= 1')})"
)
def textbook_filter(spark, sf_dir):
    return g.textbook_filter(edges(spark, sf_dir)).select("series_id", "src", "dst", "lag")


@query(
    f"""WITH {EDGES}, paths AS (
      SELECT e.series_id, e.src, e.dst, least(im.raw, mj.raw) * least(im.marginal + 1e-12, mj.marginal + 1e-12) * exp(-abs(e.lag - (im.lag + mj.lag))) AS s
      FROM edges e JOIN edges im ON im.series_id = e.series_id AND im.src = e.src JOIN edges mj ON mj.series_id = e.series_id AND mj.src = im.dst AND mj.dst = e.dst
    ) SELECT series_id, src, dst, round(coalesce(max(s), 0), 6) + 0.0 AS indirect FROM edges LEFT JOIN paths USING (series_id, src, dst) GROUP BY ALL"""
)
def indirect_support(spark, sf_dir):
    return g.indirect_support(edges(spark, sf_dir)).select("series_id", "src", "dst", r6("indirect").alias("indirect"))


def _bh(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f""", r AS (SELECT *, row_number() OVER ({part} ORDER BY p) AS k, count(*) OVER ({part}) AS m FROM edges),
    q AS (SELECT *, least(1.0, min(p * m / k) OVER ({part} ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)"""


@query(f"WITH {EDGES}{_bh('series_id')} SELECT series_id, src, dst, round(q, 6) + 0.0 AS q FROM q")
def bh_fdr_directed(spark, sf_dir):
    return g.with_bh(edges(spark, sf_dir)).select("series_id", "src", "dst", r6("q").alias("q"))


@query(f"WITH {EDGES}{_bh('series_id, src')} SELECT series_id, src, dst, round(q, 6) + 0.0 AS q FROM q")
def bh_fdr_per_source(spark, sf_dir):
    return g.with_bh(edges(spark, sf_dir), keys=("series_id", "src")).select("series_id", "src", "dst", r6("q").alias("q"))


@query(f"WITH {EDGES.replace('FROM raw_edges', 'FROM raw_edges WHERE src < dst')}{_bh('series_id')} SELECT series_id, src, dst, round(q, 6) + 0.0 AS q FROM q")
def bh_fdr(spark, sf_dir):
    return g.with_bh(edges(spark, sf_dir).where("src < dst")).select("series_id", "src", "dst", r6("q").alias("q"))


@query(
    f"WITH {EDGES} SELECT series_id, src, dst, round((row_number() OVER (PARTITION BY series_id ORDER BY raw, src, dst) - 1) / (count(*) OVER (PARTITION BY series_id) - 1), 6) + 0.0 AS rank_share FROM edges"
)
def rank_norm(spark, sf_dir):
    return edges(spark, sf_dir).select("series_id", "src", "dst", r6(g.rank_share("raw", "series_id")).alias("rank_share"))


@query(
    f"""WITH {EDGES}{_DIMS}, ends AS (SELECT series_id, src AS dim, score FROM edges UNION ALL SELECT series_id, dst, score FROM edges),
    s AS (SELECT series_id, dim, sum(score) AS c FROM ends GROUP BY ALL),
    w AS (SELECT *, avg(c) OVER (PARTITION BY series_id) + stddev_pop(c) OVER (PARTITION BY series_id) AS cut FROM s)
    SELECT series_id, dim, round(c, 6) + 0.0 AS connectivity, CAST(row_number() OVER (PARTITION BY series_id ORDER BY c DESC, dim) AS INTEGER) AS place FROM w WHERE c > cut"""
)
def hubs(spark, sf_dir):
    return g.hubs(edges(spark, sf_dir), dims(spark, sf_dir)).select("series_id", "dim", r6("connectivity").alias("connectivity"), "place")


@query(
    f"""WITH {EDGES}{_DIMS}, x AS (
      SELECT d.series_id, d.dim, coalesce((SELECT sum(score) FROM edges e WHERE e.series_id = d.series_id AND e.src = d.dim AND is_edge = 1), 0) AS o,
             coalesce((SELECT sum(score) FROM edges e WHERE e.series_id = d.series_id AND e.dst = d.dim AND is_edge = 1), 0) AS i FROM d
    ), r AS (SELECT *, CASE WHEN o > 0 AND o > 1.5 * i THEN 'driver' WHEN i > 0 AND i > 1.5 * o THEN 'follower' END AS role FROM x)
    SELECT series_id, dim, round(o, 6) + 0.0 AS out_strength, round(i, 6) + 0.0 AS in_strength, role,
      CAST(CASE WHEN role IS NOT NULL THEN row_number() OVER (PARTITION BY series_id, role ORDER BY CASE WHEN role = 'driver' THEN o ELSE i END DESC, dim) ELSE 0 END AS INTEGER) AS place FROM r"""
)
def roles(spark, sf_dir):
    rows = g.roles(edges(spark, sf_dir).where("is_edge = 1"), dims(spark, sf_dir))
    return rows.select("series_id", "dim", r6("out_strength").alias("out_strength"), r6("in_strength").alias("in_strength"), "role", F.coalesce("place", F.lit(0)).alias("place"))


@query(
    f"""WITH {EDGES}, n AS (SELECT series_id, count(*) FILTER (link_type = 'sync') AS n_sync, count(*) FILTER (link_type = 'causal') AS n_causal FROM edges GROUP BY ALL)
    SELECT *, CASE WHEN n_sync + n_causal = 0 THEN 'independent' WHEN n_sync > 2 * n_causal THEN 'parallel' WHEN n_causal > 2 * n_sync THEN 'cascade' ELSE 'mixed' END AS pattern FROM n"""
)
def pattern(spark, sf_dir):
    e = edges(spark, sf_dir)
    return g.pattern(e, e.select("series_id").distinct()).select("series_id", "n_sync", "n_causal", "pattern")


@query(
    f"""WITH {EDGES}, b AS (SELECT series_id, src, dst, is_edge FROM edges UNION ALL SELECT series_id, dst, src, is_edge FROM edges)
    SELECT series_id, src, dst, max(is_edge) AS is_edge FROM b GROUP BY ALL"""
)
def undirected(spark, sf_dir):
    return g.undirected(edges(spark, sf_dir))


@query(
    f"""WITH {EDGES}, both_ways AS (SELECT series_id, src, dst, score, lag FROM edges UNION ALL SELECT series_id, src, dst, raw, lag + 1 FROM edges)
    SELECT series_id, src, dst, score, lag FROM (SELECT *, row_number() OVER (PARTITION BY series_id, src, dst ORDER BY score DESC, lag) AS n FROM both_ways) WHERE n = 1"""
)
def strongest_link(spark, sf_dir):
    e = edges(spark, sf_dir)
    both = e.select("series_id", "src", "dst", "score", "lag").union(e.select("series_id", "src", "dst", "raw", F.col("lag") + 1))
    return g.strongest(both)


@query(f"WITH {EDGES} SELECT series_id, src, dst, CAST(score > quantile_cont(score, 0.65) OVER (PARTITION BY series_id) AS INTEGER) AS is_edge FROM edges")
def binarize_percentile(spark, sf_dir):
    return sc.binarized(edges(spark, sf_dir)).select("series_id", "src", "dst", "is_edge")


@query(
    f"""WITH {EDGES}, b AS (SELECT series_id, src, dst, CAST(score >= quantile_cont(score, 0.75) OVER (PARTITION BY series_id) AS INTEGER) AS e FROM edges)
    SELECT series_id, src, dst, max(e) OVER (PARTITION BY series_id, least(src, dst), greatest(src, dst)) AS is_edge FROM b"""
)
def binarize_at_least(spark, sf_dir):
    return sc.binarized_at_least(edges(spark, sf_dir), symmetric=True).select("series_id", "src", "dst", "is_edge")


@query(f"WITH {EDGES} SELECT series_id, src, dst, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, src, dst) AS place FROM edges")
def ranked_links(spark, sf_dir):
    return g.ranked(edges(spark, sf_dir), "score", "src", "dst").select("series_id", "src", "dst", F.col("place").cast("long").alias("place"))


@query(f"WITH {EDGES} SELECT series_id, src, dst, score, lag FROM edges WHERE score > 0.3 AND src <> dst")
def min_effect(spark, sf_dir):
    return sc.strong(edges(spark, sf_dir), 0.3).select("series_id", "src", "dst", "score", "lag")


@query(
    f"""WITH {EDGES}, m AS (SELECT CASE WHEN src % 2 = 0 THEN 'even' ELSE 'odd' END AS method, avg(score) AS f1_directed, avg(raw) AS f1_undirected,
      avg(CASE WHEN lag > 2 THEN lag END) AS lag_mae, avg(marginal) AS sign_accuracy, avg(CASE WHEN is_edge = 1 THEN structure END) AS spurious_rate FROM edges GROUP BY ALL),
    c AS (SELECT *, (1.5 * f1_directed + f1_undirected + 1 / (1 + lag_mae) + 0.8 * sign_accuracy + 0.8 * (1 - spurious_rate)) / 5.1 AS c FROM m)
    SELECT method, round(f1_directed, 6) + 0.0 AS f1_directed, round(lag_mae, 6) + 0.0 AS lag_mae, round(c, 6) + 0.0 AS composite, CAST(rank() OVER (ORDER BY c DESC) AS BIGINT) AS place FROM c"""
)
def method_summary(spark, sf_dir):
    rows = edges(spark, sf_dir).select(
        F.expr("CASE WHEN src % 2 = 0 THEN 'even' ELSE 'odd' END AS method"), F.col("score").alias("f1_directed"), F.col("raw").alias("f1_undirected"),
        F.expr("CASE WHEN lag > 2 THEN lag END AS lag_mae"), F.col("marginal").alias("sign_accuracy"), F.expr("CASE WHEN is_edge = 1 THEN structure END AS spurious_rate"),
    )
    return ev.method_summary(rows).select("method", r6("f1_directed").alias("f1_directed"), r6("lag_mae").alias("lag_mae"), r6("composite").alias("composite"), F.col("place").cast("long").alias("place"))


@query(f"WITH {EDGES}{_DIMS} SELECT a.series_id, a.dim AS src, b.dim AS dst FROM d a JOIN d b USING (series_id) WHERE a.dim <> b.dim")
def pair_spine(spark, sf_dir):
    return g.pair_spine(dims(spark, sf_dir))


@query(f"WITH {EDGES} SELECT series_id, src, dst FROM (SELECT *, quantile_cont(marginal, 0.5) OVER (PARTITION BY series_id) AS c FROM edges) WHERE marginal >= c")
def confidence_prune(spark, sf_dir):
    return sc.confident(edges(spark, sf_dir).withColumn("confidence", F.col("marginal"))).select("series_id", "src", "dst")


_MAX = "{0} / max({0}) OVER (PARTITION BY series_id)"


@query(
    f"WITH {EDGES} SELECT series_id, src, dst, round(0.65 * {_MAX.format('score')} + 0.35 * (0.65 * {_MAX.format('raw')} + 0.35 * {_MAX.format('marginal')}), 6) + 0.0 AS mixed FROM edges"
)
def score_mixed(spark, sf_dir):
    return edges(spark, sf_dir).select("series_id", "src", "dst", r6(sc.mixed_score("score", "raw", "marginal")).alias("mixed"))


@query(
    f"""WITH {EDGES}, m AS (SELECT *, median(score) OVER (PARTITION BY series_id, dst) AS m FROM edges),
    d AS (SELECT *, median(abs(score - m)) OVER (PARTITION BY series_id, dst) AS d FROM m),
    z AS (SELECT *, (score - m) / (1.4826 * d + 1e-12) AS z FROM d),
    s AS (SELECT *, score * CASE WHEN z > 3 THEN 2.0 WHEN z > 1.5 THEN 1.5 WHEN z > 0.5 THEN 1.0 ELSE 0.3 END AS s FROM z)
    SELECT series_id, src, dst, round({_MAX.format('s')}, 6) + 0.0 AS anomaly FROM s"""
)
def anomaly_score(spark, sf_dir):
    return sc.anomaly_score(edges(spark, sf_dir), "score").select("series_id", "src", "dst", r6("anomaly").alias("anomaly"))


@query(
    f"""WITH {EDGES}{_bh('series_id')}, f AS (
      SELECT *, {_MAX.format('raw')} * (0.7 + 0.3 * {_MAX.format('structure')}) * CASE WHEN q < 0.3 THEN 1 ELSE 0.05 END AS fused FROM q
    ), c AS (SELECT *, quantile_cont(fused, 0.5) OVER (PARTITION BY series_id) AS tau FROM f)
    SELECT series_id, src, dst, round(fused, 6) + 0.0 AS fused, CAST(q < 0.3 AND fused > tau AS INTEGER) AS is_edge FROM c"""
)
def fuse_suppress(spark, sf_dir):
    rows = sc.fuse_suppress(g.with_bh(edges(spark, sf_dir).drop("is_edge")), alpha=0.3)
    return rows.select("series_id", "src", "dst", r6("fused").alias("fused"), "is_edge")


@query(
    f"""WITH {EDGES}{_bh('series_id')}, l AS (SELECT *, -log10(q + 1e-300) AS st FROM q), f AS (
      SELECT *, pow(greatest({_MAX.format('raw')}, 1e-300), 0.4) * pow(greatest(greatest(st, 0) / max(st) OVER (PARTITION BY series_id), 1e-300), 0.3) * pow(greatest({_MAX.format('structure')}, 1e-300), 0.3) AS fused FROM l
    ) SELECT series_id, src, dst, round(fused, 6) + 0.0 AS fused FROM f"""
)
def fuse_geometric(spark, sf_dir):
    rows = sc.fuse_geometric(g.with_bh(edges(spark, sf_dir).drop("is_edge")))
    return rows.select("series_id", "src", "dst", r6("fused").alias("fused"))


@query(
    f"""WITH {EDGES}{_bh('series_id')}, l AS (SELECT *, -log10(q + 1e-300) AS st FROM q)
    SELECT series_id, src, dst, round((0.4 * (row_number() OVER (PARTITION BY series_id ORDER BY raw, src, dst) - 1) + 0.3 * (row_number() OVER (PARTITION BY series_id ORDER BY st, src, dst) - 1)
      + 0.3 * (row_number() OVER (PARTITION BY series_id ORDER BY structure, src, dst) - 1)) / (count(*) OVER (PARTITION BY series_id) - 1), 6) + 0.0 AS consensus FROM l"""
)
def consensus(spark, sf_dir):
    rows = sc.consensus(g.with_bh(edges(spark, sf_dir)))
    return rows.select("series_id", "src", "dst", r6("consensus").alias("consensus"))


_DIRECT = f"""WITH {EDGES}, i AS (
  SELECT *, 0.1 AS base, 0.1 + structure AS self_mse, 0.3 + structure AS null_mse, 0.1 + marginal / 2 AS pair_mse FROM edges
), a AS (SELECT *, greatest(self_mse - base, 0) AS gs, greatest(null_mse - base, 0) AS gn FROM i),
b AS (SELECT *, greatest(gs, 0.25 * gn, 1e-12) AS dn, gs / (gn + 1e-12) AS ra FROM a),
c AS (SELECT *, (score / dn) / (1 + score / dn) AS u, (greatest(self_mse - pair_mse, 0) / dn) / (1 + greatest(self_mse - pair_mse, 0) / dn) AS mg,
      least(greatest(1 - ra, 0.2), 0.9) AS eta, least(greatest(1 - 0.5 * ra, 0.5), 0.9) AS beta FROM b),
h AS (SELECT *, eta * u + (1 - eta) * mg AS ne FROM c),
paths AS (
  SELECT e.series_id, e.src, e.dst, max(least(x.raw, y.raw) * least(x.mg + 1e-12, y.mg + 1e-12) * exp(-abs(e.lag - (x.lag + y.lag)))) AS ind
  FROM h e JOIN h x ON x.series_id = e.series_id AND x.src = e.src JOIN h y ON y.series_id = e.series_id AND y.src = x.dst AND y.dst = e.dst GROUP BY ALL
), k AS (SELECT h.*, coalesce(ind, 0) AS ind FROM h LEFT JOIN paths USING (series_id, src, dst)),
f AS (SELECT *, least(greatest(ne / (ne + ind + 1e-12), 0), 1) AS ir FROM k)
SELECT series_id, src, dst, round(ne, 6) + 0.0 AS necessity, round(ir, 6) + 0.0 AS irreducibility,
       round((0.35 * raw / max(raw) OVER (PARTITION BY series_id) + 0.65 * ne / max(ne) OVER (PARTITION BY series_id)) * (beta + (1 - beta) * ir), 6) + 0.0 AS direct_score FROM f"""


@query(_DIRECT)
def direct_scores(spark, sf_dir):
    e = edges(spark, sf_dir).withColumnsRenamed({"marginal": "m0"}).selectExpr(
        "*", "score AS delta_mse", "0.1D AS baseline_mse", "0.1D + structure AS self_mse", "0.3D + structure AS null_mse", "0.1D + m0 / 2 AS pair_mse"
    )
    rows = sc.direct_scores(e)
    return rows.select("series_id", "src", "dst", *(r6(c).alias(c) for c in ("necessity", "irreducibility", "direct_score")))


@query(
    f"""WITH {EVENTS}, s AS (SELECT dim, t, abs(value - lag(value) OVER (PARTITION BY dim ORDER BY t)) AS d FROM panel WHERE t BETWEEN 376 AND 400),
    k AS (SELECT dim, d, row_number() OVER (PARTITION BY dim ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY dim) AS m FROM s WHERE d IS NOT NULL),
    x AS (SELECT dim, sum(d * (0.5 + 1.5 * k / (m - 1))) AS score FROM k GROUP BY dim)
    SELECT dim, round(score, 5) + 0.0 AS score, CAST(row_number() OVER (ORDER BY score DESC, dim) AS INTEGER) AS place FROM (SELECT *, avg(score) OVER () + stddev_pop(score) OVER () AS cut FROM x) WHERE score > cut"""
)
def initiators(spark, sf_dir):
    return g.initiators(events_hourly(spark, sf_dir), 400).select("dim", (F.round("score", 5) + 0.0).alias("score"), "place")


@query(
    f"""WITH {EVENTS}, s AS (SELECT dim, t, abs(value - lag(value) OVER (PARTITION BY dim ORDER BY t)) AS d FROM panel WHERE t BETWEEN 376 AND 400),
    k AS (SELECT dim, d, row_number() OVER (PARTITION BY dim ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY dim) AS m, avg(d) OVER (PARTITION BY dim) + 1.5 * stddev_pop(d) OVER (PARTITION BY dim) AS cut FROM s WHERE d IS NOT NULL),
    o AS (SELECT dim, CAST(coalesce(min(k) FILTER (d > cut), max(m)) AS BIGINT) AS onset FROM k GROUP BY dim)
    SELECT dim, onset, CAST(row_number() OVER (ORDER BY onset, dim) AS INTEGER) AS place FROM o"""
)
def propagation_order(spark, sf_dir):
    return g.propagation_order(events_hourly(spark, sf_dir), 400).select("dim", "onset", "place")


_LABELS = f"""{EVENTS}, labels AS (SELECT t, arg_min(dim, struct_pack(a := -value, b := dim)) % 3 AS label FROM panel GROUP BY t)"""


def labels(spark, sf_dir):
    """The dimension of the hour's largest value, in three classes."""
    w = Window.partitionBy("series_id", "t").orderBy(F.desc("value"), "dim")
    rows = events_hourly(spark, sf_dir).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.select("series_id", "t", (F.col("dim") % 3).alias("label"))


@query(
    f"""WITH {_LABELS}, r AS (SELECT t, label, sum(c) OVER (ORDER BY t) AS run FROM (SELECT t, label, CASE WHEN label = lag(label) OVER (ORDER BY t) THEN 0 ELSE 1 END AS c FROM labels)),
    s AS (SELECT any_value(label) AS regime_id, min(t) AS start, max(t) + 1 AS "end" FROM r GROUP BY run HAVING count(*) >= 3)
    SELECT CAST(row_number() OVER (ORDER BY start) - 1 AS INTEGER) AS segment_id, regime_id, start, "end", "end" - start AS n_frames FROM s"""
)
def segments(spark, sf_dir):
    return rg.segments(labels(spark, sf_dir), least=3).drop("series_id").withColumn("segment_id", F.col("segment_id").cast("int"))


@query(
    f"""WITH {_LABELS}, v AS (SELECT a.t, b.label, count(*) AS n FROM labels a JOIN labels b ON b.t BETWEEN a.t - 2 AND a.t + 2 GROUP BY ALL)
    SELECT t, label AS smooth FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, label) AS k FROM v) WHERE k = 1"""
)
def label_smoothing(spark, sf_dir):
    return rg.smoothed(labels(spark, sf_dir)).select("t", "smooth")


@query(
    f"""WITH RECURSIVE {_LABELS}, v AS (SELECT a.t, b.label, count(*) AS n FROM labels a JOIN labels b ON b.t BETWEEN a.t - 2 AND a.t + 2 GROUP BY ALL),
    smooth AS (SELECT t, label FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, label) AS k FROM v) WHERE k = 1),
    found AS (SELECT list(t ORDER BY t) AS f FROM (SELECT t, label IS DISTINCT FROM lag(label) OVER (ORDER BY t) AS new FROM labels) WHERE new),
    truth AS (SELECT list(t ORDER BY t) AS b FROM (SELECT t, label IS DISTINCT FROM lag(label) OVER (ORDER BY t) AS new FROM smooth) WHERE new),
    taken(i, left_) AS (
      SELECT 0, f FROM found
      UNION ALL
      SELECT i + 1, list_filter(left_, lambda y: y IS DISTINCT FROM list_filter(left_, lambda x: abs(b[i + 1] - x) <= 2)[1]) FROM taken, truth WHERE i < len(b)
    ) SELECT round(2 * (len(f) - len(left_)) / (len(f) + len(b)), 6) + 0.0 AS boundary_f1 FROM taken, found, truth WHERE i = len(b)"""
)
def boundary_f1(spark, sf_dir):
    """How well boundaries of the hourly labels meet those of the smoothed ones."""
    smooth = rg.smoothed(labels(spark, sf_dir))
    found, truth = (rg.segments(smooth, c).select("series_id", F.col("start").alias("t")) for c in ("label", "smooth"))
    return ev.boundary_f1(found, truth, 2).select(r6("boundary_f1").alias("boundary_f1"))


@query(
    f"""WITH {_LABELS}, s AS (SELECT label AS a, lead(label) OVER (ORDER BY t) AS b FROM labels), n AS (SELECT a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL)
    SELECT a, b, round(n / (sum(n) OVER (PARTITION BY a) + 1e-12), 6) + 0.0 AS share FROM n"""
)
def transition_matrix(spark, sf_dir):
    return rg.transitions(labels(spark, sf_dir)).select("a", "b", r6("share").alias("share"))


@query(
    f"""WITH {EDGES}, b AS (SELECT src, dst, link_type, series_id, score, lag FROM edges UNION ALL SELECT dst, src, link_type, series_id, score, lag FROM edges WHERE link_type = 'sync')
    SELECT src, dst, link_type, round(count(DISTINCT series_id) / 3, 6) + 0.0 AS frequency, round(avg(score), 6) + 0.0 AS mean_score, round(avg(lag), 6) + 0.0 AS mean_lag FROM b GROUP BY ALL"""
)
def edge_frequency(spark, sf_dir):
    e = edges(spark, sf_dir).withColumnRenamed("series_id", "segment_id").withColumn("series_id", F.lit("all"))
    rows = rg.edge_frequency(e, e.select("series_id", "segment_id").distinct())
    return rows.select("src", "dst", "link_type", *(r6(c).alias(c) for c in ("frequency", "mean_score", "mean_lag")))


@query(
    f"""WITH {EVENTS}, r AS (SELECT corr(a.value, b.value) AS r FROM panel a JOIN panel b ON a.t = b.t AND a.dim < b.dim GROUP BY a.dim, b.dim), s AS (SELECT avg(abs(r)) AS m, max(abs(r)) AS x FROM r)
    SELECT round(m, 6) + 0.0 AS mean_corr, round(x, 6) + 0.0 AS max_corr, round(21 / 715.0::DOUBLE, 6) + 0.0 AS feature_ratio, CASE WHEN m < 0.1 THEN 'weak' WHEN m < 0.2 THEN 'moderate' ELSE 'strong' END AS regime FROM s"""
)
def gate(spark, sf_dir):
    from .operators.lagged import pair_corr

    panel = events_hourly(spark, sf_dir)
    rows = sc.correlation_gate(pair_corr(panel), pn.shape(panel))
    return rows.select(r6("mean_corr").alias("mean_corr"), r6("max_corr").alias("max_corr"), r6("feature_ratio").alias("feature_ratio"), "regime")


_TRUTH = ", truth AS (SELECT series_id, src, dst, CAST((src * 7 + dst) % 3 = 0 AS INTEGER) AS is_edge, CAST(1 + (src + dst) % 6 AS INTEGER) AS lag, 1 AS sign, CAST((src + dst) % 5 = 0 AS INTEGER) AS forbidden FROM edges)"


def _truth(e):
    return e.selectExpr(
        "series_id", "src", "dst", "cast((src * 7 + dst) % 3 = 0 AS int) AS is_edge", "1 + (src + dst) % 6 AS lag", "1 AS sign",
        "cast((src + dst) % 5 = 0 AS int) AS forbidden",
    )


@query(
    f"""WITH {EDGES}{_TRUTH}, j AS (SELECT t.*, e.is_edge AS hit, e.lag AS el, e.sign AS es FROM truth t JOIN edges e USING (series_id, src, dst)),
    p AS (SELECT series_id, max(is_edge) AS is_edge, max(hit) AS hit FROM j GROUP BY series_id, least(src, dst), greatest(src, dst)),
    u AS (SELECT series_id, 2 * count(*) FILTER (is_edge = 1 AND hit = 1) / (2 * count(*) FILTER (is_edge = 1 AND hit = 1) + count(*) FILTER (is_edge <> hit)) AS f1u FROM p GROUP BY ALL),
    d AS (SELECT series_id, count(*) FILTER (is_edge = 1 AND hit = 1) AS tp, count(*) FILTER (is_edge = 0 AND hit = 1) AS fp, count(*) FILTER (is_edge = 1 AND hit = 0) AS fn,
      avg(abs(el - lag)) FILTER (is_edge = 1 AND hit = 1) AS lm, avg((es = sign)::INT) FILTER (is_edge = 1 AND hit = 1) AS sa, avg(hit) FILTER (forbidden = 1) AS sp FROM j GROUP BY ALL)
    SELECT series_id, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / (tp + fn), 6) + 0.0 AS recall, round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1_directed, round(f1u, 6) + 0.0 AS f1_undirected,
      round(lm, 6) + 0.0 AS lag_mae, round(sa, 6) + 0.0 AS sign_accuracy, round(sp, 6) + 0.0 AS spurious_rate,
      round((1.5 * 2 * tp / (2 * tp + fp + fn) + f1u + 1 / (1 + lm) + 0.8 * sa + 0.8 * (1 - sp)) / 5.1, 6) + 0.0 AS composite FROM d JOIN u USING (series_id)"""
)
def eval_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    rows = ev.composite(ev.edge_metrics(e, _truth(e)))
    names = ("precision", "recall", "f1_directed", "f1_undirected", "lag_mae", "sign_accuracy", "spurious_rate", "composite")
    return rows.select("series_id", *(r6(c).alias(c) for c in names))


@query(
    f"""WITH {EDGES}{_TRUTH}, j AS (SELECT series_id, e.score, t.is_edge AS y, CAST(e.lag = t.lag AS INTEGER) AS ok FROM truth t JOIN edges e USING (series_id, src, dst)),
    auc AS (SELECT a.series_id, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM j a JOIN j b ON a.series_id = b.series_id AND a.y = 1 AND b.y = 0 GROUP BY ALL),
    lv AS (SELECT DISTINCT series_id, score AS cut FROM j),
    pr AS (SELECT l.series_id, cut, sum(y) FILTER (j.score >= cut) AS tp, count(*) FILTER (j.score >= cut) AS called, sum(y * ok) FILTER (j.score >= cut) AS lags, sum(y) AS pos, count(*) AS n, sum(y) FILTER (j.score = cut) AS here
      FROM lv l JOIN j ON j.series_id = l.series_id GROUP BY ALL),
    ap AS (SELECT series_id, sum(here / pos * tp / called) AS ap FROM pr GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY 2 * (tp / called) * (tp / pos) / (tp / called + tp / pos + 1e-10) DESC, cut) AS k FROM pr)
    SELECT series_id, round(auc, 6) + 0.0 AS auc, round(ap, 6) + 0.0 AS average_precision, round(2 * (tp / called) * (tp / pos) / (tp / called + tp / pos + 1e-10), 6) + 0.0 AS f,
      round((called - tp) / (n - pos), 6) + 0.0 AS fpr, round(tp / pos, 6) + 0.0 AS tpr, round(lags / tp, 6) + 0.0 AS true_lag_share FROM b JOIN auc USING (series_id) JOIN ap USING (series_id) WHERE k = 1"""
)
def eval_ranking(spark, sf_dir):
    e = edges(spark, sf_dir)
    t = _truth(e).select("series_id", "src", "dst", F.col("is_edge").alias("label"), F.col("lag").alias("true_lag"))
    rows = e.join(t, ["series_id", "src", "dst"]).select("series_id", "score", "label", (F.col("lag") == F.col("true_lag")).cast("int").alias("lag_ok"))
    names = ("auc", "average_precision", "f", "fpr", "tpr", "true_lag_share")
    return ev.ranking_metrics(rows).select("series_id", *(r6(c).alias(c) for c in names))


@query(
    f"""WITH {LINEITEM}, q AS (SELECT dim, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM panel GROUP BY dim),
    bin AS (SELECT t, dim, (a <= value)::INT + (b <= value)::INT + (c <= value)::INT AS v FROM panel JOIN q USING (dim)),
    tr AS (SELECT x.dim AS src, z.dim AS dst, l.lag, x.v AS x, y.v AS y, z.v AS z FROM bin x CROSS JOIN (SELECT CAST(range AS INTEGER) AS lag FROM range(1, 4)) l JOIN bin z ON z.t = x.t + l.lag AND z.dim <> x.dim JOIN bin y ON y.dim = z.dim AND y.t = z.t - 1),
    k AS (SELECT src, dst, lag, x, y, z, count(*) AS c FROM tr GROUP BY ALL),
    w AS (SELECT *, sum(c) OVER (PARTITION BY src, dst, lag, x, y) AS cxy, sum(c) OVER (PARTITION BY src, dst, lag, y, z) AS cyz, sum(c) OVER (PARTITION BY src, dst, lag, y) AS cy, sum(c) OVER (PARTITION BY src, dst, lag) AS n FROM k)
    SELECT src, dst, lag, round(sum(c / n * ln((c / cxy) / (cyz / cy))), 6) + 0.0 AS te FROM w GROUP BY ALL"""
)
def transfer_entropy(spark, sf_dir):
    return ev.transfer_entropy(lineitem_daily(spark, sf_dir), 3).select("src", "dst", "lag", r6("te").alias("te"))


_XCORR = """SELECT run, a.dim AS src, b.dim AS dst, l.lag, avg(a.e * b.e) AS score FROM e a CROSS JOIN (SELECT CAST(range AS INTEGER) AS lag FROM range(1, {})) l
    JOIN e b USING (run) WHERE b.t = a.t + l.lag AND b.dim <> a.dim GROUP BY ALL"""


def _fired(panel: str) -> str:
    """e: flags of large steps, by run."""
    return f"""s AS (SELECT * FROM (SELECT run, t, dim, abs(lead(value) OVER (PARTITION BY run, dim ORDER BY t) - value) AS d FROM {panel}) WHERE d IS NOT NULL),
    e AS (SELECT s.run, s.t, s.dim, CAST(round(d, 9) > round(c, 9) AS INTEGER) AS e FROM s JOIN (SELECT run, dim, quantile_cont(d, 0.97) AS c FROM s GROUP BY ALL) USING (run, dim))"""


@query(f"""WITH {EVENTS}, r AS (SELECT 0 AS run, * FROM panel), {_fired("r")} SELECT src, dst, lag, round(score, 6) + 0.0 AS score FROM ({_XCORR.format(6)})""")
def event_xcorr(spark, sf_dir):
    return ev.event_cross_correlation(events_hourly(spark, sf_dir), 5).select("src", "dst", "lag", r6("score").alias("score"))


@query(
    f"""WITH {EVENTS}, runs AS (SELECT CAST(range AS INTEGER) AS run FROM range(31)),
    m AS (SELECT run, dim, value, row_number() OVER (PARTITION BY run, dim ORDER BY CASE WHEN run > 0 THEN md5(concat_ws(',', 0, run, dim, t)) END, t) - 1 AS t FROM panel CROSS JOIN runs),
    {_fired("m")}, x AS (SELECT run, src, dst, max(score) AS score FROM ({_XCORR.format(4)}) GROUP BY ALL)
    SELECT a.src, a.dst, round(a.score, 9) + 0.0 AS score, round((1 + count(*) FILTER (b.score >= a.score)) / 31, 6) + 0.0 AS p
    FROM x a JOIN x b ON a.src = b.src AND a.dst = b.dst AND b.run > 0 WHERE a.run = 0 GROUP BY a.src, a.dst, a.score"""
)
def event_xcorr_permuted(spark, sf_dir):
    score = lambda p: ev.event_cross_correlation(p, 3).groupBy("series_id", "src", "dst").agg(F.max("score").alias("score"))
    panel = events_hourly(spark, sf_dir)
    return ev.permutation_p(panel, score, score(panel), 30).select("src", "dst", (F.round("score", 9) + 0.0).alias("score"), r6("p").alias("p"))
