"""The incremental panel against the batch panel."""

from pyspark.sql import functions as F

from lagloom.sources import panel as pn
from lagloom.streaming import panel as live

SCHEMA = "ts timestamp_ntz, kind string, user string, value double"
ORIGIN = "2024-01-01 00:00:00"


def _fed(spark, tmp_path, parts, late="3 hours", runs_again=()):
    """The folder of buckets after the parts came one after another."""
    source, folder, state = (f"file://{tmp_path}/{x}" for x in ("source", "buckets", "state"))
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = live.writer(live.bucketed(stream, "ts", "kind", "value", "HOUR", late, "user"), folder, state)
        query.trigger(availableNow=True).start().awaitTermination()
    return folder


def _times(spark, rows):
    return [tuple(r) for r in spark.createDataFrame(rows, "h double, kind string, user string, value double").select(
        F.expr(f"timestamp_ntz'{ORIGIN}' + make_dt_interval(0, 0, 0, h * 3600)"), "kind", "user", "value").collect()]


def _rows(panel):
    return sorted(tuple(r) for r in panel.select("series_id", "t", "dim", "name", "value").collect())


def test_three_parts_with_one_late(spark, tmp_path):
    first = _times(spark, [(0.1, "a", "u", 1.0), (0.5, "b", "u", 2.0), (1.2, "a", "u", 4.0), (1.3, "a", "v", 8.0), (2.0, None, "u", 5.0)])
    second = _times(spark, [(1.9, "a", "u", 16.0), (3.0, "b", "v", 32.0), (9.5, "a", "u", 64.0)])  # 1.9: open bucket, added
    third = _times(spark, [(2.5, "a", "u", 1000.0), (8.7, "b", "u", 128.0), (10.0, "a", "v", 256.0), (None, "a", "u", 3.0)])  # 2.5: refused
    folder = _fed(spark, tmp_path, [first, second, third])
    taken = spark.createDataFrame(first + second + third[1:], SCHEMA)
    batch = pn.panelize(taken, "ts", "kind", "value", ORIGIN, "HOUR", 11, "user")
    assert _rows(live.read(spark, folder, ORIGIN, "HOUR", 11)) == _rows(batch)
    last = [(s, t - 7, d, n, v) for s, t, d, n, v in _rows(batch) if t >= 7]
    assert _rows(live.trailing(spark, folder, ORIGIN, "HOUR", 4)) == last


def test_a_batch_run_again_counts_once(spark, tmp_path):
    rows = _times(spark, [(0.1, "a", "u", 1.0), (1.5, "b", "u", 2.0)])
    folder = _fed(spark, tmp_path, [rows])
    before = _rows(live.read(spark, folder, ORIGIN, "HOUR", 3))
    again = spark.read.parquet(f"{folder}/batch=0")
    kept = spark.createDataFrame(again.collect(), again.schema)
    kept.write.mode("overwrite").parquet(f"{folder}/batch=0")
    assert _rows(live.read(spark, folder, ORIGIN, "HOUR", 3)) == before == _rows(pn.panelize(spark.createDataFrame(rows, SCHEMA), "ts", "kind", "value", ORIGIN, "HOUR", 3, "user"))
