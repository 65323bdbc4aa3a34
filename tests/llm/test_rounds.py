"""Few jobs for links that are put together; little kept by a worker or the driver."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lagloom.llm import common, jaccard_join, packing, tokens
from lagloom.llm.components import components, stars


def test_stars():
    pairs = [(5, 3), (3, 9), (8, 7), (9, 5), (4, 4)]
    assert sorted(stars(pairs)) == [(5, 3), (8, 7), (9, 3)]
    chain = [(k + 1, k) for k in range(5000)]
    assert set(stars(chain[::-1])) == {(k, 0) for k in range(1, 5001)} and stars([]) == []


def test_components_of_stars_take_no_round(spark, monkeypatch):
    names, written = [], common._written
    monkeypatch.setattr(common, "_written", lambda df, path: names.append(path) or written(df, path))
    edges = spark.createDataFrame([(k, k % 3) for k in range(3, 40)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {k: k % 3 for k in range(40)} and len(names) == 2
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components(path).collect()} == {(k, 0) for k in range(41)}


def test_wanted_sets_are_marked_by_one_job(spark):
    """Not by a job for each partition of the marks."""
    docs = spark.createDataFrame([(k, f"a b c d e f{k}") for k in range(200)], "doc_id long, text string")
    key, n = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = spark.conf.get(key), spark.conf.get(n)
    spark.conf.set(key, "false"), spark.conf.set(n, "9")
    spark.sparkContext.setJobGroup("marks", "marks")
    try:
        sets = jaccard_join._sets_of(docs, docs.where("doc_id % 4 = 0").select("doc_id"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("marks")
    finally:
        spark.conf.set(key, before[0]), spark.conf.set(n, before[1])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 3
    got = {r["doc_id"]: len(np.frombuffer(r["shingles"], "u8")) for r in sets.where(F.col("doc_id") % 4 == 0).collect()}
    assert got == {k: 2 for k in range(0, 200, 4)}


def test_written_batches_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    got = [r["n"] for r in common.stored(spark.range(0, 4000, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(got) == 4000 and max(got) <= 512


def test_workers_forget_pieces_after_packing(spark):
    def held(batches):
        for _ in batches:
            n = sum(len(e.pieces) for e in tokens._ENCODERS.values())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([len(tokens._ENCODERS)], pa.int64())], ["n", "made"])

    docs = spark.createDataFrame([(k, f"some words {k} of text") for k in range(400)], "doc_id long, text string")
    assert packing.cut_pieces(docs).count() == 400
    got = spark.range(0, 8, 1, 8).mapInArrow(held, "n long, made long").collect()
    assert sum(r["made"] for r in got) > 0 and sum(r["n"] for r in got) == 0


def test_plan_of_many_pieces_takes_no_more_memory():
    rng = random.Random(1)
    drawn = Counter(rng.randint(300, 1400) for _ in range(150))
    counts = {x: 50_000 * n for x, n in drawn.items()}
    tracemalloc.start()
    try:
        plan = packing.complete_bins(counts, steps=20_000)  # best-fit misses the bound: the search runs
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    used = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= packing.CAPACITY
        for x in lengths:
            used[x] += n
    fewest = sum(n for _, n in packing.best_fit(counts, packing.CAPACITY))
    assert packing.lower_bound(counts, packing.CAPACITY) < fewest and sum(n for _, n in plan) <= fewest
    assert used == counts and peak < 4e6
