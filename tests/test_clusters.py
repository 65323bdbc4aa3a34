"""Seeded k-means with restarts against the plain rule in NumPy."""

import numpy as np
import pytest

from lagloom.operators import regimes as rg


def _plain(x, k, starts=8, rounds=100):
    """Least inertia over random starts; empty clusters get a random frame."""
    rng, best = np.random.default_rng(42), np.inf
    for _ in range(starts):
        c = x[rng.choice(len(x), size=k, replace=False)].copy()
        for _ in range(rounds):
            label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([x[label == j].mean(0) if (label == j).any() else x[rng.integers(0, len(x))] for j in range(k)])
            done = np.linalg.norm(new - c) < 1e-8
            c = new
            if done:
                break
        best = min(best, ((x[:, None] - c) ** 2).sum(2).min(1).sum())
    return best


def _inertia(x, label):
    return sum(((x[label == j] - x[label == j].mean(0)) ** 2).sum() for j in np.unique(label))


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(9)
    apart = np.concatenate([rng.normal(m, 0.4, size=(60, 4)) for m in (0, 3, 6)])
    close = np.concatenate([rng.normal(m, 1.0, size=(70, 4)) for m in (0, 1.2, 2.4)])
    uneven = np.concatenate([rng.normal(0, 1, size=(150, 4)), rng.normal(5, 0.2, size=(12, 4)), rng.normal(-4, 0.5, size=(20, 4))])
    return {"apart": apart, "close": close, "uneven": uneven, "tiny": rng.normal(size=(8, 4)), "same": np.ones((30, 4))}


def test_inertia_is_that_of_the_plain_rule(spark, made):
    rows = [(s, t, [float(v) for v in x]) for s, xs in made.items() for t, x in enumerate(xs)]
    frames = spark.createDataFrame(rows, "series_id string, t long, features array<double>").repartition(3)
    found = {}
    for r in rg.clusters(frames, 3).collect():
        found.setdefault(r["series_id"], {})[r["t"]] = r["label"]
    for s in ("apart", "close", "uneven"):
        label = np.array([found[s][t] for t in range(len(made[s]))])
        assert set(label) == {0, 1, 2} and _inertia(made[s], label) <= 1.01 * _plain(made[s], 3)
    assert set(found["tiny"].values()) == {0} and len(found["same"]) == 30
    again = rg.clusters(frames.where("series_id = 'apart'").repartition(5), 3).collect()
    assert {r["t"]: r["label"] for r in again} == found["apart"]


def test_no_frames(spark):
    assert rg.clusters(spark.createDataFrame([], "series_id string, t long, features array<double>")).collect() == []
