"""Conditional p of jump edges against the reference's rule, spelled out."""

from math import gamma, pi, sqrt

import numpy as np
import pytest

from lagloom.plans import jump


def _two_sided(t, v):
    x = np.linspace(0, abs(t), 200_001)
    density = gamma((v + 1) / 2) / gamma(v / 2) / sqrt(v * pi) * (1 + x**2 / v) ** (-(v + 1) / 2)
    return 1 - 2 * float(np.trapezoid(density, x))


def _expected(disp, event, edges, least):
    kept = {k: v for k, v in edges.items() if v["score"] > 0 and not v["filtered"]}
    out = {k: v["p"] for k, v in edges.items()}
    for (a, b), e in kept.items():
        mediators = [(m, v["lag"]) for (x, m), v in kept.items() if x == a and m != b and v["score"] > e["score"]]
        if not mediators:
            continue
        frames = [t for t in np.flatnonzero(event[:, a]) if not any(0 <= t + lag + k < len(event) and event[t + lag + k, m] for m, lag in mediators for k in (-1, 0, 1))]
        y = np.array([disp[t + e["lag"], b] * event[t, a] for t in frames if t + e["lag"] < len(disp)])
        out[a, b] = 1.0 if len(y) < least else _two_sided(y.mean() / (y.std(ddof=1) / np.sqrt(len(y))), len(y) - 1)
    return out


def test_only_stronger_mediators_exclude_jumps(spark):
    rng = np.random.default_rng(3)
    disp = rng.normal(size=(160, 4))
    event = np.where(np.abs(disp) > np.percentile(np.abs(disp), 85, axis=0), np.sign(disp), 0).astype(int)
    event[:60, 3] = 1  # explains most jumps of the sources that it mediates
    edges = {
        (a, b): {"score": float(rng.random()), "lag": int(rng.integers(1, 4)), "p": float(rng.random()), "filtered": (a, b) in ((1, 2), (3, 0))}
        for a in range(4) for b in range(4) if a != b
    }
    edges[2, 0] |= {"score": 0.0, "lag": 0, "p": 1.0}
    rows = spark.createDataFrame([("s", a, b, *v.values()) for (a, b), v in edges.items()], "series_id string, src int, dst int, score double, lag int, p double, filtered boolean")
    events = spark.createDataFrame(
        [("s", t, d, float(disp[t, d]), int(event[t, d])) for t in range(160) for d in range(4)], "series_id string, t int, dim int, disp double, event int"
    )
    found = {(r["src"], r["dst"]): r["p"] for r in jump.with_conditional_p(rows, events, 5).collect()}
    want = _expected(disp, event, edges, 5)
    assert found == pytest.approx(want, abs=1e-6)
    for k in ((1, 2), (3, 0), *(max(((a, b) for a, b in edges if a == s and not edges[a, b]["filtered"]), key=lambda k: edges[k]["score"]) for s in range(4))):
        assert found[k] == edges[k]["p"]
    assert sum(found[k] != edges[k]["p"] for k in edges) >= 4
