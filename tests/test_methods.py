"""Whole methods against direct computation on small made panels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.operators import evaluate as ev
from lagloom.operators import graph as g
from lagloom.operators import jumps as jmp
from lagloom.operators import regimes as rg
from lagloom.plans import fusion, inverse, jump, network, regime


def _panel(spark, **series):
    rows = [(s, t, k, f"x{k}", float(v)) for s, x in series.items() for t, row in enumerate(x) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, "series_id string, t long, dim int, name string, value double")


def _driven(n=320, seed=1):
    """x0 drives x1 after two frames and, with a minus, x2 after one; x3 alone."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    for t in range(2, n):
        x[t, 1] += 0.9 * x[t - 2, 0]
        x[t, 2] -= 0.8 * x[t - 1, 0]
    return x


@pytest.fixture(scope="module")
def driven(spark):
    return _panel(spark, a=_driven()).persist()


def _steps(x, half):
    sd = np.array([[x[max(0, t - half) : t + half + 1, k].std() for k in range(x.shape[1])] for t in range(len(x))])
    return np.diff(x, axis=0) / (sd[1:] + 1e-10)


def _residual_corr(x, a, b, lag):
    n = len(x) - lag
    rest = [m for m in range(x.shape[1]) if m not in (a, b)]
    z = np.hstack([x[c : c + n][:, rest] for c in range(lag + 1)])
    left = [y - z @ np.linalg.lstsq(z, y, rcond=None)[0] for y in (x[:n, a], x[lag:, b])]
    return np.corrcoef(*left)[0, 1]


def _view(x, most):
    p = np.linalg.inv(np.cov(x.T) + 1e-8 * np.eye(x.shape[1]))
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            best, lag = 0.0, 0
            for k in range(1, most + 1):
                for a, b, sign in ((i, j, 1), (j, i, -1)):
                    r = _residual_corr(x, a, b, k)
                    if abs(r) > abs(best):
                        best, lag = r, sign * k
            out[i, j] = (-p[i, j] / np.sqrt(p[i, i] * p[j, j]), best, lag)
    return out


def test_network_pairs_equal_direct_computation(driven):
    x = _driven()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    views = _view(_steps(x, 10), 3), _view(z, 3)
    net = network.analyze(driven, network.NetworkConfig(max_lag=3, adaptive=False))
    rows = net.pairs.collect()
    assert len(rows) == 6
    for r in rows:
        sync, causal, lag = views[r["from_raw"]][r["i"], r["j"]]
        assert (r["sync"], r["causal"], r["lag"]) == (pytest.approx(sync, abs=1e-6), pytest.approx(causal, abs=1e-6), lag)
    links = {(r["src"], r["dst"]): r for r in net.links.where("link_type = 'causal'").collect()}
    assert links[0, 1]["lag"] == 2 and links[0, 1]["sign"] == 1 and links[0, 2]["lag"] == 1 and links[0, 2]["sign"] == -1
    lines = g.summary(net.links, net.hubs, net.roles).where("section = 'causal'").orderBy("place").collect()
    assert [r["place"] for r in lines] == list(range(1, len(links) + 1)) and " -> " in lines[0]["line"]


def test_network_of_two_dimensions_and_several_series(spark):
    x = _driven(200, 4)
    panel = _panel(spark, a=x[:, :2], b=x[::-1, :2].copy())
    pairs = network.analyze(panel, network.NetworkConfig(max_lag=3, adaptive=False)).pairs.collect()
    assert sorted(r["series_id"] for r in pairs) == ["a", "b"]
    lags = {r["series_id"]: r["lag"] for r in pairs}
    assert lags == {"a": 2, "b": -2}


def test_inverse_ridge_equals_direct_fit(driven):
    x = _driven()
    c = inverse.InverseConfig(solver="ridge", max_lag=3, min_train_size=40)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    deep, n = 3, len(x) - 3
    split = int(np.clip(round(n * 0.75), 40, n - 5))
    fits = {(r["src"], r["dst"]): r for r in inverse.inverse_edges(driven, c).collect()}
    for target in range(4):
        y = z[deep:, target] - z[deep:, target].mean()
        lag = lambda m, k: z[deep - k : len(z) - k, m]
        own = np.stack([lag(target, 1)], axis=1)
        sources = [m for m in range(4) if m != target]
        rest = np.stack([lag(m, k) for m in sources for k in range(1, 4)], axis=1)
        w_own = np.linalg.lstsq(own[:split], y[:split], rcond=None)[0]
        scale = np.sqrt(np.log(rest.shape[1]) / split) / 0.1
        m = rest[:split].T @ rest[:split] + 1e-2 * scale * np.eye(9)
        for s in range(0, 9, 3):
            for i in (s, s + 1):
                m[[i, i + 1], [i, i + 1]] += 1e-2 * scale
                m[[i, i + 1], [i + 1, i]] -= 1e-2 * scale
        w = np.linalg.solve(m, rest[:split].T @ (y[:split] - own[:split] @ w_own))
        err = y[split:] - own[split:] @ w_own - rest[split:] @ w
        for k, source in enumerate(sources):
            r = fits[source, target]
            assert np.allclose(r["kernel"], w[3 * k : 3 * k + 3], atol=1e-7)
            assert r["baseline_mse"] == pytest.approx((err**2).mean(), abs=1e-7)
    assert fits[0, 1]["lag"] == 2 and fits[0, 1]["sign"] == 1 and fits[0, 2]["lag"] == 1 and fits[0, 2]["sign"] == -1


def test_inverse_of_short_series(spark):
    with pytest.raises(ValueError, match="too few frames"):
        inverse.inverse_edges(_panel(spark, a=_driven(30)))
    both = _panel(spark, a=_driven(120), b=_driven(30))
    status = {r["series_id"]: (r["n_frames"], r["status"]) for r in inverse.fit_status(both).collect()}
    assert status == {"a": (120, "fitted"), "b": (30, "too_short")}
    rows = inverse.inverse_edges(both, inverse.InverseConfig(solver="ridge", max_lag=2, backward_check=False)).collect()
    assert {r["series_id"] for r in rows} == {"a"} and len(rows) == 12


def test_jump_edges_equal_direct_computation(driven):
    x = _driven()
    d = _steps(x, 20)
    fired = np.where(np.abs(d) > np.percentile(np.abs(d), 90, axis=0), np.sign(d), 0)
    rows = {(r["src"], r["dst"]): r for r in jump.jump_edges(driven, jump.JumpConfig(max_lag=3, adaptive=False))[0].collect()}
    assert len(rows) == 12
    for (a, b), r in rows.items():
        best = (0.0, 0, 0, 0.5)
        for k in range(1, 4):
            mean = np.mean(d[k:, b] * np.sign(d[:-k, a]))
            at = np.flatnonzero(fired[:, a])
            at = at[at + k < len(d)]
            share = np.mean(d[at + k, b] * fired[at, a] > 0)
            c = max(share, 1 - share)
            score = abs(mean) * (1 + 2 * (c - 0.5))
            if score > best[0]:
                best = (score, k, 1 if mean > 0 else -1, c)
        assert (r["raw_score"], r["lag"], r["sign"], r["consistency"]) == (pytest.approx(best[0]), best[1], best[2], pytest.approx(best[3]))


def test_a_response_of_zero_has_no_sign(spark):
    stats = spark.createDataFrame([("a", 0, 1, 1, 0.0, 0.4)], "series_id string, src int, dst int, lag int, mean double, p double")
    none = spark.createDataFrame([], "series_id string, src int, dst int, lag int, consistency double")
    r = jmp.best_response(stats, none).first()
    assert (r["score"], r["lag"], r["sign"], r["consistency"], r["p"]) == (0.0, 0, 0, 0.5, 1.0)


def _two_regimes(n=240):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3))
    x[n // 2 :] = 6 * x[n // 2 :] + 20
    return x


def test_regime_features_and_labels(spark):
    x = _two_regimes()
    panel = _panel(spark, long=x, short=x[:60], tiny=x[:30])
    got = {(r["series_id"], r["t"]): r["features"] for r in rg.frame_features(panel).collect()}
    step = np.diff(x, axis=0, prepend=x[:1])
    low = []
    for t in range(len(x)):
        block = x[max(0, t - 59) : t + 1]
        power = np.abs(np.fft.rfft(block, axis=0))
        low.append(power[: max(1, len(power) // 4)].sum() / (power.sum() + 1e-12) if len(block) >= 8 else 0.0)
    mine = np.array([got["long", t] for t in range(len(x))])
    z = lambda f: (f - f.mean()) / f.std()
    for f in (np.abs(x).mean(axis=1), x.std(axis=1), np.abs(step).mean(axis=1), (x**2).mean(axis=1), np.array(low)):
        assert any(np.allclose(z(f), mine[:, k], atol=1e-6) for k in range(20))
    assert mine.shape == (240, 20)
    labels, segments = regime.detect(panel, regime.RegimeConfig(n_regimes=2))
    by = {}
    for r in labels.collect():
        by.setdefault(r["series_id"], {})[r["t"]] = r["label"]
    long = [by["long"][t] for t in range(240)]
    assert len(set(long[:110])) == 1 and len(set(long[130:])) == 1 and long[0] != long[-1]
    assert set(by["short"].values()) == {0} and set(by["tiny"].values()) == {0}
    assert {r["series_id"] for r in segments.collect()} == {"long", "short"}


def test_regime_networks_and_rescue(spark):
    x = _driven(240, 3)
    x[120:] = 5 * x[120:]
    panel = _panel(spark, a=x)
    found = regime.analyze_regimes(panel, regime.RegimeConfig(n_regimes=2), network.NetworkConfig(max_lag=2, adaptive=False))
    assert found.segments.count() >= 1
    assert found.edge_frequency.where("src = 0 AND dst = 1 AND link_type = 'causal' AND frequency > 0").count() == 1
    edges = fusion.jump_inverse_method(panel, 3, regimes=found.segments)
    assert edges.count() == 12


@pytest.mark.parametrize("method", ["network", "inverse", "jump", "fusion", "triple"])
def test_methods_find_the_structure(spark, driven, method):
    run = {
        "network": lambda p: fusion.network_method(p), "inverse": lambda p: fusion.inverse_method(p, 3, "ridge"), "jump": lambda p: fusion.jump_method(p),
        "fusion": lambda p: fusion.fusion_method(p, 3, "ridge"), "triple": lambda p: fusion.triple_fusion_method(p, 3, "ridge"),
    }[method]
    rows = {(r["src"], r["dst"]): r for r in run(driven).collect()}
    assert len(rows) == 12
    top = sorted(rows, key=lambda e: -rows[e]["score"])[:4]
    assert (0, 1) in top and (0, 2) in top
    assert rows[0, 1]["lag"] == 2 and rows[0, 2]["lag"] == 1 and rows[0, 1]["sign"] == 1 and rows[0, 2]["sign"] == -1


def test_boundary_f1(spark):
    schema = "series_id string, t long"
    truth = spark.createDataFrame([("a", 10), ("a", 50), ("b", 5)], schema)
    found = spark.createDataFrame([("a", 12), ("a", 14), ("a", 80), ("c", 1)], schema)
    got = {r["series_id"]: r["boundary_f1"] for r in ev.boundary_f1(found, truth).collect()}
    assert got == {"a": pytest.approx(2 / 5), "b": 0.0, "c": 0.0}
    assert ev.boundary_f1(truth, truth).agg(F.min("boundary_f1")).first()[0] == 1.0
