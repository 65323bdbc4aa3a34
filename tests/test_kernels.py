import math
import time

import numpy as np
from pyspark.sql import functions as F

from lagloom.functions.kernels import lagged_partials, lasso_cv, precision_pcorr, residual_corr, ridge
from lagloom.functions import tails


def _student(t, df):
    """By the finite series for whole degrees of freedom."""
    angle = math.atan2(abs(t), math.sqrt(df))
    c, s = math.cos(angle) ** 2, 1.0
    if df % 2:
        for j in range((df - 3) // 2, 0, -1):
            s = 1 + s * c * 2 * j / (2 * j + 1)
        return 1 - 2 / math.pi * (angle + (math.sin(angle) * math.cos(angle) * s if df > 1 else 0))
    for j in range((df - 2) // 2, 0, -1):
        s = 1 + s * c * (2 * j - 1) / (2 * j)
    return 1 - math.sin(angle) * s


def test_normal_tail(spark):
    zs = [0.0, 1e-9, 0.3, 1.0, 1.4999, 1.5, 2.0, 2.2, 5.0, 12.0, 30.0, -1.96, None]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", tails.normal_p(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r["p"] is None if r["z"] is None else math.isclose(r["p"], math.erfc(abs(r["z"]) / math.sqrt(2)), rel_tol=1e-12)


def test_student_tail(spark):
    cases = [(t, df) for df in (1, 2, 3, 10, 31, 300, 717) for t in (0.0, 1e-6, 0.4, 1.0, 1.74, 2.0, 3.5, -5.0)]
    rows = spark.createDataFrame(cases + [(None, 3), (2.0, None)], "t double, df int").select("t", "df", tails.student_p(F.col("t"), F.col("df")).alias("p")).collect()
    for r in rows:
        if r["t"] is None or r["df"] is None:
            assert r["p"] is None
        else:
            assert math.isclose(r["p"], _student(r["t"], r["df"]), rel_tol=1e-10, abs_tol=1e-14)
    far = spark.createDataFrame([(1.96, 1e7), (40.0, 30.0), (float("inf"), 5.0), (3.0, 1e8)], "t double, df double").select(tails.student_p(F.col("t"), F.col("df"))).collect()
    assert math.isclose(far[0][0], math.erfc(1.96 / math.sqrt(2)), rel_tol=1e-5) and 0 < far[1][0] < 1e-25 and far[2][0] == 0.0
    assert math.isclose(far[3][0], math.erfc(3 / math.sqrt(2)), rel_tol=1e-6)


def test_coin_tail(spark):
    cases = [(k, n) for n in (1, 2, 10, 57, 400, 1000) for k in {0, 1, n // 3, n // 2, n // 2 + 1, n - 1, n, n + 1}]
    rows = spark.createDataFrame(cases, "k int, n int").select("k", "n", tails.coin_p(F.col("k"), F.col("n")).alias("p")).collect()
    for r in rows:
        wanted = sum(math.comb(r["n"], i) for i in range(r["k"], r["n"] + 1)) / 2 ** r["n"]
        assert math.isclose(r["p"], wanted, rel_tol=1e-10), r


def test_residual_corr_equals_direct_regression():
    rng = np.random.default_rng(1)
    v = np.column_stack([rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)), np.ones(300)])
    z = [2, 3, 4, 5]
    ra, rb = (v[:, k] - v[:, z] @ np.linalg.pinv(v[:, z]) @ v[:, k] for k in (0, 1))
    g = v.T @ v
    assert abs(residual_corr(g, g[-1], 300, 0, 1, z) - np.corrcoef(ra, rb)[0, 1]) < 1e-10


def _embedded(x, k):
    n = len(x) - k
    return np.hstack([*(x[c : c + n] for c in range(k + 1)), np.ones((n, 1))])


def test_all_lagged_partials_equal_each_pair_by_itself():
    rng = np.random.default_rng(6)
    plain = np.cumsum(rng.normal(size=(500, 5)), axis=0) * 0.1 + rng.normal(size=(500, 5)) + 3
    constant, copied = plain.copy(), plain.copy()
    constant[:, 2] = 4.0
    copied[:, 3] = 2 * copied[:, 1]
    for x, k in ((plain, 1), (plain, 6), (constant, 2), (copied, 2), (plain[:60], 8), (plain[:, :2], 3)):
        v, d = _embedded(x, k), x.shape[1]
        g, r = v.T @ v, lagged_partials(v.T @ v, d, k)
        for a in range(d):
            for b in range(d):
                if a != b:
                    z = [c * d + m for c in range(k + 1) for m in range(d) if m not in (a, b)] if d >= 3 else []
                    assert abs(r[a, b] - residual_corr(g, g[-1], len(v), a, k * d + b, z)) < 1e-8
    z = [c * 5 + m for c in range(3) for m in (2, 3, 4)]
    v = _embedded(plain, 2)
    ra, rb = (v[:, y] - v[:, z] @ np.linalg.lstsq(v[:, z], v[:, y], rcond=None)[0] for y in (0, 11))
    assert abs(lagged_partials(v.T @ v, 5, 2)[0, 1] - np.corrcoef(ra, rb)[0, 1]) < 1e-9


def test_lagged_partials_of_sixty_dimensions():
    began = time.perf_counter()
    x = np.random.default_rng(7).normal(size=(3000, 60))
    x[12:, 1] += 0.8 * x[:-12, 0]
    v = _embedded(x, 12)
    r = lagged_partials(v.T @ v, 60, 12)
    assert r[0, 1] > 0.5 and np.abs(np.delete(r, 1)).max() < 0.2
    z = [c * 60 + m for c in range(13) for m in range(2, 60)]
    g = v.T @ v
    assert abs(r[0, 1] - residual_corr(g, g[-1], len(v), 0, 12 * 60 + 1, z)) < 1e-8
    assert time.perf_counter() - began < 30


def test_reduced_conditioning_columns():
    """More columns than half the rows: the directions that hold 95 %."""
    rng = np.random.default_rng(8)
    v = np.column_stack([rng.normal(size=(30, 22)) * np.linspace(3, 0.1, 22), np.ones(30)])
    z = list(range(2, 22))
    w, e = np.linalg.svd(v[:, z], full_matrices=False)[1:]
    k = int(np.searchsorted(np.cumsum(w**2) / (w**2).sum(), 0.95)) + 1
    c = v[:, z] @ e[:k].T
    ra, rb = (v[:, y] - c @ np.linalg.lstsq(c, v[:, y], rcond=None)[0] for y in (0, 1))
    g = v.T @ v
    assert abs(residual_corr(g, g[-1], 30, 0, 1, z) - np.corrcoef(ra, rb)[0, 1]) < 1e-9


def test_precision_pcorr_of_three():
    x = np.random.default_rng(2).normal(size=(500, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.5], [0, 0, 1]])
    r = np.corrcoef(x.T)
    want = (r[0, 1] - r[0, 2] * r[1, 2]) / math.sqrt((1 - r[0, 2] ** 2) * (1 - r[1, 2] ** 2))
    assert abs(precision_pcorr(np.cov(x.T))[0, 1] - want) < 1e-6


def test_ridge_and_lasso_find_the_support():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    y = 1.5 * x[:, 2] - x[:, 5] + 0.1 * rng.normal(size=400)
    folds = []
    for part in np.array_split(np.arange(400), 5):
        a, b = x[part], y[part]
        folds.append({"n": float(len(part)), "x": a.sum(0), "xx": a.T @ a, "xy": a.T @ b, "y": b.sum(), "yy": b @ b})
    w = lasso_cv(folds)
    assert abs(w[2] - 1.5) < 0.05 and abs(w[5] + 1) < 0.05 and np.abs(np.delete(w, [2, 5])).max() < 0.05
    assert np.allclose(ridge(x.T @ x, x.T @ y, 1e-6, 0.0, []), np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-4)


def _lasso(x, y, alpha, w):
    """Weights for |y - Xw|^2 / 2n + alpha |w|_1 of centred rows, one at a time."""
    x, y, w, n = x - x.mean(0), y - y.mean(), w.copy(), len(y)
    d = (x * x).sum(0)
    for _ in range(3000):
        before = w.copy()
        for j in range(len(w)):
            rest = x[:, j] @ (y - x @ w) + d[j] * w[j]
            w[j] = np.sign(rest) * max(abs(rest) - alpha * n, 0) / d[j]
        if np.abs(w - before).max() < 1e-10:
            break
    return w


def test_lasso_equals_the_path_over_the_rows():
    """The penalty and the weights from the rows themselves, fold by fold."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 6)) @ (np.eye(6) + 0.3 * rng.normal(size=(6, 6))) + 1.0
    y = 0.8 * x[:, 1] - 0.4 * x[:, 4] + 0.8 * rng.normal(size=120) + 2.0
    parts = np.array_split(np.arange(120), 5)
    folds = [{"n": float(len(p)), "x": x[p].sum(0), "xx": x[p].T @ x[p], "xy": x[p].T @ y[p], "y": y[p].sum(), "yy": y[p] @ y[p]} for p in parts]
    top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / 120
    alphas, errors = np.geomspace(top, top * 1e-3, 30), np.zeros(30)
    for out in parts:
        rest, w = np.setdiff1d(np.arange(120), out), np.zeros(6)
        for k, alpha in enumerate(alphas):
            w = _lasso(x[rest], y[rest], alpha, w)
            b = y[rest].mean() - x[rest].mean(0) @ w
            errors[k] += ((y[out] - b - x[out] @ w) ** 2).mean()
    w = np.zeros(6)
    for alpha in alphas[: int(errors.argmin()) + 1]:
        w = _lasso(x, y, alpha, w)
    assert 0 < errors.argmin() < 29
    assert np.allclose(lasso_cv(folds, tol=1e-9, grid=30), w, atol=1e-6)
    assert np.allclose(lasso_cv(folds, grid=30), w, atol=5e-3)
