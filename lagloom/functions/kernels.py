"""Small dense linear algebra on moments: what SQL has no words for.

Every function works on one series' moments, a matrix whose size depends on
dimensions and lags only, never on the number of frames.
"""

from __future__ import annotations

import numpy as np


def precision_pcorr(cov: np.ndarray) -> np.ndarray:
    """Partial correlations of all pairs given the rest."""
    a = cov + 1e-8 * np.eye(len(cov))
    try:
        p = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        p = np.linalg.pinv(a)
    d = np.sqrt(np.maximum(np.diag(p), 1e-10))
    r = np.clip(-p / np.outer(d, d), -1, 1)
    np.fill_diagonal(r, 1.0)
    return r


def residual_corr(g: np.ndarray, s: np.ndarray, n: float, a: int, b: int, z: list[int], keep: float = 0.95) -> float:
    """Correlation of two columns after least squares on the columns z without
    intercept, from the moments g = V'V and sums s over n rows. With more than
    n // 2 columns, z is first reduced to the directions that hold ``keep``."""
    mean, var = s / n, np.diag(g) / n - (s / n) ** 2
    sd = np.sqrt(np.maximum(var, 0))
    if sd[a] < 1e-10 or sd[b] < 1e-10:
        return 0.0
    z = [k for k in z if sd[k] > 1e-10]

    def corr(gaa, gbb, gab, ma, mb):
        va, vb = gaa / n - ma * ma, gbb / n - mb * mb
        if va < 1e-20 or vb < 1e-20:
            return 0.0
        r = (gab / n - ma * mb) / np.sqrt(va * vb)
        return float(np.clip(r, -1, 1)) if np.isfinite(r) else 0.0

    if not z:
        return corr(g[a, a], g[b, b], g[a, b], mean[a], mean[b])
    zz, za, zb, sz = g[np.ix_(z, z)], g[z, a], g[z, b], s[z]
    if len(z) > n // 2:
        w, v = np.linalg.eigh(zz)
        w, v = np.maximum(w[::-1], 0), v[:, ::-1]
        share = np.cumsum(w) / max(w.sum(), 1e-300)
        k = max(1, int(np.searchsorted(share, keep)) + 1)
        v = v[:, :k]
        zz, za, zb, sz = v.T @ zz @ v, v.T @ za, v.T @ zb, v.T @ sz
    inv = np.linalg.pinv(zz, hermitian=True)
    wa, wb = inv @ za, inv @ zb
    gaa, gbb = g[a, a] - za @ wa, g[b, b] - zb @ wb
    gab = g[a, b] - za @ wb
    return corr(gaa, gbb, gab, mean[a] - sz @ wa / n, mean[b] - sz @ wb / n)


#: From this condition on, of scaled columns, pairs are solved one by one.
ILL = 1e9


def lagged_partials(g: np.ndarray, d: int, k: int) -> np.ndarray:
    """r[a, b]: correlation of column a at offset 0 and b at offset k given all
    other dimensions at offsets 0 to k, for every ordered pair at once.

    g: moments of the columns (offset, dimension) in order, and of a last column
    of ones. The matrix of all columns is inverted once. The rows and columns of
    its inverse that belong to a pair's dimensions (and to the ones), inverted
    again, are the moments of what all others leave of them. Where the columns
    are dependent, or more than half the rows, ``residual_corr`` solves each
    pair by itself.
    """
    r, n, one = np.zeros((d, d)), g[-1, -1], d * (k + 1)
    use = [*range(one), len(g) - 1]
    g = g[np.ix_(use, use)]
    varies = np.sqrt(np.maximum(np.diag(g) / n - (g[-1] / n) ** 2, 0)) > 1e-10
    kept = np.flatnonzero(np.append(varies[:-1], True))
    own = [[m for m in range(len(kept) - 1) if kept[m] % d == x] for x in range(d)]  # places in the kept columns
    inverse = None
    if d >= 3 and len(kept) - 1 <= n // 2:
        scale = 1 / np.sqrt(np.diag(g)[kept])
        a = g[np.ix_(kept, kept)] * np.outer(scale, scale)
        try:
            inverse = np.linalg.inv(a)
            if np.abs(a).sum(axis=0).max() * np.abs(inverse).sum(axis=0).max() > ILL:
                inverse = None
        except np.linalg.LinAlgError:
            pass
    for a in range(d):
        for b in range(a + 1, d):
            if inverse is None:
                z = [c * d + m for c in range(k + 1) for m in range(d) if m not in (a, b)] if d >= 3 else []
                for x, y in ((a, b), (b, a)):
                    r[x, y] = residual_corr(g, g[-1], n, x, k * d + y, z)
                continue
            s = [*own[a], *own[b], len(kept) - 1]
            at = {int(kept[m]): i for i, m in enumerate(s)}
            left = np.linalg.inv(inverse[np.ix_(s, s)]) / np.outer(scale[s], scale[s]) / n
            for x, y in ((a, k * d + b), (b, k * d + a)):
                if x in at and y in at:
                    i, j, mean = at[x], at[y], left[-1]
                    v = (left[i, i] - mean[i] ** 2, left[j, j] - mean[j] ** 2)
                    if min(v) > 1e-20:
                        r[x, y % d] = np.clip((left[i, j] - mean[i] * mean[j]) / np.sqrt(v[0] * v[1]), -1, 1)
    return r


def ridge(xx: np.ndarray, xy: np.ndarray, alpha: float, smooth: float, blocks: list[list[int]]) -> np.ndarray:
    """Ridge with neighbouring lags of a block drawn together."""
    m = xx + alpha * np.eye(len(xx))
    if smooth > 0:
        for block in blocks:
            for i, j in zip(block, block[1:], strict=False):
                m[i, i] += smooth
                m[j, j] += smooth
                m[i, j] -= smooth
                m[j, i] -= smooth
    try:
        return np.linalg.solve(m, xy)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(m) @ xy


def _descent(q: np.ndarray, c: np.ndarray, yy: float, n: float, alpha: float, w: np.ndarray, most: int, tol: float) -> np.ndarray:
    """Coordinate descent for |y - Xw|^2 / 2n + alpha |w|_1 from centred moments."""
    w = w.copy()
    d = np.diag(q)
    grad = c - q @ w
    for _ in range(most):
        largest = step = 0.0
        for j in np.flatnonzero(d > 0):
            old = w[j]
            raw = grad[j] + d[j] * old
            new = np.sign(raw) * max(abs(raw) - alpha * n, 0) / d[j]
            if new != old:
                grad -= q[:, j] * (new - old)
                w[j] = new
            step = max(step, abs(new - old))
            largest = max(largest, abs(new))
        if largest == 0 or step / largest < tol:
            fit = yy - 2 * c @ w + w @ q @ w
            dual = np.max(np.abs(grad), initial=0.0)
            scale = min(1.0, alpha * n / dual) if dual > 0 else 1.0
            gap = 0.5 * fit * (1 + scale * scale) + alpha * n * np.abs(w).sum() - scale * (yy - c @ w)
            if gap <= tol * max(yy, 1e-300):
                break
    return w


def _centred(m: dict) -> tuple[np.ndarray, np.ndarray, float, float]:
    n = max(m["n"], 1.0)
    q = m["xx"] - np.outer(m["x"], m["x"]) / n
    c = m["xy"] - m["x"] * m["y"] / n
    return q, c, float(m["yy"] - m["y"] ** 2 / n), n


def _sum(parts: list[dict]) -> dict:
    return {k: sum(p[k] for p in parts) for k in parts[0]}


def lasso_cv(folds: list[dict], most: int = 5000, tol: float = 1e-4, grid: int = 100, span: float = 1e-3) -> np.ndarray:
    """Lasso weights, the penalty chosen by cross-validation over folds of rows.

    folds: moments xx, xy, x, y, yy, n of each contiguous fold. The penalties
    are a log grid shared by all folds; the least mean error wins.
    """
    whole = _sum(folds)
    q, c, yy, n = _centred(whole)
    top = float(np.max(np.abs(c), initial=0.0)) / n
    if top <= 0 or len(folds) < 2:
        return np.zeros(len(c))
    alphas = np.geomspace(top, top * span, grid)
    errors = np.zeros(grid)
    for k, out in enumerate(folds):
        rest = _sum([f for i, f in enumerate(folds) if i != k])
        fq, fc, fyy, fn = _centred(rest)
        w = np.zeros(len(fc))
        for a, alpha in enumerate(alphas):
            w = _descent(fq, fc, fyy, fn, alpha, w, most, tol)
            b = (rest["y"] - rest["x"] @ w) / fn
            err = out["yy"] - 2 * (out["xy"] @ w) - 2 * b * out["y"] + w @ out["xx"] @ w + 2 * b * (out["x"] @ w) + b * b * out["n"]
            errors[a] += err / max(out["n"], 1.0)
    w = np.zeros(len(c))
    for alpha in alphas[: int(np.argmin(errors)) + 1]:
        w = _descent(q, c, yy, n, alpha, w, most, tol)
    return w
