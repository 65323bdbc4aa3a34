"""Inverse problem: which lagged sources each target cannot be predicted without.

All targets share one lagged embedding, so one set of moments for each
direction of time and block of rows (five folds and the validation rows) holds
every fit, drop and error. Fits run for each (series, target) on those moments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signals as sig
from ..operators import graph as g
from ..operators import scores as sc
from ..operators.lagged import pair_corr
from ..operators.moments import embedded, gram, symmetric
from ..sources import panel as pn
from ..sources.written import written

EDGE = ["series_id", "src", "dst"]


@dataclass(frozen=True)
class InverseConfig:
    max_lag: int = 5
    ar_lag: int = 1
    solver: str = "lasso"  # lasso, ridge or auto
    alpha_ridge: float = 1e-2
    alpha_smooth: float = 1e-2
    adaptive_regularization: bool = True
    folds: int = 5
    lasso_max_iter: int = 5000
    validation_fraction: float = 0.25
    min_train_size: int = 40
    asymmetry_weight: float = 0.25
    backward_check: bool = True
    residualize_ar: bool = True
    refit_on_drop: bool = False
    standardize: bool = True
    score_mode: str = "mixed"  # block_norm, delta_mse, anomaly or mixed
    min_effect: float = 1e-6
    prune: bool = False
    prune_quantile: float = 0.5
    textbook: bool = True
    lag_tolerance: int = 1
    direct: bool = True


_FIT = (
    "series_id string, src int, dst int, block_norm double, lag int, sign int, kernel array<double>, baseline_mse double, null_mse double, "
    "self_mse double, pair_mse double, delta_mse double, delta_mse_backward double, asymmetry double, confidence double"
)


def _moments(panel: DataFrame, c: InverseConfig, direction: str) -> DataFrame:
    """g for each series and block: folds of the training rows, then validation."""
    deep = max(c.max_lag, c.ar_lag)
    rows = embedded(panel, deep).join(pn.shape(panel), "series_id")
    n = F.col("n_frames") - deep
    split = sig.clipped(F.bround(n * (1 - c.validation_fraction)), c.min_train_size, n - 5).cast("long")
    rows = rows.withColumn("split", split)
    block = F.expr(
        f"CASE WHEN t >= split THEN {c.folds} WHEN t < (split % {c.folds}) * (split div {c.folds} + 1) THEN t div (split div {c.folds} + 1) "
        f"ELSE split % {c.folds} + (t - (split % {c.folds}) * (split div {c.folds} + 1)) div (split div {c.folds}) END"
    )
    return gram(rows.select("series_id", block.cast("int").alias("block"), "v"), "series_id", "block").withColumn("direction", F.lit(direction))


def target_fits(panel: DataFrame, c: InverseConfig, solver: DataFrame) -> DataFrame:
    """One row for each source and target. solver: (series_id, solver)."""
    scaled = written(sig.zscore_unit(panel, "value") if c.standardize else panel, "scaled")
    moments = _moments(scaled, c, "f")
    if c.backward_check:
        moments = moments.unionByName(_moments(pn.reversed_time(scaled), c, "b"))
    targets = panel.select("series_id", F.col("dim").alias("dst")).distinct()
    rows = moments.join(targets, "series_id").join(pn.shape(panel), "series_id").join(solver, "series_id")

    def fit(pdf):
        import numpy as np
        import pandas as pd

        from ..functions.kernels import lasso_cv, ridge

        d, target, deep = int(pdf["n_dims"].iloc[0]), int(pdf["dst"].iloc[0]), max(c.max_lag, c.ar_lag)
        how = pdf["solver"].iloc[0]
        own = [(deep - k) * d + target for k in range(1, c.ar_lag + 1)]
        sources = {s: [(deep - k) * d + s for k in range(1, c.max_lag + 1)] for s in range(d) if s != target}
        columns = own + [k for cols in sources.values() for k in cols]
        at = {k: i for i, k in enumerate(columns)}
        y, one = deep * d + target, (deep + 1) * d

        def parts(direction):
            part = pdf[pdf["direction"] == direction]
            gs = {int(b): symmetric(x) for b, x in zip(part["block"], part["g"], strict=True)}
            whole = sum(gs.values())
            shift = whole[one, y] / whole[one, one]  # the target is centred over all rows

            def moment(m):
                n, x = m[one, one], m[one, columns]
                return {
                    "n": n, "x": x, "xx": m[np.ix_(columns, columns)], "xy": m[columns, y] - shift * x,
                    "y": m[one, y] - shift * n, "yy": m[y, y] - 2 * shift * m[one, y] + shift * shift * n,
                }

            return [moment(gs[b]) for b in sorted(gs) if b < c.folds], moment(gs[c.folds])

        def only(m, cols):
            return m | {"x": m["x"][cols], "xx": m["xx"][np.ix_(cols, cols)], "xy": m["xy"][cols]}

        def added(ms):
            return {k: sum(m[k] for m in ms) for k in ms[0]}

        def without(ms, cols, w):
            """The moments of y - X[cols] w."""
            return [
                m | {
                    "xy": m["xy"] - m["xx"][:, cols] @ w, "y": m["y"] - m["x"][cols] @ w,
                    "yy": m["yy"] - 2 * m["xy"][cols] @ w + w @ m["xx"][np.ix_(cols, cols)] @ w,
                }
                for m in ms
            ]

        def solve(ms, cols, groups):
            ms = [only(m, cols) for m in ms]
            if how == "lasso":
                try:
                    return lasso_cv(ms, c.lasso_max_iter)
                except (ArithmeticError, ValueError, np.linalg.LinAlgError):
                    whole = added(ms)
                    return ridge(whole["xx"], whole["xy"], 1e-2, 0.0, [])
            whole = added(ms)
            scale = np.sqrt(np.log(max(len(cols), 2)) / max(whole["n"], 1)) / 0.1 if c.adaptive_regularization else 1.0
            place = {k: i for i, k in enumerate(cols)}
            blocks = [[place[k] for k in b if k in place] for b in groups]
            return ridge(whole["xx"], whole["xy"], c.alpha_ridge * scale, c.alpha_smooth * scale, blocks)

        def mse(m, w):
            return max(float(m["yy"] - 2 * m["xy"] @ w + w @ m["xx"] @ w), 0.0) / max(m["n"], 1.0)

        own_at = [at[k] for k in own]
        groups = {s: [at[k] for k in cols] for s, cols in sources.items()}
        rest = [k for cols in groups.values() for k in cols]
        every = list(range(len(columns)))
        train, val = parts("f")
        both = added(train)
        w_own = np.linalg.lstsq(both["xx"][np.ix_(own_at, own_at)], both["xy"][own_at], rcond=None)[0] if own_at else np.zeros(0)
        w = np.zeros(len(columns))
        if c.residualize_ar and own_at:
            w[own_at] = w_own
            if rest:
                w[rest] = solve(without(train, own_at, w_own), rest, list(groups.values()))
        else:
            w[every] = solve(train, every, [own_at, *groups.values()])
        base = mse(val, w)
        mean = both["y"] / max(both["n"], 1.0)
        null = (val["yy"] - 2 * mean * val["y"] + mean * mean * val["n"]) / max(val["n"], 1.0)
        w_self = np.zeros(len(columns))
        w_self[own_at] = w_own
        self_mse = mse(val, w_self) if own_at else null

        def dropped(ms, v, weights, cols):
            if c.refit_on_drop:
                keep = [k for k in every if k not in cols]
                again = np.zeros(len(columns))
                again[keep] = solve(ms, keep, [own_at, *groups.values()])
                return mse(v, again)
            masked = weights.copy()
            masked[cols] = 0
            return mse(v, masked)

        if c.backward_check:
            train_b, val_b = parts("b")
            w_b = solve(train_b, every, [own_at, *groups.values()])
            base_b = mse(val_b, w_b)
        out = []
        for s, cols in groups.items():
            pair = own_at + cols
            w_pair = np.zeros(len(columns))
            w_pair[pair] = solve(train, pair, [own_at, cols])
            forth = dropped(train, val, w, cols) - base
            back = dropped(train_b, val_b, w_b, cols) - base_b if c.backward_check else 0.0
            asym = max(0.0, forth - back)
            kernel = w[cols]
            peak = int(np.argmax(np.abs(kernel)))
            out.append(
                (
                    pdf["series_id"].iloc[0], s, target, float(np.linalg.norm(kernel)), peak + 1, int(np.sign(kernel[peak])), kernel.tolist(),
                    base, float(null), self_mse, mse(val, w_pair), forth, back, asym, max(0.0, forth) + c.asymmetry_weight * asym,
                )
            )
        names = [x.strip().split(" ")[0] for x in _FIT.split(",")]
        return pd.DataFrame(out, columns=names)

    return rows.groupBy("series_id", "dst").applyInPandas(fit, _FIT)


def solvers(panel: DataFrame, c: InverseConfig) -> DataFrame:
    """The gate of each series and the solver it calls for."""
    gate = sc.correlation_gate(pair_corr(panel), pn.shape(panel), c.ar_lag, c.max_lag)
    auto = F.when((F.col("regime") == "strong") | (F.col("max_corr") > 0.6), "ridge").otherwise("lasso")
    return gate.withColumn("solver", auto if c.solver == "auto" else F.lit(c.solver))


def fit_status(panel: DataFrame, config: InverseConfig = InverseConfig()) -> DataFrame:
    """series_id, n_frames and status: fitted, or too_short for these lags."""
    enough = F.col("n_frames") - max(config.max_lag, config.ar_lag) >= max(config.min_train_size, 10)
    return pn.shape(panel).select("series_id", "n_frames", F.when(enough, "fitted").otherwise("too_short").alias("status"))


def inverse_edges(panel: DataFrame, config: InverseConfig = InverseConfig()) -> DataFrame:
    """Every ordered pair with its fit, score (after the filters), raw (before
    them) and, unless switched off, direct_score. Series with too few frames
    have no rows (``fit_status`` names them); if all have, that is an error."""
    panel = written(panel, "panel")
    status = written(fit_status(panel, config), "status")
    if not status.where("status = 'fitted'").take(1):
        short = status.first()
        if short:
            raise ValueError(f"series {short['series_id']} has too few frames: {short['n_frames']}")
    panel = panel.join(status.where("status = 'fitted'"), "series_id", "left_semi")
    gate = solvers(panel, config)
    fits = written(target_fits(panel, config, gate.select("series_id", "solver")), "fits")
    score = {
        "block_norm": F.col("block_norm"),
        "delta_mse": F.greatest("delta_mse", F.lit(0.0)),
        "mixed": sc.mixed_score(),
    }
    if config.score_mode == "anomaly":
        rows = sc.anomaly_score(fits).withColumn("raw", F.col("anomaly")).drop("anomaly")
    else:
        rows = fits.withColumn("raw", score.get(config.score_mode, score["mixed"]))
    links = sc.strong(rows.withColumn("score", F.col("raw")), config.min_effect)
    if config.prune:
        links = sc.confident(links, config.prune_quantile, config.min_effect)
    if config.textbook:
        links = g.textbook_filter(links, tolerance=config.lag_tolerance)
    rows = rows.join(links.select(*EDGE, "score"), EDGE, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if config.direct:
        rows = sc.direct_scores(rows, tau=max(1.0, float(config.lag_tolerance)))
    return rows


def adjacency_scores(panel: DataFrame, max_lag: int = 5) -> DataFrame:
    """Scores alone: norms of the kernels, no filter."""
    c = InverseConfig(max_lag=max_lag, score_mode="block_norm", textbook=False, direct=False, min_train_size=max(20, 2 * max_lag))
    return inverse_edges(panel, c).select(*EDGE, F.col("raw").alias("score"))
