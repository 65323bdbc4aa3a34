"""Spectra in passes against NumPy's transform."""

import numpy as np
import pytest

from lagloom.operators import spectrum
from lagloom.plans.network import low_frequency_share


@pytest.mark.parametrize("points", [8, 1 << 16])
def test_amplitudes_equal_a_direct_transform(spark, monkeypatch, points):
    monkeypatch.setattr(spectrum, "POINTS", points)
    rng, rows, want = np.random.default_rng(3), [], {}
    for n in (1, 2, 3, 7, 64, 97, 250):
        x = rng.normal(size=n)
        x[n // 2] = 0
        want[f"s{n}"] = np.abs(np.fft.fft(x))
        # A frame that is 0 may as well be null or missing.
        rows += [(f"s{n}", t, 0, float(v)) if t != n // 2 else (f"s{n}", t, 0, None) for t, v in enumerate(x)]
    panel = spark.createDataFrame(rows, "series_id string, t long, dim int, value double")
    found = spectrum.amplitudes(panel).toPandas()
    assert len(found) == sum(map(len, want.values()))
    for name, part in found.sort_values("k").groupby("series_id"):
        np.testing.assert_allclose(part["amplitude"].to_numpy(), want[name], atol=1e-9)
    assert spectrum.amplitudes(panel.limit(0)).count() == 0


def test_low_frequency_share(spark):
    x = np.random.default_rng(5).normal(size=(3, 211))
    rows = [("a", t, d, float(x[d, t])) for d in range(3) for t in range(211)]
    share = low_frequency_share(spark.createDataFrame(rows, "series_id string, t long, dim int, value double")).first()["low_share"]
    amp = np.abs(np.fft.fft(x, axis=1))[:, :105]
    assert abs(share - amp[:, :21].sum() / amp.sum()) < 1e-9
