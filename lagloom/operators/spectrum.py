"""Amplitude spectra of whole series, however long.

The discrete transform of n frames is a convolution with a chirp, done by
transforms of a power-of-two length M = P * Q of at least 2n - 1 points. Each of
them is cut in two passes, over the residues of the frame and over the residues
of the frequency, and the last pass of one is the first of the next. So three
shuffles of rows and groups of at most POINTS points (or P of them, where P is
more) serve a series of any length, and work grows as n log n.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points that one group transforms at once.
POINTS = 1 << 16
_KEYS = ["series_id", "dim", "n_frames", "bits"]
_HEAD = "series_id string, dim int, n_frames long, bits int"


def amplitudes(panel: DataFrame, value: str = "value") -> DataFrame:
    """series_id, dim, n_frames, k, amplitude for each frequency 0 <= k < n_frames
    (null values and frames that are not there count as 0)."""
    sizes = panel.groupBy("series_id", "dim").agg((F.max("t") + 1).cast("long").alias("n_frames"))
    sizes = sizes.withColumn("bits", F.length(F.bin(2 * F.col("n_frames") - 2)).cast("int"))
    frames = panel.select("series_id", "dim", "t", F.col(value).alias("value")).join(sizes, ["series_id", "dim"])
    # Each residue must have a group, even where it has no frame.
    spine = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), _count(_low()) - 1)).alias("t"), F.lit(0.0).alias("value"))
    rows = frames.select(*_KEYS, "t", F.coalesce("value", F.lit(0.0)).alias("value")).unionByName(spine.select(*_KEYS, "t", "value"))
    over_frames = _grouped(rows, F.col("t") % _count(_low()), _high()).applyInPandas(
        _over_frames, f"{_HEAD}, k1 long, t2 long, are double, aim double, bre double, bim double"
    )
    over_residues = _grouped(over_frames, F.col("k1"), _low()).applyInPandas(_over_residues, f"{_HEAD}, k1 long, j1 long, re double, im double")
    found = _grouped(over_residues, F.col("j1"), _high()).applyInPandas(_back, f"{_HEAD}, k long, amplitude double")
    return found.select("series_id", "dim", "n_frames", "k", "amplitude")


def _low() -> Column:
    return F.expr("bits div 2").cast("int")


def _high() -> Column:
    return F.expr("bits - bits div 2").cast("int")


def _count(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def _grouped(rows: DataFrame, place: Column, bits: Column):
    """Groups of as many neighbouring places, each of 2 ** bits points, as make
    up POINTS."""
    width = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(POINTS) / _count(bits)))
    return rows.withColumn("width", width).withColumn("block", F.floor(place / F.col("width"))).groupBy(*_KEYS, "width", "block")


class _Plan:
    """What all groups of a series share: lengths, factors and the chirp."""

    def __init__(self, key: tuple):
        self.head = key[:4]
        self.n, bits, self.width, self.block = (int(x) for x in key[2:])
        self.p, self.q, self.m = 1 << (bits - bits // 2), 1 << (bits // 2), 1 << bits

    def places(self, count: int) -> np.ndarray:
        return np.arange(self.block * self.width, min(count, (self.block + 1) * self.width))

    def chirp(self, t: np.ndarray) -> np.ndarray:
        """exp(-i pi t^2 / n), the square reduced in whole numbers."""
        return np.exp(-1j * np.pi * ((t * t) % (2 * self.n)) / self.n)

    def turn(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi * (a * b) / self.m)

    def frame(self, **columns: np.ndarray) -> pd.DataFrame:
        shown = pd.DataFrame(columns)
        for at, (name, one) in enumerate(zip(_KEYS, self.head, strict=True)):
            shown.insert(at, name, one)
        return shown


def _over_frames(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Frames t = q * t1 + t2 of some t2, transformed over t1; the same of the
    chirp they are convolved with."""
    s = _Plan(key)
    t2, k1 = s.places(s.q), np.arange(s.p)
    t = pdf["t"].to_numpy("i8")
    a = np.zeros((s.p, len(t2)), "c16")
    np.add.at(a, (t // s.q, t % s.q - t2[0]), pdf["value"].to_numpy("f8") * s.chirp(t))
    at = s.q * k1[:, None] + t2[None, :]
    near = np.minimum(at, s.m - at)
    b = np.where(near < s.n, s.chirp(np.minimum(near, s.n)).conj(), 0)
    turn = s.turn(k1[:, None], t2[None, :])
    a, b = np.fft.fft(a, axis=0) * turn, np.fft.fft(b, axis=0) * turn
    a, b = a.ravel(), b.ravel()
    return s.frame(k1=np.repeat(k1, len(t2)), t2=np.tile(t2, s.p), are=a.real, aim=a.imag, bre=b.real, bim=b.imag)


def _over_residues(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Both transforms ended for some k1, multiplied, and the way back begun."""
    s = _Plan(key)
    k1, j1 = s.places(s.p), np.arange(s.q)
    a, b = np.zeros((2, len(k1), s.q), "c16")
    at = pdf["k1"].to_numpy("i8") - k1[0], pdf["t2"].to_numpy("i8")
    a[at] = pdf["are"].to_numpy() + 1j * pdf["aim"].to_numpy()
    b[at] = pdf["bre"].to_numpy() + 1j * pdf["bim"].to_numpy()
    c = np.fft.ifft(np.fft.fft(a, axis=1) * np.fft.fft(b, axis=1), axis=1) * s.turn(k1[:, None], j1[None, :]).conj()
    c = c.ravel()
    return s.frame(k1=np.repeat(k1, s.q), j1=np.tile(j1, len(k1)), re=c.real, im=c.imag)


def _back(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The amplitudes at k = j1 + q * j2 for some j1."""
    s = _Plan(key)
    j1 = s.places(s.q)
    c = np.zeros((s.p, len(j1)), "c16")
    c[pdf["k1"].to_numpy("i8"), pdf["j1"].to_numpy("i8") - j1[0]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
    k = (j1[None, :] + s.q * np.arange(s.p)[:, None]).ravel()
    found = np.abs(np.fft.ifft(c, axis=0)).ravel()
    return s.frame(k=k[k < s.n], amplitude=found[k < s.n])
