"""Five-word shingle sets of many texts at once, as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes of text that are hashed together; a longer text is hashed alone.
CHUNK = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(
    32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, "u8")
    out[0] = 1
    size = 1
    while size < n:
        step = np.uint64(pow(base, size, 1 << 64))
        take = min(size, n - size)
        out[size : size + take] = out[:take] * step
        size += take
    return out


_UP, _DOWN = np.ones(1, "u8"), np.ones(1, "u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    global _UP, _DOWN
    raw = np.frombuffer(b" ".join([b"", *texts, b""]).translate(_LOWER), "u1")
    if len(_UP) < len(raw):
        _UP, _DOWN = _powers(_BASE, len(raw) + CHUNK), _powers(_INVERSE, len(raw) + CHUNK)
    blank = raw == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # a word's start, then its end, in turn
    begin, end = edge[::2], edge[1::2]
    sums = np.empty(len(raw) + 1, "u8")
    sums[0] = 0
    np.cumsum((raw.astype("u8") + np.uint64(1)) * _UP[: len(raw)], out=sums[1:])
    words = _mix((sums[end] - sums[begin]) * _DOWN[begin] + (end - begin).astype("u8") * _STEP)
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(begin, bounds)
    rolled = np.zeros(max(len(words) - width + 1, 0), "u8")
    for k in range(width):
        rolled = rolled * _STEP + words[k : k + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            s = np.sort(rolled[lo : hi - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif hi > lo:
            whole = np.array([hi - lo], "u8")
            for k in range(lo, hi):
                whole = _mix(whole * _STEP + words[k])
            out.append(whole)
        else:
            out.append(np.empty(0, "u8"))
    return out


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text its distinct shingles; fewer words make one shingle; none
    for a null or blank text."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        b = (text or "").encode()
        if held and size + len(b) > CHUNK:
            yield from _chunk_sets(held, width)
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield from _chunk_sets(held, width)
