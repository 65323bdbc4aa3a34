"""Stretches of words that repeat with a period, found by harmonic grid probing.

A run of period p and length 2p or more has p positions i in a row where word i
equals word i + p, so one of them is a multiple of p. For each p the words at jp
and (j + 1)p are compared (n log n probes for n words); where they agree, and
also do halfway to either side as far as a run would need, arrays of words are
compared chunk by chunk to both sides until they differ. Grid points inside a
stretch just measured, or inside a run whose period divides p, are skipped: they
would give the same run; so are points in two runs whose ends leave too little
room. Periods are tried in ascending order, so a stretch is
first met with its smallest period; multiples of it give the stretch again and
are left out.

Whole texts are searched, each by one task; nothing is shuffled. Probes of a
text are made in blocks, so memory grows with its words, not with the probes.
Time can reach the square of the words where many stretches nearly, but not
quite, repeat at many periods (README has a figure).

Defined results
* words are ``[^\\x20\\x09-\\x0D]+``; null or empty texts and texts of white
  space have no words, no runs and an empty collapsed text.
* runs may overlap or lie inside one another; each (start, length) has one
  period. They come sorted by start, then period.
* every input row gives one row; repeated rows give repeated rows. Only the
  columns in ``keep`` are passed on; one named as an output column is refused.
* an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

#: Words of the shortest run.
SHORTEST = 12
#: Probes made at once, and words of the longest chunk compared.
PROBES, CHUNK = 1 << 18, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def _ahead(a: np.ndarray, i: int, j: int) -> int:
    """How many words from j on equal those from i on (i < j)."""
    most, at, size = len(a) - j, 0, 32
    while at < most:
        n = min(size, most - at)
        differ = a[i + at : i + at + n] != a[j + at : j + at + n]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, size = at + n, min(2 * size, CHUNK)
    return most


def _behind(a: np.ndarray, i: int, j: int) -> int:
    """How many words before j equal those before i (i < j)."""
    at, size = 0, 32
    while at < i:
        n = min(size, i - at)
        differ = (a[i - at - n : i - at] != a[j - at - n : j - at])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, size = at + n, min(2 * size, CHUNK)
    return i


def _survivors(a: np.ndarray, shortest: int):
    """Blocks of (p, i), by p then i: grid points i that agree with i + p and,
    to one side, halfway and all of half the agreement a run needs."""
    n = len(a)
    ends = np.concatenate((a, [-1, -1]))  # -1 stands before the first and after the last word
    counts = (n - 1) // np.arange(1, n // 2 + 1)
    total, first = np.cumsum(counts), 0
    while first < len(counts):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + PROBES, "right")))
        c = counts[first:last]
        p = np.repeat(np.arange(first + 1, last + 1), c)
        i = (np.arange(len(p)) - np.repeat(total[first:last] - c - done, c)) * p
        agree = a[i] == a[i + p]
        p, i = p[agree], i[agree]
        if len(p):
            half = np.maximum(shortest - p, p) // 2
            right, left = np.ones(len(p), bool), np.ones(len(p), bool)
            for h in (np.minimum(half, 1), half // 2, half):
                right &= ends[np.minimum(i + h, n)] == ends[np.minimum(i + p + h, n)]
                left &= ends[np.maximum(i - h, -1)] == ends[i + p - np.minimum(h, i + 1)]
            some = right | left
            yield p[some], i[some]
        first = last


def _room(p, i, begin, end, period):
    """At most so many words agree around i. Where i and i + p lie in two found
    runs of one period q that end at different distances, the nearer end (q
    words away at least) breaks the agreement: the other run goes on."""
    j, q, wide = i + p, period[i], 1 << 60
    paired = (end[i] > 0) & (end[j] > 0) & (q == period[j])

    def side(x, y):
        near = np.minimum(x, y)
        return np.where(paired & (x != y) & (near >= q), near, wide)

    return side(end[i] - i, end[j] - j) + side(i - begin[i] + 1, j - begin[j] + 1) - 1


def find_runs(a: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in an array of word numbers."""
    n = len(a)
    if n < shortest:
        return []
    runs, seen = [], set()
    begin, end, period = np.zeros(n + 1, "i8"), np.zeros(n + 1, "i8"), np.ones(n + 1, "i8")  # of the run last found over a word
    for ps, at in _survivors(a, shortest):
        open_ = ~(at + ps < end[at]) | (ps % period[at] != 0)
        open_ &= _room(ps, at, begin, end, period) >= np.maximum(shortest - ps, ps)
        last_p = last_i = -1
        for p, i in zip(ps[open_].tolist(), at[open_].tolist(), strict=True):
            if p == last_p and i <= last_i:
                continue
            if i + p < end[i] and p % period[i] == 0:
                continue
            start = i - _behind(a, i, i + p)
            last_p, last_i = p, i + _ahead(a, i, i + p) - 1
            stop = last_i + p + 1
            if stop - start >= max(shortest, 2 * p) and (start, stop) not in seen:
                seen.add((start, stop))
                runs.append((start, stop - start, p))
                begin[start:stop], end[start:stop], period[start:stop] = start, stop, p
    runs.sort(key=lambda r: (r[0], r[2]))
    return runs


def word_numbers(words: list) -> np.ndarray:
    """Equal words have equal numbers."""
    numbers: dict = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), "i8", len(words))


def collapse(words: list[bytes], runs) -> bytes:
    """The words that no run contains after its first period, one space apart."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)


def periodic_runs(docs: DataFrame, text: str | Column = "text", keep: Sequence[str] = ("doc_id",), shortest: int = SHORTEST) -> DataFrame:
    """The columns ``keep``, n_words, runs (start, length, period) and collapsed."""
    made = {"n_words", "runs", "collapsed"}
    if made & {k.lower() for k in keep}:
        raise ValueError(f"keep has names of output columns: {sorted(made)}")
    text = F.col(text) if isinstance(text, str) else text
    kept = docs.select(*keep)
    rows = docs.select(*keep, text.cast("string").alias("collapsed"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "n_words bigint", "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"])

    def search(batches):
        for b in slices(batches):
            sizes, found, left = [], [], []
            for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist():
                words = (t or b"").split()  # bytes split at just these six characters
                runs = find_runs(word_numbers(words), shortest)
                sizes.append(len(words))
                found.append(runs)
                left.append(collapse(words, runs))
            flat = np.array([r for runs in found for r in runs], "i8").reshape(-1, 3)
            cells = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype("i4")
            made = [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), cells), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "n_words", "runs", "collapsed"])

    return rows.mapInArrow(search, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The query's texts: in one document of ten the words from the a-th on are
    replaced by repetitions of p of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), F.slice(tail, 1, n - a)), " "))

    # transform binds the words, so they are extracted once
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic_runs(docs, planted(F.col("doc_id"), F.col("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
