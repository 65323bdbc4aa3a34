"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of 0 to ``order`` bytes with the
counts of the bytes that followed. A byte is coded in its longest known context;
where that never saw the byte, an escape is paid and the context is shortened,
down to a uniform code of 8 bits. With T bytes seen after a context, U of them
different, a byte seen c times costs log2((T + U) / c) bits and an escape
log2((T + U) / U) (escape method C, without exclusions). Statistics are frozen
after training. A text's code length is the sum over all its bytes, and the
language of the shortest wins.

Training reads at most about ``rows`` texts of each language (documents chosen
by a hash of id and text, whole texts), so the trees' size is bounded however
large the corpus is. Spark counts the longest contexts of the sample; shorter
ones follow from them. Scoring is one pass over all texts without a shuffle:
all languages share one table of byte strings whose rows hold the full code
length of the last byte in every language, escapes included.

Code lengths are whole multiples of 2^-16 bits, so sums don't depend on the
order or the batch.

Defined results
* text that is null or has no letter: ``und``, score 0, no code lengths; so is
  every text if nothing could be learned.
* score: the winner's share of 2^-length over all languages (1: no doubt).
* ties go to the language that is first by its UTF-8 bytes.
* null labels and null or empty texts teach nothing.
* every input row gives one row, repeated rows alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

#: Bytes of the longest context; texts sampled for each language; most languages.
ORDER, ROWS, LANGUAGES = 4, 2000, 512
#: Code lengths are counted in units of 2^-16 bits.
BIT = 1 << 16
#: A symbol is a byte or the mark that stands before a text, in 9 bits.
MARK, WIDE = 256, 9
#: Code lengths looked up at once (bytes x languages).
CELLS = 1 << 20
UNKNOWN = "und"


def symbols(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each text after ``order`` marks, and where each
    text (with its marks) starts; the last entry is the end. Null is empty."""
    raw = texts.cast(pa.binary()).fill_null(b"")
    at = np.frombuffer(raw.buffers()[1], "<i4")[raw.offset : raw.offset + len(raw) + 1].astype("i8")
    data = np.frombuffer(raw.buffers()[2] or b"", "u1")[at[0] : at[-1]]
    starts = at - at[0] + order * np.arange(len(raw) + 1)
    out = np.full(starts[-1], MARK, "i8")
    out[np.arange(len(data)) + order * (1 + np.repeat(np.arange(len(raw)), np.diff(at)))] = data
    return out, starts


def strings(s: np.ndarray, begin: int, end: int, size: int) -> np.ndarray:
    """The last ``size`` symbols up to each place, as one number (the last
    symbol lowest); places before the array count as marks."""
    key = np.zeros(end - begin, "i8")
    for back in range(size):
        lo = begin - back
        part = s[max(lo, 0) : max(end - back, 0)]
        if lo < 0:
            part = np.concatenate((np.full(min(-lo, end - begin), MARK, "i8"), part))
        key |= part << (WIDE * back)
    return key


class Slots:
    """Numbers of distinct non-negative keys by open addressing, many at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.number = np.full(1 << bits, -1, "i8"), np.zeros(1 << bits, "i4")
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.key[at] == -1
            self.key[at[free]] = keys[left[free]]
            self.number[at[free]] = left[free]
            won = self.key[at] == keys[left]
            # of several keys that wrote one slot, the last stays: its number too
            self.number[at[won]] = left[won]
            left, at = left[~won], (at[~won] + 1) & self.last

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype("i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that aren't there."""
        at = self._place(keys)
        held = self.key[at]
        out = np.where(held == keys, self.number[at], -1)
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            at_ = at[todo] = (at[todo] + 1) & self.last
            held = self.key[at_]
            hit = held == keys[todo]
            out[todo[hit]] = self.number[at_[hit]]
            todo = todo[~hit & (held != -1)]
        return out


def _bits(share: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(share) * BIT).astype("i8")


class PpmTrees:
    """The frozen context trees of all languages.

    ``costs[d]``: code length of a string's last byte, by string of d + 1
    symbols and language; ``escapes[d]``: cost of leaving a context of d
    symbols, 0 where a language doesn't know it.
    """

    def __init__(self, languages: list[str], order: int, lang: np.ndarray, key: np.ndarray, count: np.ndarray):
        """lang, key, count: how often each language has each string of
        order + 1 symbols."""
        self.languages, self.order = languages, order
        many = len(languages)
        self.slots, self.costs, self.context_slots, self.escapes = [], [], [], []
        for d in range(order + 1):
            gram = key & ((1 << (WIDE * (d + 1))) - 1)
            grams, g = np.unique(gram, return_inverse=True)
            contexts, c = np.unique(grams >> WIDE, return_inverse=True)
            n = np.bincount(g * many + lang, count, len(grams) * many).reshape(len(grams), many)
            total = np.zeros((len(contexts), many))
            different = np.zeros((len(contexts), many))
            np.add.at(total, c, n)
            np.add.at(different, c, n > 0)
            known = total > 0
            escape = np.zeros(total.shape, "i8")
            escape[known] = _bits(different[known] / (total[known] + different[known]))
            if d:
                shorter = self.costs[d - 1][self.slots[d - 1].find(grams & ((1 << (WIDE * d)) - 1))]
            else:
                shorter = np.full(n.shape, 8 * BIT, "i8")
            cost = escape[c] + shorter
            there = n > 0
            cost[there] = _bits((n / np.maximum(total + different, 1)[c])[there])
            self.slots.append(Slots(grams))
            self.costs.append(cost)
            self.context_slots.append(Slots(contexts))
            self.escapes.append(escape)

    def byte_costs(self, s: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Code length of each symbol in every language; 0 for marks."""
        out = np.zeros((end - begin, len(self.languages)), "i8")
        key = strings(s, begin, end, self.order + 1)
        todo = np.flatnonzero(s[begin:end] != MARK)
        for d in range(self.order, -1, -1):
            gram = key[todo] & ((1 << (WIDE * (d + 1))) - 1)
            row = self.slots[d].find(gram)
            hit = row >= 0
            out[todo[hit]] += self.costs[d][row[hit]]
            todo, gram = todo[~hit], gram[~hit]
            if not len(todo):
                return out
            row = self.context_slots[d].find(gram >> WIDE)
            known = row >= 0
            out[todo[known]] += self.escapes[d][row[known]]
        out[todo] += 8 * BIT
        return out

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Code length of each whole text in every language."""
        s, starts = symbols(texts, self.order)
        out = np.zeros((len(texts), len(self.languages)), "i8")
        step = max(CELLS // max(len(self.languages), 1), 1)
        for begin in range(0, len(s), step):
            end = min(begin + step, len(s))
            first = int(np.searchsorted(starts, begin, "right")) - 1
            last = int(np.searchsorted(starts, end, "left"))
            cuts = np.maximum(starts[first:last] - begin, 0)
            out[first : first + len(cuts)] += np.add.reduceat(self.byte_costs(s, begin, end), cuts, axis=0)
        return out

    def judge(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """language, score and bits (in every language) of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros((len(texts), 0))
        bits = self.lengths(texts) / BIT
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best][:, None]
        score = 1 / np.exp2(np.maximum(least - bits, -1000.0)).sum(axis=1)
        return [self.languages[k] for k in best], score, bits


@dataclass(frozen=True)
class PpmLanguages:
    """Trees in the driver; ``predict`` sends them to the executors once."""

    trees: PpmTrees

    @classmethod
    def fit(cls, labelled: DataFrame, rows: int = ROWS, order: int = ORDER) -> PpmLanguages:
        """labelled: doc_id, text, lang. About ``rows`` texts of a language are
        read at most; a language has a row of counts in the driver, and more
        than ``LANGUAGES`` are refused."""
        if not 1 <= order <= 6:
            raise ValueError("order is 1 to 6")
        known = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL")
        sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
        if len(sizes) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages")
        languages = sorted(sizes, key=str.encode)
        if not languages:
            return cls(PpmTrees([], order, *(np.zeros(0, "i8"),) * 3))
        share = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, rows / sizes[name]))))
        draw = F.xxhash64("doc_id", "text").bitwiseAND((1 << 53) - 1) / float(1 << 53)
        number = F.create_map(*(F.lit(x) for k, name in enumerate(languages) for x in (name, k)))
        chosen = known.where("text <> ''").where(draw < share[F.col("lang")]).select(number[F.col("lang")].alias("lang"), F.col("text").cast("string").alias("text"))

        def count(batches):
            for b in slices(batches, 256):
                s, starts = symbols(b.column("text"), order)
                lang = np.repeat(np.asarray(b.column("lang")), np.diff(starts))
                byte = s != MARK
                key = strings(s, 0, len(s), order + 1)[byte]
                # one number for language and string: 63 bits hold 7 symbols, so they are told apart by sorting both
                at = np.lexsort((key, lang[byte]))
                key, of = key[at], lang[byte][at]
                new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))) if len(key) else np.zeros(0, "i8")
                yield pa.RecordBatch.from_arrays([pa.array(of[new], pa.int32()), pa.array(key[new]), pa.array(np.diff(np.append(new, len(key))))], ["lang", "key", "n"])

        counted = chosen.mapInArrow(count, "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
        table = counted.toArrow()  # bounded by the sample
        lang, key, n = (np.asarray(table.column(c)) for c in ("lang", "key", "n"))
        taught = np.unique(lang)
        return cls(PpmTrees([languages[k] for k in taught], order, np.searchsorted(taught, lang), key, n))

    def predict(self, docs: DataFrame) -> DataFrame:
        """doc_id, lang_pred, score and bits (code length by language)."""
        trees = docs.sparkSession.sparkContext.broadcast(self.trees)
        lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("string"))

        def rows(batches):
            for b in slices(batches, 256):
                texts = b.column("text")
                names, score, bits = trees.value.judge(texts)
                told = np.asarray(texts.is_valid()) & bool(trees.value.languages)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array([n if t else UNKNOWN for n, t in zip(names, told.tolist(), strict=True)], pa.string()),
                        pa.array(np.where(told, score, 0.0)),
                        pa.array([dict(zip(trees.value.languages, x, strict=True)) if t else {} for x, t in zip(bits.tolist(), told.tolist(), strict=True)], pa.map_(pa.string(), pa.float64())),
                    ],
                    ["doc_id", "lang_pred", "score", "bits"],
                )

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lettered.alias("text")).mapInArrow(rows, "doc_id long, lang_pred string, score double, bits map<string,double>")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = PpmLanguages.fit(docs.where(~held_out()))
    return model.predict(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
