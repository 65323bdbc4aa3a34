"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x_i says
whether a hashed term is in the text. The pairwise part learns what single
weights cannot, such as an insult beside the mention of a group.

Terms are a text's words (runs of letters, lower case), their first four
letters as met in at least one, two or three different words, and the text's
length to a power of two, hashed to BUCKETS. Training uses at most SAMPLE labelled documents,
the first in a hashed order of doc_id, and only the FEATURES buckets that tell
most about the label in that sample; the machine itself is trained on those
bounded rows. Scoring reads every whole text.

Defined results: null and empty texts hold one term, that of their length 0; a
text is read whole, however long; a document without label is scored but not trained on; repeated
labels of a document count once (the largest); without any usable label, or
with labels all alike, every score is the share of toxic labels (0 if none);
repeated rows are scored one by one; an empty table gives an empty result; other
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, stored, unused
from .tokens import Remembered

BUCKETS, FEATURES, FACTORS = 1 << 20, 4096, 6
#: The bound of the training sample, in documents.
SAMPLE = 20_000
#: Least evidence of a chosen bucket (its likelihood ratio statistic); the 32
#: buckets of most evidence need less, for small samples.
EVIDENCE = 18.0
#: Words a Python worker remembers the places of.
WORDS = 1 << 16
EPOCHS, RATE, DECAY, SEED = 30, 0.1, 1e-4, 11
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _stems(words: set[str]) -> Counter:
    """How many different words begin with the same four letters."""
    return Counter([w[:4] for w in words])


def _all_terms(text: str | None):
    found = _WORD.findall((text or "").lower())
    words = set(found)
    yield f"n{len(found).bit_length()}"
    for w in words:
        yield "w" + w
    for stem, n in _stems(words).items():
        for k in range(1, min(n, 3) + 1):
            yield f"{k}{stem}"


def term_buckets(text: str | None) -> np.ndarray:
    """The text's hashed terms, each once."""
    return np.unique(np.fromiter(map(_bucket, _all_terms(text)), "i8"))


class FactorizationMachine:
    """Weights over chosen buckets. ``fit`` is plain AdaGrad on the logistic
    loss, the rarer label weighted up."""

    def __init__(self, buckets: np.ndarray, factors: int = FACTORS, seed: int = SEED):
        self.buckets = np.sort(buckets)
        self.place = {int(b): k for k, b in enumerate(self.buckets)}
        self.bias = 0.0
        self.w = np.zeros(len(buckets))
        self.v = np.random.default_rng(seed).normal(0, 0.05, (len(buckets), factors))

    def margin(self, places: np.ndarray) -> float:
        v = self.v[places]
        total = v.sum(axis=0)
        return float(self.bias + self.w[places].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, places) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(np.asarray(places, "i8")), -35, 35))))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = SEED):
        rng = np.random.default_rng(seed)
        toxic = max(labels.mean(), 1e-9)
        weight = np.where(labels == 1, min(0.5 / toxic, 10.0), 0.5 / max(1 - toxic, 1e-9))
        self.bias = float(np.log(toxic / max(1 - toxic, 1e-9)))
        g0, gw, gv = 1.0, np.ones(len(self.w)), np.ones(self.v.shape)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                x = rows[k]
                v = self.v[x]
                total = v.sum(axis=0)
                z = self.bias + self.w[x].sum() + 0.5 * (total @ total - (v * v).sum())
                off = weight[k] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[k])
                g0 += off * off
                self.bias -= rate * off / np.sqrt(g0)
                if len(x):
                    d = off + decay * self.w[x]
                    gw[x] += d * d
                    self.w[x] -= rate * d / np.sqrt(gw[x])
                    d = off * (total - v) + decay * v
                    gv[x] += d * d
                    self.v[x] = v - rate * d / np.sqrt(gv[x])
        return self


def _labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, y, terms of the training sample."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    chosen = stored(chosen, "label-sample")  # at most ``sample`` rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rows(batches):
        for b in batches:
            terms = [term_buckets(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array(terms, pa.list_(pa.int64()))], ["doc_id", "y", "terms"]
            )

    return texts.join(F.broadcast(chosen), "doc_id").mapInArrow(rows, "doc_id long, y int, terms array<long>")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, features: int = FEATURES) -> FactorizationMachine:
    known = stored(_labelled(docs, labels, label, sample), "labelled-terms")
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    machine = FactorizationMachine(np.empty(0, "i8"))
    if not toxic or not clean:
        machine.bias = 35.0 if toxic else -35.0
        return machine
    seen = known.select("y", F.explode("terms").alias("bucket")).groupBy("bucket").agg(
        F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")
    )
    # Twice the log-likelihood gained by giving the bucket its own toxic share.
    share = toxic / (toxic + clean)
    n_docs, t, c = F.col("t") + F.col("c"), F.col("t"), F.col("c")
    told = 2 * (
        F.when(t > 0, t * F.log(t / (n_docs * share))).otherwise(0.0)
        + F.when(c > 0, c * F.log(c / (n_docs * (1 - share)))).otherwise(0.0)
    )
    best = seen.select("bucket", told.alias("told")).where("told >= 6").orderBy(F.desc("told"), "bucket").limit(features).collect()
    best = [r for k, r in enumerate(best) if k < 32 or r["told"] >= EVIDENCE]
    machine = FactorizationMachine(np.array([r["bucket"] for r in best], "i8"))
    place = F.broadcast(docs.sparkSession.createDataFrame(list(machine.place.items()) or [(-1, -1)], "bucket long, place int"))
    rows = (
        known.select("doc_id", "y", F.explode_outer("terms").alias("bucket"))
        .join(place, "bucket", "left")
        .groupBy("doc_id", "y")
        .agg(F.sort_array(F.collect_set("place")).alias("x"))
        .orderBy("doc_id")
        .collect()
    )
    return machine.fit([np.array(r["x"], "i8") for r in rows], np.array([r["y"] for r in rows], "f8"))


def scored(docs: DataFrame, machine: FactorizationMachine, name: str = "toxic_score") -> DataFrame:
    """docs with the score, under a name it doesn't have, beside its columns."""
    if unused(docs, name) != name:
        raise ValueError(f"the documents have a column {name} already")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def rows(batches):
        places = lambda *terms: tuple(machine.place.get(_bucket(t), -1) for t in terms)
        of_word = Remembered(lambda w: places("w" + w)[0], WORDS)
        of_stem = Remembered(lambda s: places("1" + s, "2" + s, "3" + s), WORDS)
        of_length = Remembered(lambda n: places(f"n{n}")[0], WORDS)
        for b in batches:
            scores = []
            for text in b.column("text").to_pylist():
                found = _WORD.findall((text or "").lower())
                words = set(found)
                x = set(map(of_word.__getitem__, words))
                x.add(of_length[len(found).bit_length()])
                for stem, n in _stems(words).items():
                    x.update(of_stem[stem][:n])
                x.discard(-1)
                scores.append(machine.score(sorted(x)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(rows, schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold."""
    machine, name = train(docs, labels), unused(docs, "toxic_score")
    return scored(docs, machine, name).where(F.col(name) < threshold).drop(name)


def op3_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = train(docs, labels.where(~held_out()))
    return scored(docs, machine).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
