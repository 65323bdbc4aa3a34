"""Exact token counts of every prefix, stored compactly beside each document.

A document's counts are one zlib-packed list of 16-bit differences, one for
each UTF-8 byte: a running sum gives the exact count of the text up to any
character, so cuts and budgets are answered without encoding again.

Null text counts as empty (no bytes, no tokens); every input row gives a row;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _id_text, pair_encoder
from .common import documents, stored
from .tokens import TOKENIZER, encoder

LIMIT = 1024


def prefix_counts(docs: DataFrame, tokenizer: str = TOKENIZER, store: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and, if stored, prefix_counts (packed)."""

    def rows(batches):
        deltas = pair_encoder(tokenizer).prefix_deltas
        for b in batches:
            size, n, packed = [], [], []
            for text in b.column("text").to_pylist():
                d = deltas(text)
                size.append(len(d))
                n.append(int(d.sum(dtype="i8")))
                if store:
                    packed.append(zlib.compress(d.tobytes(), 1))
            columns = [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens"]
            if store:
                columns.append(pa.array(packed, pa.binary()))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(columns, names)

    kept = ", prefix_counts binary" if store else ""
    return _id_text(docs).mapInArrow(rows, f"doc_id long, n_bytes long, n_tokens long{kept}")


def unpack(packed: bytes) -> np.ndarray:
    """Token count after each byte."""
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<i2"), dtype="i8")


def longest_prefix(packed: Column, budget: Column) -> Column:
    """Bytes of the longest prefix of at most ``budget`` tokens. A cut between
    the bytes of a character is moved back by ``cut_text``."""
    return F.pandas_udf(_longest, "long")(packed, budget.cast("long"))


def _longest(packed: pd.Series, budget: pd.Series) -> pd.Series:
    out = []
    for p, b in zip(packed, budget, strict=True):
        within = np.flatnonzero(unpack(p) <= b) if p is not None and b == b else ()
        out.append(int(within[-1]) + 1 if len(within) else 0)
    return pd.Series(out, dtype="int64")


def cut_text(text: str, packed: bytes, budget: int) -> str:
    """The longest prefix, at an end of a character, of at most budget tokens."""
    raw, counts = text.encode(), unpack(packed)
    for end in range(len(raw), 0, -1):
        if (end == len(raw) or raw[end] & 0xC0 != 0x80) and counts[end - 1] <= budget:
            return raw[:end].decode()
    return ""


def library_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens for tokenizers other than byte-level BPE: the library counts."""

    def rows(batches):
        encode = encoder(tokenizer).encode
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                    pa.array([len(encode(t)) // 4 for t in texts], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return _id_text(docs).mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long")


def totals(packed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, from prefix_counts alone."""

    def rows(batches):
        for b in batches:
            size, n = [], []
            for p in b.column("prefix_counts").to_pylist():
                counts = unpack(p)
                size.append(len(counts))
                n.append(int(counts[-1]) if len(counts) else 0)
            columns = [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return packed.select("doc_id", "prefix_counts").mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the packed counts of every prefix; its rows are read from them."""
    return totals(stored(prefix_counts(documents(spark, sf_dir)), "prefix-counts"))
