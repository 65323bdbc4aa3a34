"""Byte-pair encoding by pair compatibility, and decoding by an offset table.

A list of tokens is the encoding of its bytes exactly if every neighbouring
pair is what its own bytes encode to. Two encoders rest on that:

* ``encode_piece`` walks forward with the longest token at each place (found by
  an Aho-Corasick automaton over reversed tokens) and backtracks to shorter
  ones where the pair table refuses; no boundary is refused twice.
* ``prefix_counts`` fills, from left to right, the token count of every prefix:
  of the tokens that end at a place just one fits the encoding before it.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .tokens import OTHER, PIECE, TOKENIZER, Remembered, byte_chars, encoder, tokenizer_path

#: Pairs a Python worker remembers before it starts anew.
REMEMBERED_PAIRS = 2_000_000

# The characters that are white space to the library.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = WHITE


def _units(letter: str, digit: str, other: str, space: str, dark: str):
    """A pre-token with the white space before it, or white space at the end."""
    tail = "'(?:s|t|re|ve|m|ll|d)"
    return rf"{tail}|{space}*{dark}{tail}|{space}*(?:{letter}+|{digit}+|{other}+)|{space}+"


UNIT = re.compile(_units(r"[^\W\d_]", r"\d", r"(?:[^\s\w]|_)", r"\s", r"[^\S ]"))


class PairBPE:
    def __init__(self, name: str = TOKENIZER):
        import ahocorasick

        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        chars = {c: b for b, c in byte_chars().items()}
        to_bytes = lambda shown: bytes(map(chars.__getitem__, shown))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ids = {to_bytes(t).decode("latin-1"): i for t, i in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {
            (vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)
        }
        self.byte_ids = [self.ids[chr(b)] for b in range(256)]
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.text = [""] * size
        for t, i in self.ids.items():
            self.text[i] = t
        self.length = list(map(len, self.text))
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.forward, self.backward = ahocorasick.Automaton(), ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.forward.add_word(t, i)
            self.backward.add_word(t[::-1], i)
            self.shorter[i] = next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1)
        self.forward.make_automaton()
        self.backward.make_automaton()
        self.pairs = Remembered(self._fits, REMEMBERED_PAIRS)
        self.offsets, self.blob = self._offset_table(size)

    def merged(self, text: str) -> list[int]:
        """Plain BPE: the merge of lowest rank first; for short texts."""
        ids = [self.byte_ids[ord(c)] for c in text]
        while len(ids) > 1:
            rank, new, pair = min(
                (self.merges.get(p, (1 << 30, -1)) + (p,) for p in zip(ids, ids[1:], strict=False)), key=lambda m: m[0]
            )
            if new < 0:
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _fits(self, pair: tuple[int, int]) -> bool:
        a, b = pair
        return self.merged(self.text[a] + self.text[b]) == [a, b]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as one character for each byte."""
        n = len(piece)
        if piece in self.ids:
            return [self.ids[piece]]
        longest = [-1] * n
        for end, token in self.backward.iter(piece[::-1]):
            at = n - 1 - end
            if longest[at] < 0:  # the automaton gives the longest match at an end first
                longest[at] = token
        length, shorter, pairs = self.length, self.shorter, self.pairs
        out: list[int] = []
        refused, at, token = bytearray(n + 1), 0, longest[0]
        while at < n:
            while token >= 0 and (refused[at + length[token]] or (out and not pairs[out[-1], token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                refused[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def prefix_counts(self, piece: str) -> list[int]:
        """Token counts of the first 1, 2, ... bytes of one pre-token."""
        n, pairs, length = len(piece), self.pairs, self.length
        last, count = [-1] * n, [0] * n
        for end, token in self.forward.iter(piece):
            if last[end] >= 0:
                continue
            start = end - length[token]
            if start < 0:
                last[end], count[end] = token, 1
            elif pairs[last[start], token]:
                last[end], count[end] = token, count[start] + 1
        return count

    # decoding

    def _offset_table(self, size: int):
        parts = [t.encode("latin-1") for t in self.text]
        for t, i in self.special.items():
            parts[i] = t.encode()
        return np.cumsum([0, *map(len, parts)]), np.frombuffer(b"".join(parts), "u1")

    def decode(self, ids: np.ndarray) -> str:
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(start - (ends - size), size)
        return self.blob[at].tobytes().decode("utf-8", "replace")


class PairEncoder:
    """Whole texts: pre-tokens and special strings as the library splits them."""

    def __init__(self, name: str = TOKENIZER):
        self.bpe = PairBPE(name)
        self.pre = encoder(name).library.pre_tokenizer
        self.shown = {ord(c): chr(b) for b, c in byte_chars().items()}
        self.pieces = Remembered(lambda p: self._ids(p.encode().decode("latin-1")))
        self.units = Remembered(self._unit)
        specials = sorted(self.bpe.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")

    def _ids(self, piece: str) -> bytes:
        return np.array(self.bpe.encode_piece(piece), "<u4").tobytes()

    def split(self, text: str):
        """(segment, special id or None) in turn."""
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.bpe.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def encode(self, text: str | None) -> bytes:
        out = []
        for part, special in self.split(text or ""):
            if special is not None:
                out.append(np.array([special], "<u4").tobytes())
            elif OTHER.search(part):
                shown = (p.translate(self.shown) for p, _ in self.pre.pre_tokenize_str(part))
                out += map(self._ids, shown)
            else:
                out += map(self.pieces.__getitem__, PIECE.findall(part))
        return b"".join(out)

    # prefix counts

    def _unit(self, unit: str) -> bytes:
        """Count after each byte less the count before it, for a unit alone."""
        body = unit.lstrip(WHITE)
        white = unit[: len(unit) - len(body)]
        as_bytes = lambda s: s.encode().decode("latin-1")
        counts = self.bpe.prefix_counts(as_bytes(white))
        done = 0
        pieces = _pieces(unit)
        for p in pieces[:-1]:
            done += len(self.bpe.encode_piece(as_bytes(p)))
        if body:
            last = as_bytes(pieces[-1])
            inner = self.bpe.prefix_counts(last)
            if last in ("'re", "'ve", "'ll"):  # cut short, the quote and the letter stand alone
                inner[1] = 1 + self.bpe.prefix_counts(last[1])[0]
            counts += [done + c for c in inner[len(last) - len(as_bytes(body)) :]]
        return np.diff([0, *counts]).astype("<i2").tobytes()

    def _plain_deltas(self, part: str):
        if not OTHER.search(part):
            return map(self.units.__getitem__, UNIT.findall(part))
        shown = [p.translate(self.shown) for p, _ in self.pre.pre_tokenize_str(part)]
        if [len(p.encode()) for p in _any_pieces().findall(part)] == list(map(len, shown)):
            return map(self.units.__getitem__, _any_units().findall(part))
        # Characters that the library's Unicode tables class otherwise: its own
        # pre-tokens, each counted from its start.
        return [np.diff([0, *self.bpe.prefix_counts(p)]).astype("<i2").tobytes() for p in shown]

    def prefix_deltas(self, text: str | None) -> np.ndarray:
        """int16 for each UTF-8 byte: their running sum is the exact count of
        tokens of the text up to there (at ends of characters)."""
        out, before = [], ""
        for part, special in self.split(text or ""):
            if special is None:
                before = part
                out += self._plain_deltas(part)
                continue
            # Inside a special string the prefix is ordinary text that runs on
            # from the segment before it: its last stretch is counted anew.
            base = before[max(before.rfind(" "), 0) :] if before.strip() else before
            base = before if len(base) < 2 or base[1:2].isspace() else base
            held = len(self.encode(base)) // 4
            inner = [len(self.encode(base + part[:k])) // 4 - held for k in range(1, len(part))]
            out.append(np.diff([0, *inner, 1]).astype("<i2").tobytes())
            before = ""
        return np.frombuffer(b"".join(out), "<i2")


def _pieces(unit: str) -> list[str]:
    if OTHER.search(unit):
        return _any_pieces().findall(unit)
    return PIECE.findall(unit)


_ANY: dict[str, object] = {}


def _any_pieces():
    import regex

    if "pieces" not in _ANY:
        _ANY["pieces"] = regex.compile(
            rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
        )
    return _ANY["pieces"]


def _any_units():
    import regex

    if "units" not in _ANY:
        dark = WHITE.replace(" ", "")
        _ANY["units"] = regex.compile(
            _units(r"\p{L}", r"\p{N}", rf"[^{_SPACE}\p{{L}}\p{{N}}]", rf"[{_SPACE}]", rf"[{dark}]")
        )
    return _ANY["units"]


_WORKER: dict[str, PairEncoder] = {}


def pair_encoder(name: str = TOKENIZER) -> PairEncoder:
    if name not in _WORKER:
        _WORKER[name] = PairEncoder(name)
    return _WORKER[name]


# Operators


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every text.

    Null text gives no ids; every input row gives one row.
    """

    def rows(batches):
        encode = pair_encoder(tokenizer).encode
        for b in batches:
            ids = [encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return _id_text(docs).mapInArrow(rows, "doc_id long, ids binary")


def decoded(ids: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and text of every row of ids; bytes that aren't UTF-8 become
    U+FFFD, as in the library."""

    def rows(batches):
        decode = pair_encoder(tokenizer).bpe.decode
        for b in batches:
            texts = [decode(np.frombuffer(x or b"", "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def _id_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def rows(batches):
        e = pair_encoder(tokenizer)
        for b in batches:
            n, sha, back = [], [], []
            for text in b.column("text").to_pylist():
                ids = e.encode(text)
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(e.bpe.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _id_text(docs).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
