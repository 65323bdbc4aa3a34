"""Token ids of whole texts, as the tokenizers library gives them.

Byte-level BPE acts inside pre-tokens, so a task remembers the ids of each
pre-token it has met and asks the library only for new ones.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
#: Pre-tokens a Python worker remembers before it starts anew, and the longest
#: of them, so that what it holds is bounded in bytes too.
REMEMBERED, LONGEST = 1 << 18, 64

# The byte-level pre-token pattern, for texts whose characters
# are all in the ranges below (there \w and \d agree with \p{L} and \p{N}).
PIECE = re.compile(
    r"""'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
)
PLAIN = (
    "\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏЀ-ҁҊ-ԓ"
    "‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣"
)
OTHER = re.compile(f"[^{PLAIN}]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """A path is taken as it is; a plain name is a file of public_tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(hidden)}

#: Arrays of C's unsigned int are what the ids are written as.
NATIVE = array("I").itemsize == 4 and array("I", [1]).tobytes() == b"\1\0\0\0"


class Remembered(dict):
    """piece -> make(piece), emptied when it holds too many; long pieces are
    made each time."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece):
        if isinstance(piece, str) and len(piece) > LONGEST:
            return self.make(piece)
        if len(self) >= self.most:
            self.clear()
        self[piece] = value = self.make(piece)
        return value


class LibraryEncoder:
    """encode(text) -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")
        )
        self.model, self.chars = self.library.model, byte_chars()
        self.ascii = {b: c for b, c in self.chars.items() if b < 128}
        self.pieces = Remembered(self._piece)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            shown = piece.translate(self.ascii)
        else:
            shown = piece.encode().decode("latin-1").translate(self.chars)
        ids = array("I", [t.id for t in self.model.tokenize(shown)])
        return (ids if NATIVE else np.array(ids, dtype="<u4")).tobytes()

    def forget(self) -> None:
        self.pieces.clear()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_piece and not OTHER.search(text) and not any(s in text for s in self.special):
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(name: str = TOKENIZER) -> LibraryEncoder:
    """This Python worker's encoder."""
    if name not in _ENCODERS:
        _ENCODERS[name] = LibraryEncoder(name)
    return _ENCODERS[name]


def forgetting(rows, name: str = TOKENIZER):
    """rows(batches) for mapInArrow; what the encoder remembered goes when the
    task ends, as its worker is kept for other work."""

    def task(batches):
        try:
            yield from rows(batches)
        finally:
            encoder(name).forget()

    return task
