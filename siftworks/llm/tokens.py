"""Byte-level BPE ids of whole texts, fast enough for a corpus.

The split pattern of the tokenizer always cuts before a space that a non-space follows, and around a line break between
two non-spaces. So a text whose white space never stands side by side is the concatenation of its space-separated
pieces, and the ids of a piece can be remembered. Other texts are encoded in one go. Both ways give the ids of the
``tokenizers`` library for the same vocabulary; the tests compare them text by text.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    """The pattern that goes with the files of ranks."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_of_symbol() -> dict[str, int]:
    """The printable symbol that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Values of the pieces seen lately. A piece stands after a space unless it starts with a line break."""

    LIMIT = 300_000

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        out = self[piece] = self.value(piece if piece[:1] == "\n" else " " + piece)
        return out


class Encoder:
    """Ids and character lengths of tokens for one ``tokenizers`` vocabulary file with the usual byte-level pattern."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        byte_of = _byte_of_symbol()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bpe = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.id_pieces = _Pieces(lambda piece: tuple(self.bpe.encode_ordinary(piece)))
        self.span_pieces = _Pieces(lambda piece: self._lengths(self.bpe.encode_ordinary(piece)))

    def _lengths(self, ids) -> tuple[int, ...]:
        """Characters that start in each token. A token that holds only the tail bytes of a character has none."""
        return tuple(sum(b & 0xC0 != 0x80 for b in self.bytes_of[i]) for i in ids)

    def _plain(self, text: str) -> bool:
        side_by_side = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        return not side_by_side and not text[0].isspace() and not text[-1].isspace()

    def _has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self._has_special(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        if not self._plain(text):
            return np.array(self.bpe.encode_ordinary(text), np.uint32)
        first, *rest = text.replace("\n", " \n").split(" ")
        flat = self.bpe.encode_ordinary(first)
        flat.extend(chain.from_iterable(map(self.id_pieces.__getitem__, rest)))
        return np.array(flat, np.uint32)

    def ends(self, text: str | None) -> np.ndarray:
        """For every token, how many characters of the text have started up to its end."""
        if not text:
            return np.empty(0, np.int64)
        if self._has_special(text):
            got = self.whole.encode(text, add_special_tokens=False)
            return np.maximum.accumulate(np.array([b for _, b in got.offsets], np.int64))
        if not self._plain(text):
            return np.cumsum(np.array(self._lengths(self.bpe.encode_ordinary(text)), np.int64))
        first, *rest = text.replace("\n", " \n").split(" ")
        flat = list(self._lengths(self.bpe.encode_ordinary(first)))
        flat.extend(chain.from_iterable(map(self.span_pieces.__getitem__, rest)))
        return np.cumsum(np.array(flat, np.int64))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
