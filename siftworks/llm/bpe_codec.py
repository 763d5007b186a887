"""Byte-level BPE by backtracking over longest matches, and its inverse.

A file of ranks says which byte strings are tokens; joining the adjacent pair of lowest rank again and again gives the
tokens of a piece of text. The same tokens come out without any joining:

* The bytes of a piece, read as Latin-1 characters, meet an Aho-Corasick automaton of the tokens, which names the longest
  token from a byte on.
* Where the longest tokens from left to right are all compatible with their neighbours, they are the ids at once. Two
  tokens are compatible if joining would not have made another token across their border.
* Else the search goes on from the first border that does not stand: the next shorter prefix of the token is tried, and if
  none is left the token before it is taken back. A position that failed once is never entered again, so the steps grow
  with the bytes.
* Compatibility undoes the joins of both tokens from the last to the first and looks for a join across the border that
  would have come earlier. It depends on the two tokens alone and is remembered for the pairs met lately.

A piece that is itself a token is that token. The text is cut into pieces by the tokenizer's pattern. Letters and numbers
of later Unicode versions than Python's are told apart by asking ``tiktoken`` itself.

Rows: a NULL or empty text has no ids and decodes to no bytes. A row's result depends on its text alone, so repeated rows,
ties and NULL keys need no rule; keys of any type pass through untouched. Whole texts of any length are encoded, a piece
without a break as well, in time that grows with its bytes. Other columns are not read, so their names cannot clash. An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import slices

#: White space of the pattern's \s, as a character class.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs without white space with the space before them, and white space up to the last of it before such a run. No match
#: of the pattern reaches over their borders.
_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Longest piece whose ids are remembered.
MEMO_CHARS = 64


class Recent(dict):
    """Values of the keys met lately: at most twice ``limit`` of them, whatever the input. Longer keys than ``longest`` are
    worked out each time."""

    def __init__(self, value: Callable, limit: int, longest: int = MEMO_CHARS):
        super().__init__()
        self.value, self.limit, self.longest, self.old = value, limit, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.value(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Codec:
    """Ids of texts and bytes of ids for a file of ranks and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.source = pattern
        self.ranks = ranks
        self.halves: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.reach = max(self.size.values())
        self.longest = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.longest.add_word(token.decode("latin-1"), i)
            self.shorter[i] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), None)
            if len(token) > 1:
                pair = self._last_join(token)
                if pair is not None:
                    if max(pair) >= i:
                        raise ValueError(f"token {i} ranks before a part of it")
                    self.halves[i] = pair
                    self.joins[pair] = i
        self.longest.make_automaton()
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.compatible = Recent(self._compatible, 300_000)
        self.pieces = Recent(self._piece, 50_000)
        self.chunks = Recent(self._chunk, 500_000)
        self.kinds = Recent(self._kind, 10_000)

    def _last_join(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that are joined last where the token's bytes stand alone; None if joining stops before."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 62), k) for k in range(len(parts) - 1))
            if rank == 1 << 62:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether joining leaves the border between two adjacent tokens alone."""
        left, right = pair
        if left < 0:  # nothing stands before
            return True
        before = 1 << 62  # joins across the border from this rank on come too late
        while True:
            if self.joins.get((left, right), 1 << 62) < before:
                return False
            undo_left = left > right
            made = left if undo_left else right
            if made not in self.halves:  # a single byte: nothing to undo on this side, go on with the other
                undo_left = not undo_left
                made = left if undo_left else right
                if made not in self.halves:
                    return True
            if undo_left:
                before, left = made, self.halves[made][1]
            else:
                before, right = made + 1, self.halves[made][0]

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece's bytes."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        text, longest, compatible, shorter, size = piece.decode("latin-1"), self.longest.iter_long, self.compatible, self.shorter, self.size
        out = [i for _, i in longest(text)]  # every byte is a token, so the matches leave no gap
        for stands, ok in enumerate(map(compatible.__getitem__, pairwise(out)), 1):
            if not ok:
                break
        else:
            return out
        n, reach, open_ = len(piece), self.reach, bytearray(b"\1") * (len(piece) + 1)
        token: int | None = out[stands]
        del out[stands:]
        at, last = sum(map(size.__getitem__, out)), out[-1]
        while True:
            while token is not None and not (open_[at + size[token]] and compatible[last, token]):
                token = shorter[token]
            if token is None:  # nothing fits here: the token before has to be another one
                open_[at] = 0
                token = out.pop()
                at -= size[token]
                token = shorter[token]
                last = out[-1] if out else -1
                continue
            out.append(token)
            last = token
            at += size[token]
            if at == n:
                return out
            token = next(longest(text[at : at + reach]))[1]

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(self.merged(piece.encode()))

    def _kind(self, char: str) -> str:
        """A letter, digit or mark that the pattern treats like this character."""
        ranks = {bytes([b]): b for b in range(256)} | {f"x{char}".encode(): 256, f"1{char}".encode(): 257}
        ask = tiktoken.Encoding("ask", pat_str=self.source, mergeable_ranks=ranks, special_tokens={})
        return "a" if ask.encode_ordinary(f"x{char}") == [256] else "1" if ask.encode_ordinary(f"1{char}") == [257] else "!"

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha():
            return tuple(self.merged(chunk.encode()))
        unknown = () if chunk.isascii() else {c for c in chunk if unicodedata.category(c) == "Cn"}
        shape = chunk.translate({ord(c): self.kinds[c] for c in unknown}) if unknown else chunk
        return tuple(chain.from_iterable(self.pieces[chunk[m.start() : m.end()]] for m in self.pattern.finditer(shape)))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.chunks.__getitem__, _CHUNK.findall(text or ""))))


_CODECS: dict[tuple[str, str], Codec] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker, file and pattern."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(ranks_of(path), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array<int>) of every whole text. ``ranks`` is a file on every machine, as tokenizers are installed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(ranks, pattern)
        for batch in slices(batches, 64):
            ids = pa.array([enc.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def bytes_of_lists(ids: pa.ListArray, token: pa.LargeBinaryArray) -> pa.Array:
    """The bytes of each list of ids, as places in ``token``: the tokens of all lists are laid end to end, and a list's bytes
    are what lies between its first and last."""
    laid = token.take(ids.flatten())
    ends = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1]
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[np.append(0, np.cumsum(sizes))]), laid.buffers()[2]]).cast(pa.binary())


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids and their bytes (decoded). NULL ids decode to no bytes; an id outside the file is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {i: b for b, i in ranks_of(ranks).items()}
        token = pa.array([of.get(i) for i in range(max(of) + 1)], pa.large_binary())
        for batch in slices(batches, 64):
            found = bytes_of_lists(batch.column(1), token)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=[key, ids, "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>, decoded binary")
