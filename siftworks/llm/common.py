"""Helpers the operators share: words in SQL, shingle hashes in numpy, the query registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space between words: space and \x09-\x0D, as the contracts define words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for NULL or blank texts."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_CLASS + "+"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows in the Arrow batches of jobs run inside, for rows that hold whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def counted(df: DataFrame, at_most: int) -> bool:
    """Whether a frame has at most so many rows, found without reading more of it than needed."""
    return df.limit(at_most + 1).count() <= at_most


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()
#: Odd multiplier of the polynomial over word hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words hashed in one go.
_CHUNK_WORDS = 50_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small parts, so that few rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def shingle_sets(texts: Iterable[bytes | str | None], size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles, A-Z lower-cased. A text with fewer words gives
    one shingle, a text without words none. Bytes are split at space and \\x09-\\x0D, which is what bytes.split() does.
    Several texts are hashed together; shingles that reach into the next text are left out."""
    held: list[list[bytes]] = []
    n = 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b""
        held.append(raw.lower().split())
        n += len(held[-1])
        if n > _CHUNK_WORDS:
            yield from _hashed(held, n, size)
            held, n = [], 0
    yield from _hashed(held, n, size)


def _hashed(held: list[list[bytes]], n: int, size: int) -> Iterator[np.ndarray]:
    h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(held)), np.uint64, n)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * _BASE + h[k : k + len(rolled)]
    rolled = mixed(rolled)
    at = 0
    for words in held:
        k = len(words)
        if k >= size:
            s = np.sort(rolled[at : at + k - size + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        else:
            short = np.zeros(min(k, 1), np.uint64)
            for x in h[at : at + k]:
                short = short * _BASE + x
            yield mixed(short + np.uint64(k))
        at += k


def shingle_set(text: bytes | str | None, size: int = 5) -> np.ndarray:
    return next(shingle_sets([text], size))
