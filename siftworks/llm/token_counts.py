"""Token counts by section: each document is encoded once, and its tokens are attributed by their character spans.

A section is a half-open character interval of the text. Tokens and sections are both sorted by start, so the interval
join of a document is one merge of two sorted arrays. Rule for a token that crosses a boundary: it counts for the
section in which its first character stands; a token that holds only tail bytes of a character counts where that
character stands. So the counts of a document's sections always add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .tokens import encoder


def line_starts(text: str) -> np.ndarray:
    """Sections by line; the line break belongs to the line it ends."""
    lengths = [len(x) + 1 for x in text.split("\n")]
    if lengths[-1] == 1 and len(lengths) > 1:
        lengths.pop()
    return np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, n_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them reach into a later section."""
    begins = np.concatenate([[0], ends[:-1]])
    begins = np.where(ends > begins, begins, np.maximum(ends - 1, 0))  # tail bytes stand with their character
    owner = np.searchsorted(starts, begins, side="right") - 1
    section_end = np.append(starts[1:], n_chars)
    counts = np.bincount(owner, minlength=len(starts))
    crossing = np.bincount(owner[ends > section_end[owner]], minlength=len(starts))
    return counts, crossing


def count_by_section(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section: key, section, start_char, end_char, n_tokens, n_crossing.

    A NULL or empty text has one empty section without tokens. Texts of any length are encoded whole. Repeated rows give
    repeated results; other columns are not read; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches):
            out = []
            for t in batch.column(1).to_pylist():
                t = t or ""
                starts = line_starts(t)
                ends = enc.ends(t)
                counts, crossing = attribute(ends, starts, len(t)) if len(ends) else (np.zeros(len(starts), np.int64),) * 2
                out.append((starts, np.append(starts[1:], len(t)), counts, crossing))
            sizes = [len(x[0]) for x in out]
            at = pa.array(np.repeat(np.arange(len(out)), sizes))
            section = pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]))
            # the key stays an Arrow column: as numbers of numpy, ids beside a NULL would lose their last digits
            made = [batch.column(0).take(at), section, *(pa.array(np.concatenate([x[i] for x in out]).astype(np.int64)) for i in range(4))]
            yield pa.RecordBatch.from_arrays(made, names=[key, "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, section int, start_char long, end_char long, n_tokens long, n_crossing long")
