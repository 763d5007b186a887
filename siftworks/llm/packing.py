"""Best-fit packing with large-item matching.

Documents become token ids plus an end id; those longer than the capacity are cut into pieces of the capacity, the first
of which may be shorter. What decides a packing is only how many pieces there are of each length, so the plan is made
for counts (one number per length up to the capacity) and holds for any number of pieces:

* pieces over one third of the capacity fit at most twice into a sequence; the longest left takes the longest partner
  that still fits, which gives as few sequences for them as possible;
* shorter pieces, longest first, go into the tightest gap that holds them; a new sequence is opened when none does.

The plan is a ledger of (length, first rank, count, first sequence, offset). Spark numbers the pieces within their
length by buckets, so that no length is numbered by one task, and looks their places up in the ledger.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices
from .tokens import encoder

CAPACITY = 1024
END_ID = 2
#: Pieces that one task numbers at a time.
BUCKET = 5_000

LEDGER = "length long, first_rank long, n long, first_sequence long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32. A NULL text counts as empty: the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches):
            rows = []
            for row, t in enumerate(batch.column(1).to_pylist()):
                ids = np.append(enc.ids(t), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                for i, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = 0 if i == 0 else end - capacity
                    rows.append((row, i, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            at, *columns = zip(*rows, strict=True)
            # the key stays an Arrow column: as numbers of numpy, ids beside a NULL would lose their last digits
            made = [batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
            yield pa.RecordBatch.from_arrays(made, names=[key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Ledger rows for so many pieces of each length. Its size depends on the capacity, not on the counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    placed = dict.fromkeys(left, 0)
    ledger: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        ledger.append((length, placed[length], n, sequence, offset))
        placed[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in (x for x in large if x <= min(a, capacity - a)):
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                put(a, n, opened, 0)
                put(b, n, opened, a)
                gaps.setdefault(capacity - a - b, []).append((opened, n))
                opened += n
        if left[a]:
            gaps.setdefault(capacity - a, []).append((opened, left[a]))
            n = left[a]
            put(a, n, opened, 0)
            opened += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g in gaps if g >= s and gaps[g]), default=None)
            if gap is None:
                fits = capacity // s
                gaps.setdefault(capacity, []).append((opened, -(-left[s] // fits)))
                opened += gaps[capacity][-1][1]
                continue
            first, n = gaps[gap].pop()
            each = min(gap // s, left[s])
            filled = min(n, left[s] // each)
            if filled < n:
                gaps[gap].append((first + filled, n - filled))
            for i in range(each):
                put(s, filled, first, capacity - gap + i * s)
            gaps.setdefault(gap - each * s, []).append((first, filled))
    return ledger


def ranked(df: DataFrame, bucket_rows: int = BUCKET, key: str = "doc_id") -> DataFrame:
    """Numbers rows within their length from 0. Lengths are numbered bucket by bucket; a bucket starts where the counts
    of the buckets before it end."""
    buckets = max(1, df.count() // bucket_rows)
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select(
        "length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("length", "_bucket").orderBy(key, "piece", "start", "ids_crc32")
    return (
        spread.withColumn("_rank", F.row_number().over(within) - 1)
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .drop("_bucket", "_before")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their place: key, piece, start, length, ids_crc32, sequence_id, offset.

    NULL and empty texts are packed as the end id alone. Rows that repeat are packed as often as they stand. Ties between
    pieces of one length go by key. Texts of any length are encoded whole. An empty table gives an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    numbered = cut_lineage(pieces(docs, tokenizer, capacity, end_id, key, text))
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ledger = spark.createDataFrame(plan(counts, capacity), LEDGER)
    place = ledger.select(F.col("length").alias("_length"), "first_rank", F.col("n").alias("_n"), "first_sequence", "offset")
    rank = F.col("_rank")
    return (
        ranked(numbered, key=key)
        .join(
            F.broadcast(place),  # bounded by the capacity, not by the data
            (F.col("length") == F.col("_length")) & (rank >= F.col("first_rank")) & (rank < F.col("first_rank") + F.col("_n")),
        )
        .select(key, "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + rank - F.col("first_rank")).alias("sequence_id"), "offset")
    )
