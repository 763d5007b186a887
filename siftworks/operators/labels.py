"""Multi-label targets as one 0/1 column per label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_list

MAX_LABELS = 1000


def label_universe(df: DataFrame, labels: str) -> list[str]:
    """Sorted distinct labels; the column layout needs them on the driver, so their number is limited."""
    rows = df.select(F.explode(parse_list(F.col(labels))).alias("l")).distinct().limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} distinct labels")
    return sorted(r[0] for r in rows)


def binarize(df: DataFrame, labels: str, universe: Sequence[str] | None = None) -> DataFrame:
    universe = universe or label_universe(df, labels)
    cell = parse_list(F.col(labels))
    return df.withColumns({f"label_{v}": F.array_contains(cell, v).cast("int") for v in universe})
