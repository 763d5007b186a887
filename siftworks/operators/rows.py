"""One-row results put side by side without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*parts: DataFrame) -> DataFrame:
    """All columns of several one-row frames in one row."""
    stacked = None
    for i, p in enumerate(parts):
        boxed = p.select(F.struct(*[F.col(f"`{c}`") for c in p.columns]).alias(f"p{i}"))
        stacked = boxed if stacked is None else stacked.unionByName(boxed, allowMissingColumns=True)
    one = stacked.agg(*[F.first(f"p{i}", ignorenulls=True).alias(f"p{i}") for i in range(len(parts))])
    return one.select(*[f"p{i}.*" for i in range(len(parts))])
