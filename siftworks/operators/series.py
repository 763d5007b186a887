"""Lag features and the last-value forecast of a time-ordered target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import long_metrics, regression_metrics
from .ordering import lags
from .sampling import time_ordered_blocks

MAX_LAG = 3


def lag_frame(df: DataFrame, target: str, time: str, tiebreak: Sequence[str], group: Sequence[str] = (), max_lag: int = MAX_LAG) -> DataFrame:
    """Lags 1..k of the numeric target in time order (unparseable times first); rows with any NULL are dropped."""
    timed = df.withColumn(target, F.expr(f"try_cast(`{target}` AS double)")).withColumn(
        "_t", F.try_to_timestamp(F.col(time).cast("string")))
    order = [F.col("_t").asc_nulls_first(), *[F.col(c) for c in tiebreak]]
    return lags(timed, target, order, max_lag, group).drop("_t").dropna()


def naive_forecast(frame: DataFrame, target: str, order: Sequence[str], k: int | None = None) -> DataFrame:
    """Errors of 'next = last value' on expanding-window splits, averaged over the folds."""
    blocks = time_ordered_blocks(frame, [F.col(c) for c in order], k).filter("block > 0")
    folds = regression_metrics(blocks, ["block"], target, f"{target}_lag_1").filter("metric <> 'r2'")
    return folds.groupBy("metric").agg(F.avg("value").alias("value"))
