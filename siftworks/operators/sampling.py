"""Folds, splits, class weights and oversampling, all decided per row from keys rather than task layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import with_position

SEED = 42
MAX_FOLDS = 5


def shuffle_key(key: str | Column, seed: int = SEED) -> Column:
    return F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(seed))


def fold_count(df: DataFrame, target: str, max_folds: int = MAX_FOLDS) -> int:
    smallest = df.groupBy(target).count().agg(F.min("count")).first()[0]
    k = min(max_folds, smallest or 0)
    if k < 2:
        raise ValueError("each class needs at least two rows for a stratified evaluation")
    return k


def stratified_folds(df: DataFrame, target: str, order: Sequence[Column], k: int) -> DataFrame:
    """Rows of every class dealt round-robin to ``k`` folds."""
    out = with_position(df, order, [target], "_pos")
    return out.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_pos")


def hashed_folds(df: DataFrame, key: str, k: int = MAX_FOLDS, seed: int = SEED) -> DataFrame:
    """k-fold by key hash: no shuffle at all."""
    return df.withColumn("fold", F.pmod(shuffle_key(key, seed), F.lit(k)).cast("int"))


def time_ordered_blocks(df: DataFrame, order: Sequence[Column], k: int | None = None) -> DataFrame:
    """Expanding-window split: ``block`` 0 is train-only, block i is the test part of fold i and the
    train part of every later fold."""
    pos = with_position(df, order, name="_pos")
    n = pos.count()
    k = k or min(5, max(2, n // 5))
    size = n // (k + 1)
    first_test = n - k * size
    block = F.when(F.col("_pos") <= first_test, F.lit(0)).otherwise(
        F.floor((F.col("_pos") - 1 - first_test) / F.lit(size)) + 1)
    return pos.withColumn("block", block.cast("int")).drop("_pos")


def stratified_holdout(df: DataFrame, target: str | None, key: str, share: float = 0.25, seed: int = SEED) -> DataFrame:
    """``is_test`` for a share of every class, by hash order; without a target, by hash order overall. Only keys are put in
    order: a row is a test row up to the last key of its class's test rows. Where rows on both sides share that key, the
    whole rows are put in order."""
    order = [shuffle_key(key, seed), F.col(key)]
    group = [target] if target else []

    def marked(rows: DataFrame) -> DataFrame:
        pos = with_position(rows, order, group, "_pos")
        if target:
            sizes = rows.groupBy(target).agg(F.count("*").alias("_size"))
            pos = pos.join(F.broadcast(sizes), target)  # a join by class would put a frequent class into one task
        else:
            pos = pos.withColumn("_size", F.lit(rows.count()))
        cut = F.greatest(F.lit(1), F.round(F.col("_size") * share))
        return pos.withColumn("is_test", (F.col("_pos") <= cut) & (F.col("_size") > 1)).drop("_pos", "_size")

    place = F.struct(*order)
    edges = marked(df.select(*dict.fromkeys([*group, key]))).groupBy(*group).agg(
        F.max(F.when(F.col("is_test"), place)).alias("_last"), F.min(F.when(~F.col("is_test"), place)).alias("_next"))
    edges = cut_lineage(edges)
    if not edges.filter(F.col("_last") >= F.col("_next")).isEmpty():
        return marked(df)
    last = F.broadcast(edges.drop("_next"))
    out = df.join(last, target) if target else df.crossJoin(last)
    return out.withColumn("is_test", F.coalesce(place <= F.col("_last"), F.lit(False))).drop("_last")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight n / (classes * class size) per class."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k")).first()
    return counts.withColumn("weight", F.lit(float(total["total"])) / (F.lit(total["k"]) * F.col("n")))


def oversample(df: DataFrame, target: str, key: str, seed: int = SEED) -> DataFrame:
    """Every class brought to the majority size by repeating rows: each row is repeated floor(majority/n)
    times and the rows that come first in hash order once more. ``copy`` is 0 for the original."""
    counts = df.groupBy(target).agg(F.count("*").alias("_n"))
    majority = counts.agg(F.max("_n")).first()[0]
    pos = with_position(df, [shuffle_key(key, seed), F.col(key)], [target], "_pos")
    repeats = F.floor(F.lit(majority) / F.col("_n")) + F.when(
        F.col("_pos") <= F.lit(majority) % F.col("_n"), F.lit(1)).otherwise(F.lit(0))
    return (
        pos.join(F.broadcast(counts), target)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), (repeats - 1).cast("int"))))
        .drop("_pos", "_n")
    )


def profile_sample(df: DataFrame, key: str, size: int = 500, seed: int = SEED) -> DataFrame:
    """The sampling operator of media profiles: a fixed number of rows by key hash."""
    return df.orderBy(shuffle_key(key, seed), key).limit(size)
