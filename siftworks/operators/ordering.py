"""Running totals, positions and lags in a total order, without sending a whole group to one task.

The rows are range-partitioned on (group, order), so a group that holds a third of all rows is cut into
many slices. Each slice computes its own running total; what has to be carried over from earlier slices
is one number per slice, so the driver only ever sees as many rows as there are shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, shuffle_width

SLICE = "_slice"


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    group: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums of ``sums`` along ``order`` within ``group`` (order must be total)."""
    spark = df.sparkSession
    group = list(group)
    names = list(sums)
    tmp = {f"_v_{n}": F.coalesce(e.cast("double"), F.lit(0.0)) for n, e in sums.items()}
    staged = cut_lineage(
        df.withColumns(tmp)
        .repartitionByRange(shuffle_width(spark), *[F.col(g) for g in group], *order)
        .withColumn(SLICE, F.spark_partition_id())
    )
    totals = staged.groupBy(SLICE, *group).agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    entry = F.struct(*[F.col(g) for g in group], *[F.col(n) for n in names])
    edges = totals.groupBy(SLICE).agg(F.min(entry).alias("lo"), F.max(entry).alias("hi"), F.count("*").alias("k"))
    carry = _carry(edges.collect(), group, names)

    w = (
        Window.partitionBy(SLICE, *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = staged.withColumns({n: F.sum(f"_v_{n}").over(w) for n in names}).drop(*tmp)
    if not carry:
        return out.drop(SLICE)
    fields = [T.StructField("_s", T.IntegerType())]
    fields += [T.StructField(f"_g_{g}", staged.schema[g].dataType) for g in group]
    fields += [T.StructField(f"_c_{n}", T.DoubleType()) for n in names]
    small = spark.createDataFrame(carry, T.StructType(fields))
    cond = F.col(SLICE) == F.col("_s")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = out.join(F.broadcast(small), cond, "left")
    out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0.0)) for n in names})
    return out.drop(SLICE, *[f.name for f in fields])


def _carry(edges, group, names):
    """Totals that flow into the first group of each slice; one row per slice at most."""
    def key(cell):
        return tuple(cell[g] for g in group)

    edges = sorted(edges, key=lambda r: r[SLICE])
    rows, open_key, open_sum = [], None, None
    for r in edges:
        if open_key is not None and key(r["lo"]) == open_key:
            rows.append((r[SLICE], *open_key, *open_sum))
            base = open_sum if r["k"] == 1 else [0.0] * len(names)
        else:
            base = [0.0] * len(names)
        open_key = key(r["hi"])
        open_sum = [b + r["hi"][n] for b, n in zip(base, names)]
    return rows


def with_position(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "position") -> DataFrame:
    """1-based row number along ``order`` within ``group``, as a long."""
    out = running_totals(df, order, {name: F.lit(1)}, group)
    return out.withColumn(name, F.col(name).cast("long"))


def lags(
    df: DataFrame,
    value: str,
    order: Sequence[Column],
    max_lag: int = 3,
    group: Sequence[str] = (),
    block_rows: int = 500_000,
) -> DataFrame:
    """``value_lag_1..k`` within ``group``. Blocks of consecutive rows are independent: the last ``k`` rows of a
    block are repeated at the head of the next one, so a single long series is spread over many tasks."""
    pos = with_position(df, order, group, "_pos")
    block = F.floor((F.col("_pos") - 1) / F.lit(block_rows))
    near_end = (F.col("_pos") - 1) % F.lit(block_rows) >= block_rows - max_lag
    copies = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    spread = pos.withColumn("_home", block).withColumn("_block", F.explode(copies))
    w = Window.partitionBy(*group, "_block").orderBy("_pos")
    out = spread.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(w) for k in range(1, max_lag + 1)})
    return out.filter(F.col("_home") == F.col("_block")).drop("_home", "_block", "_pos")
