"""Pairwise association rules over transactions in long form (txn, item)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import clean_number, exact_quantiles
from .rows import side_by_side

# Basket delimiters, minimum support share, weights of the composite quality.
DELIMITERS = ("|", ";", ",")
SUPPORT_SHARE = 0.05
WEIGHTS = {"confidence": 0.3, "lift": 0.25, "support": 0.2, "coverage": 0.2, "count": 0.05}
WANTED_RULES = 20
MIN_TRANSACTIONS = 5


def basket_column(df: DataFrame, sample: int = 200) -> tuple[str, str] | None:
    """First string column where at least max(5, half) of the first 200 values hold a delimiter."""
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.StringType):
            continue
        head = df.filter(F.col(f.name).isNotNull()).select(f.name).limit(sample)
        row = head.agg(F.count("*").alias("n"), *[
            F.count_if(F.contains(F.col(f.name), F.lit(d))).alias(f"d{i}") for i, d in enumerate(DELIMITERS)]).first()
        for i, d in enumerate(DELIMITERS):
            if row["n"] and row[f"d{i}"] >= max(5, int(0.5 * row["n"])):
                return f.name, d
    return None


def delimited_items(df: DataFrame, txn: str, col: str, delimiter: str) -> DataFrame:
    parts = F.transform(F.split(F.col(col), f"\\Q{delimiter}\\E"), lambda v: F.trim(v))
    return df.select(F.col(txn).alias("txn"), F.explode(F.array_distinct(parts)).alias("item")).filter("item <> ''")


def bin_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Bins per numeric column: as many as it has distinct values, at most four; none below four values."""
    if not cols:
        return {}
    low_high = lambda v: [F.min(v).alias("lo"), F.max(v).alias("hi")]
    ends = df.agg(*[F.struct(F.count(clean_number(c)).alias("n"), *low_high(clean_number(c))).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    between = []
    for i, c in enumerate(cols):
        lo, hi = (F.lit(ends[f"v{i}"][k]).cast("double") for k in ("lo", "hi"))
        inner = F.when((clean_number(c) > lo) & (clean_number(c) < hi), clean_number(c))
        between.append(F.struct(*low_high(inner)).alias(f"v{i}"))
    inside = df.agg(*between).first()
    out = {}
    for i, c in enumerate(cols):
        outer, inner = ends[f"v{i}"], inside[f"v{i}"]
        distinct = len({outer["lo"], outer["hi"], inner["lo"], inner["hi"]} - {None})
        out[c] = distinct if outer["n"] >= 4 else 0
    return out


def quartile_labels(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Numeric columns as right-closed intervals of equal counts, four or one per distinct value; repeated edges collapse,
    missing values read 'nan'. Columns with fewer than four values are rounded instead."""
    bins, cuts = bin_counts(df, cols), {}
    for k in set(bins.values()):
        mine = [c for c in cols if bins[c] == k]
        cuts |= exact_quantiles(df, mine, [i / k for i in range(k + 1)]) if k else {c: [] for c in mine}
    out = {}
    for c in cols:
        x = clean_number(c)
        edges = sorted({v for v in cuts[c] if v is not None})
        label = F.when(x.isNull(), F.lit("nan"))
        if len(edges) < 2:
            out[c] = label.otherwise(F.round(x, 2).cast("string"))
            continue
        for lo, hi in zip(edges, edges[1:]):
            label = label.when(x <= F.lit(hi), F.lit(f"({lo}, {hi}]"))
        out[c] = label
    return out


def row_items(df: DataFrame, txn: str, cols: Sequence[str]) -> DataFrame:
    """Rows as transactions of ``column=value`` items, numerics binned to quartiles; missing categories are skipped."""
    num = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    binned = quartile_labels(df, num)
    items = F.array_compact(F.array(*[
        F.concat(F.lit(f"{c}="), binned[c] if c in binned else F.col(c).cast("string")) for c in cols]))
    return df.select(F.col(txn).alias("txn"), F.explode(items).alias("item"))


def mine_rules(baskets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, summary). A pair can only be frequent if both items are, so baskets are cut to frequent items
    before pairs are formed: at most (mean basket size / 0.05) items survive, however large one basket is. Fewer than
    MIN_TRANSACTIONS transactions have no rules, and every measure is 0."""
    baskets = baskets.distinct()
    n = baskets.select("txn").distinct().count()
    floor = max(2, int(round(SUPPORT_SHARE * n))) if n >= MIN_TRANSACTIONS else n + 1
    items = baskets.groupBy("item").agg(F.count("*").alias("n_item"))
    frequent = items.filter(F.col("n_item") >= floor)
    kept = baskets.join(frequent.select("item"), "item", "left_semi")
    sets = kept.groupBy("txn").agg(F.array_sort(F.collect_set("item")).alias("s"))
    pair = F.flatten(F.transform("s", lambda x, i: F.transform(
        F.slice("s", i + 2, F.greatest(F.size("s") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    counts = sets.filter(F.size("s") > 1).select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n_pair"))
    counts = counts.filter(F.col("n_pair") >= floor)
    na = frequent.select(F.col("item").alias("a"), F.col("n_item").alias("na"))
    nb = frequent.select(F.col("item").alias("b"), F.col("n_item").alias("nb"))
    both = counts.join(na, "a").join(nb, "b")
    rules = both.select(F.inline(F.array(
        F.struct(F.col("a").alias("lhs"), F.col("b").alias("rhs"), F.col("n_pair"), F.col("na").alias("n_lhs"), F.col("nb").alias("n_rhs")),
        F.struct(F.col("b").alias("lhs"), F.col("a").alias("rhs"), F.col("n_pair"), F.col("nb").alias("n_lhs"), F.col("na").alias("n_rhs")),
    )))
    total = F.lit(float(max(n, 1)))
    rules = rules.withColumns({
        "support": F.col("n_pair") / total,
        "confidence": F.col("n_pair") / F.col("n_lhs"),
        "lift": (F.col("n_pair") / F.col("n_lhs")) / (F.col("n_rhs") / total),
    })
    covered = kept.join(rules.select(F.col("lhs").alias("item")).distinct(), "item", "left_semi").select("txn").distinct()
    summary = side_by_side(rules.agg(
        F.count("*").alias("number_of_rules"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in ("support", "confidence", "lift")],
    ), covered.agg((F.count("*") / total).alias("coverage")))
    count_score = F.exp(-F.abs(F.col("number_of_rules") - WANTED_RULES) / float(WANTED_RULES))
    quality = (
        WEIGHTS["confidence"] * F.col("confidence") + WEIGHTS["lift"] * F.col("lift") / (F.col("lift") + 1)
        + WEIGHTS["support"] * F.col("support") + WEIGHTS["coverage"] * F.col("coverage") + WEIGHTS["count"] * count_score
    )
    return rules, summary.withColumn("rule_quality", F.when(F.col("number_of_rules") > 0,F.least(F.lit(1.0), quality)).otherwise(F.lit(0.0)))
