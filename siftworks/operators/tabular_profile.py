"""Column and dataset profile of a table.

All columns are profiled together: one aggregation for counts and moments, one for quantiles, one second look
that needs the quantiles, and one job each for duplicates, cardinality and the target. Results that leave the
executors are one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .correlations import pairwise_correlations
from .quantiles import clean_number, exact_quantiles

# Thresholds of the profile flags.
HIGH_MISSING = 0.50
MANY_MISSING = 0.10
MANY_OUTLIERS = 0.05
HIGH_SKEW = 1.0
HIGH_KURTOSIS = 3.0
HIGH_CARDINALITY = 20
NEAR_CONSTANT = 0.95
HIGH_CORRELATION = 0.85
SPARSE = 0.5
IMBALANCED = 1.5
HIGHLY_IMBALANCED = 3.0


def split_columns(df: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """Numeric and other feature columns; booleans and timestamps count as categorical."""
    fields = [f for f in df.schema.fields if f.name != target]
    num = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return num, [f.name for f in fields if f.name not in num]


def is_missing(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def _long(one_row: DataFrame, entries: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*entries)))


def missing_ratios(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    one = df.agg(*[F.avg(is_missing(df, c).cast("int")).alias(f"m{i}") for i, c in enumerate(cols)])
    return _long(
        one,
        [
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"m{i}").alias("missing_ratio"),
                (F.col(f"m{i}") > HIGH_MISSING).alias("high_missing"),
            )
            for i, c in enumerate(cols)
        ],
    )


def bias_corrected_skew(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.lit(0.0))


def bias_corrected_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).otherwise(F.lit(0.0))


def _shape(c: str) -> list[Column]:
    """Count, zero share, skewness, kurtosis."""
    x = clean_number(c)
    return [
        F.count(x), F.coalesce(F.avg((x == 0).cast("int")), F.lit(0.0)),
        F.coalesce(F.nanvl(bias_corrected_skew(x), F.lit(0.0)), F.lit(0.0)),
        F.coalesce(F.nanvl(bias_corrected_kurtosis(x), F.lit(0.0)), F.lit(0.0)),
    ]


def numeric_shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, zero share, skewness and excess kurtosis of every column in one aggregation."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [v.alias(f"{k}{i}") for k, v in zip("nzsk", _shape(c))]
    return _long(
        df.agg(*aggs),
        [
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"n{i}").alias("n"),
                F.col(f"z{i}").alias("zero_ratio"),
                F.col(f"s{i}").alias("skew"),
                F.col(f"k{i}").alias("kurt"),
            )
            for i, c in enumerate(cols)
        ],
    )


def iqr_bounds(quartiles: Sequence[float | None]) -> tuple[float, float] | None:
    q1, q3 = quartiles[0], quartiles[-1]
    if q1 is None:
        return None
    spread = 1.5 * (q3 - q1)
    return q1 - spread, q3 + spread


def _outlier_share(c: str, quartiles: Sequence[float | None]) -> Column:
    if quartiles[0] is None or quartiles[0] == quartiles[-1]:
        return F.max(F.lit(0.0))
    x, (lo, hi) = clean_number(c), iqr_bounds(quartiles)
    return F.when(F.count(x) >= 4, F.avg(((x < lo) | (x > hi)).cast("int"))).otherwise(F.lit(0.0))


def outlier_ratios(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of non-null values outside the IQR fences; 0 for fewer than 4 values or a zero IQR."""
    quart = exact_quantiles(df, cols, [0.25, 0.75])
    aggs, entries = [], []
    for i, c in enumerate(cols):
        q1, q3 = quart[c]
        aggs.append(_outlier_share(c, quart[c]).alias(f"o{i}"))
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(q1).cast("double").alias("q1"),
                F.lit(q3).cast("double").alias("q3"),
                F.col(f"o{i}").alias("outlier_ratio"),
            )
        )
    return _long(df.agg(*aggs), entries)


def _value_mark(c: str) -> Column:
    """52-bit value hash, exact as a double; NULL is a value of its own."""
    return F.shiftrightunsigned(F.xxhash64(F.col(c)), 12).cast("double")


def dominant_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Constant and near-constant columns, NULL counted as a value.

    A value with more than half of the rows always covers the median of the hashes, so its hash comes out of a
    fixed-size sketch and its share out of a second aggregation. No value is shuffled, however many there are.
    """
    cand = df.agg(*[_middle_mark(c).alias(f"h{i}") for i, c in enumerate(cols)]).first()
    one = df.agg(*[_mark_share(c, cand[f"h{i}"]).alias(f"t{i}") for i, c in enumerate(cols)])
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"t{i}") >= NEAR_CONSTANT, F.col(f"t{i}")).alias("top_share"),
                 _constancy(F.col(f"t{i}")).alias("kind"))
        for i, c in enumerate(cols)
    ]
    return _long(one, entries)


def _middle_mark(c: str) -> Column:
    return F.percentile_approx(_value_mark(c), 0.5, 1000)


def _mark_share(c: str, mark: float | None) -> Column:
    return F.avg((_value_mark(c) == F.lit(mark)).cast("int"))


def _constancy(share: Column) -> Column:
    return F.when(share.isNull() | (share >= 1.0), "constant").when(share >= NEAR_CONSTANT, "near_constant").otherwise("varied")


def binary_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric columns with exactly two values: every value equals the minimum or the maximum."""
    ends = df.agg(
        *[F.min(clean_number(c)).alias(f"a{i}") for i, c in enumerate(cols)],
        *[F.max(clean_number(c)).alias(f"b{i}") for i, c in enumerate(cols)],
    ).first()
    aggs, entries = [], []
    for i, c in enumerate(cols):
        aggs.append(_between_ends(c, ends[f"a{i}"], ends[f"b{i}"]).alias(f"i{i}"))
        entries.append(F.struct(F.lit(c).alias("column_name"), (F.col(f"i{i}") == 0).alias("is_binary")))
    return _long(df.agg(*aggs), entries)


def _between_ends(c: str, low: float | None, high: float | None) -> Column:
    """Values strictly between the extremes; 1 when the extremes do not differ."""
    if low is None or low == high:
        return F.max(F.lit(1))
    x = clean_number(c)
    return F.count(F.when((x > F.lit(low)) & (x < F.lit(high)), x))


def cardinality(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    count = (lambda c: F.approx_count_distinct(c, 0.02)) if approximate else F.count_distinct
    one = df.agg(*[count(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    return _long(
        one,
        [
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"d{i}").alias("cardinality"),
                (F.col(f"d{i}") > HIGH_CARDINALITY).alias("high_cardinality"),
            )
            for i, c in enumerate(cols)
        ],
    )


def duplicate_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each feature combination. Copies collapse map-side, so a hot group is cheap."""
    return (
        df.groupBy(*features)
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).count()
    return counts.agg(
        F.count("*").alias("n_classes"),
        F.coalesce(F.min("count"), F.lit(0)).alias("min_class"),
        F.coalesce(F.max("count") / F.min("count"), F.lit(1.0)).alias("imbalance"),
    )


def _column_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]


def _pair_correlation(a: str, b: str) -> Column:
    x, y = clean_number(a), clean_number(b)
    return F.corr(F.when(y.isNotNull(), x), F.when(x.isNotNull(), y))


#: Columns up to which each pair is an expression of its own: same values, no Python worker.
FEW_COLUMNS = 16


def correlated_pairs(
    df: DataFrame, cols: Sequence[str], threshold: float = HIGH_CORRELATION, min_rows: int = 10, few_columns: int = FEW_COLUMNS
) -> DataFrame:
    """Upper-triangle Pearson correlations over pairwise complete rows whose absolute value exceeds ``threshold``; none in
    tables of fewer than ``min_rows`` rows. Many columns are summed block by block instead of pair by pair."""
    pairs = _column_pairs(cols)
    if len(cols) > few_columns and df.limit(min_rows).count() == min_rows:
        found = pairwise_correlations(df, cols)
        return found.filter(~F.isnan("r") & (F.abs("r") > threshold)).drop("n")
    if not pairs or len(cols) > few_columns:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    one = df.agg(F.count("*").alias("rows"), *[_pair_correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("r"), F.col("rows"))
        for i, (a, b) in enumerate(pairs)
    ]
    keep = (F.col("rows") >= min_rows) & ~F.isnan("r") & (F.abs("r") > threshold)
    return _long(one, entries).filter(keep).drop("rows")


@dataclass(frozen=True)
class TableProfile:
    n_rows: int
    num_cols: list[str]
    cat_cols: list[str]
    target: str | None
    columns: dict[str, dict] = field(default_factory=dict)
    n_duplicates: int = 0
    n_classes: int = 0
    min_class_size: int = 0
    imbalance: float = 1.0
    correlated: list[tuple[str, str]] = field(default_factory=list)

    @property
    def total_missing(self) -> float:
        return sum(c["missing_ratio"] for c in self.columns.values()) / max(len(self.columns), 1)

    def having(self, **tests) -> list[str]:
        """Column names whose recorded statistic passes each test."""
        return [n for n, c in self.columns.items() if all(k in c and t(c[k]) for k, t in tests.items())]

    @property
    def high_missing_cols(self) -> list[str]:
        return self.having(missing_ratio=lambda v: v > HIGH_MISSING)

    def flags(self) -> dict[str, bool]:
        return {
            "has_missing": self.total_missing > 0,
            "has_high_missing": self.total_missing > MANY_MISSING,
            "has_high_missing_cols": bool(self.high_missing_cols),
            "has_duplicates": self.n_duplicates > 0,
            "has_outliers": bool(self.having(outlier_ratio=lambda v: v > MANY_OUTLIERS)),
            "has_high_skew": bool(self.having(skew=lambda v: abs(v) > HIGH_SKEW)),
            "has_high_kurtosis": bool(self.having(kurt=lambda v: abs(v) > HIGH_KURTOSIS)),
            "has_sparse_features": bool(self.having(zero_ratio=lambda v: v > SPARSE)),
            "is_imbalanced": self.target is not None and self.imbalance > IMBALANCED,
            "is_highly_imbalanced": self.target is not None and self.imbalance > HIGHLY_IMBALANCED,
            "has_categorical": bool(self.cat_cols),
            "has_high_cardinality": bool(self.having(high_cardinality=bool)),
            "has_constant_cols": bool(self.having(kind=lambda v: v != "varied")),
            "has_binary_num_cols": bool(self.having(is_binary=bool)),
            "has_multicollinearity": bool(self.correlated),
        }

    def issues(self, spark) -> DataFrame:
        """(issue, n): how many columns, pairs or rows show each quality issue."""
        found = {
            "high_outlier_columns": len(self.having(outlier_ratio=lambda v: v > MANY_OUTLIERS)),
            "high_skew_columns": len(self.having(skew=lambda v: abs(v) > HIGH_SKEW)),
            "high_kurtosis_columns": len(self.having(kurt=lambda v: abs(v) > HIGH_KURTOSIS)),
            "high_cardinality_columns": len(self.having(high_cardinality=bool)),
            "constant_columns": len(self.having(kind=lambda v: v != "varied")),
            "correlated_pairs": len(self.correlated),
            "high_missing_columns": len(self.high_missing_cols),
            "duplicate_rows": self.n_duplicates,
            "binary_numeric_columns": len(self.having(is_binary=bool)),
        }
        return spark.createDataFrame(list(found.items()), "issue string, n long")

    def summary(self, spark) -> DataFrame:
        """One row: sizes and the fifteen flags."""
        row = Row(
            n_rows=self.n_rows,
            n_cols=len(self.columns),
            n_numeric=len(self.num_cols),
            n_categorical=len(self.cat_cols),
            total_missing_ratio=float(self.total_missing),
            n_duplicates=self.n_duplicates,
            n_classes=self.n_classes,
            imbalance=float(self.imbalance),
            **self.flags(),
        )
        return spark.createDataFrame([row])


def profile_table(df: DataFrame, target: str | None = None) -> TableProfile:
    """The whole profile in a handful of jobs: two aggregations over all columns with the quantiles between them, and one
    job each for cardinality, duplicates and the target."""
    num, cat = split_columns(df, target)
    features, pairs = num + cat, _column_pairs(num) if len(num) <= FEW_COLUMNS else []
    first = df.agg(
        F.count("*").alias("rows"),
        *[F.avg(is_missing(df, c).cast("int")).alias(f"m{i}") for i, c in enumerate(features)],
        *[_middle_mark(c).alias(f"h{i}") for i, c in enumerate(features)],
        *[v.alias(f"{k}{i}") for i, c in enumerate(num) for k, v in zip("nzsk", _shape(c))],
        *[g(clean_number(c)).alias(f"{k}{i}") for i, c in enumerate(num) for k, g in (("a", F.min), ("b", F.max))],
        *[_pair_correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
    ).first()
    quart = exact_quantiles(df, num, [0.25, 0.75], counts={c: first[f"n{i}"] for i, c in enumerate(num)})
    shares = [_mark_share(c, first[f"h{i}"]) for i, c in enumerate(features)]
    second = df.agg(
        *[v.alias(f"t{i}") for i, v in enumerate(shares)],
        *[_outlier_share(c, quart[c]).alias(f"o{i}") for i, c in enumerate(num)],
        *[_between_ends(c, first[f"a{i}"], first[f"b{i}"]).alias(f"i{i}") for i, c in enumerate(num)],
    ).first()
    columns: dict[str, dict] = {}
    for i, c in enumerate(features):
        t = second[f"t{i}"]
        kind = "constant" if t is None or t >= 1.0 else "near_constant" if t >= NEAR_CONSTANT else "varied"
        columns[c] = {"missing_ratio": first[f"m{i}"] or 0.0, "kind": kind}
    for i, c in enumerate(num):
        columns[c].update(
            n=first[f"n{i}"], zero_ratio=first[f"z{i}"], skew=first[f"s{i}"], kurt=first[f"k{i}"], q1=quart[c][0], q3=quart[c][1],
            outlier_ratio=second[f"o{i}"], is_binary=second[f"i{i}"] == 0)
    for row in cardinality(df, cat).collect() if cat else []:
        columns[row["column_name"]].update(cardinality=row["cardinality"], high_cardinality=row["high_cardinality"])
    if len(num) > FEW_COLUMNS:
        found = {(r["col_a"], r["col_b"]) for r in correlated_pairs(df, num).select("col_a", "col_b").collect()}
        strong = [p for p in _column_pairs(num) if p in found]
    else:
        strong = [(a, b) for i, (a, b) in enumerate(pairs) if first["rows"] >= 10 and (first[f"r{i}"] or 0.0) ** 2 > HIGH_CORRELATION**2]
    balance = class_balance(df, target).first() if target else None
    return TableProfile(
        n_rows=first["rows"],
        num_cols=num,
        cat_cols=cat,
        target=target,
        columns=columns,
        n_duplicates=duplicate_rows(df, features).first()[0],
        n_classes=balance["n_classes"] if balance else 0,
        min_class_size=balance["min_class"] if balance else 0,
        imbalance=balance["imbalance"] if balance else 1.0,
        correlated=strong,
    )


def numeric_feature_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Auxiliary numeric columns: missing share, range, mean, population deviation, skewness, outliers."""
    casted = df.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in cols])
    aggs = []
    for i, c in enumerate(cols):
        x = clean_number(c)
        n = F.count(x).cast("double")
        skew = F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))
        aggs += [
            F.avg(x.isNull().cast("int")).alias(f"m{i}"),
            *[F.coalesce(g(x), F.lit(0.0)).alias(f"{k}{i}") for k, g in
              {"lo": F.min, "hi": F.max, "av": F.avg, "sd": F.stddev_pop}.items()],
            F.coalesce(F.nanvl(skew, F.lit(0.0)), F.lit(0.0)).alias(f"sk{i}"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"m{i}").alias("missing_ratio"),
            F.col(f"lo{i}").alias("min_value"),
            F.col(f"hi{i}").alias("max_value"),
            F.col(f"av{i}").alias("mean"),
            F.col(f"sd{i}").alias("std"),
            F.col(f"sk{i}").alias("skew"),
        )
        for i, c in enumerate(cols)
    ]
    fences = outlier_ratios(casted, cols).select("column_name", "outlier_ratio")
    return _long(casted.agg(*aggs), entries).join(fences, "column_name")


def categorical_feature_profile(df: DataFrame, cols: Sequence[str], top: int = 5) -> DataFrame:
    """Top values of each column, ties by value. Counting collapses values map-side before the ranking."""
    from pyspark.sql import Window

    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])))
    counts = long.filter("value IS NOT NULL").groupBy("column_name", "value").count()
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def blank_cell_ratio(df: DataFrame) -> DataFrame:
    """Share of NULL or blank cells over the whole table."""
    blank = sum(
        (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").cast("long") for c in df.columns
    )
    return df.agg((F.sum(blank) / (F.count("*") * len(df.columns))).alias("blank_ratio"))
