"""Column roles: feature/target split, type coercion, auxiliary feature detection, time column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words read as booleans, limits of the auxiliary feature rule.
TRUE_WORDS = ("true", "yes", "y")
FALSE_WORDS = ("false", "no", "n")
NUMERIC_SHARE = 0.9
MAX_CATEGORIES = 50
TIME_WORDS = ("date", "time", "timestamp")
TIME_PARSE_SHARE = 0.8


def prepare(df: DataFrame, target: str, high_missing: Sequence[str] = ()) -> DataFrame:
    """Rows with a target, without the columns that are mostly missing."""
    return df.dropna(subset=[target]).drop(*[c for c in high_missing if c != target])


def numeric_target(df: DataFrame, target: str) -> DataFrame:
    """Target as a number; rows whose target does not parse are dropped."""
    return df.withColumn(target, F.expr(f"try_cast(`{target}` AS double)")).dropna(subset=[target])


def coerce_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """String columns whose present values are all boolean words or all numbers change type; one job decides."""
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    if not cols:
        return df
    words = {c: F.lower(F.trim(F.col(c))) for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [
            F.coalesce(F.bool_and(words[c].isin(*TRUE_WORDS, *FALSE_WORDS)), F.lit(False)).alias(f"b{i}"),
            F.coalesce(
                F.bool_and(F.when(F.col(c).isNotNull(), F.expr(f"try_cast(trim(`{c}`) AS double)").isNotNull())),
                F.lit(False),
            ).alias(f"n{i}"),
        ]
    seen = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        if seen[f"b{i}"]:
            out[c] = F.when(words[c].isin(*TRUE_WORDS), True).when(words[c].isin(*FALSE_WORDS), False)
        elif seen[f"n{i}"]:
            out[c] = F.expr(f"try_cast(trim(`{c}`) AS double)")
    return df.withColumns(out) if out else df


def is_id_like(name: str) -> bool:
    low = name.strip().lower()
    return low in ("id", "row_id", "uuid", "guid", "index") or low.startswith("id_") or low.endswith("_id")


def auxiliary_features(df: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    """Role of each non-id column: numeric, categorical or skipped. One aggregation over all of them."""
    cols = [c for c in (candidates or df.columns) if candidates or not is_id_like(c)]
    aggs, entries = [], []
    for i, c in enumerate(cols):
        kind = df.schema[c].dataType
        text = F.col(c).cast("string")
        parses = F.lit(False) if isinstance(kind, (T.TimestampType, T.DateType)) else F.expr(
            f"try_cast(cast(`{c}` AS string) AS double) IS NOT NULL")
        aggs += [F.avg(parses.cast("int")).alias(f"p{i}"), F.count_distinct(text).alias(f"d{i}")]
        role = (
            F.when(F.lit(isinstance(kind, T.NumericType)) | (F.col(f"p{i}") >= NUMERIC_SHARE), "numeric")
            .when(F.col(f"d{i}").between(1, MAX_CATEGORIES), "categorical")
            .otherwise("skipped")
        )
        entries.append(F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("cardinality"), role.alias("role")))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def time_column(df: DataFrame) -> str | None:
    """First timestamp/date column, else the first one named like a time of which 80 % parse."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return f.name
    named = [f.name for f in df.schema.fields if any(w in f.name.lower() for w in TIME_WORDS)]
    if not named:
        return None
    share = df.agg(*[
        F.avg(F.try_to_timestamp(F.col(c).cast("string")).isNotNull().cast("int")).alias(f"s{i}") for i, c in enumerate(named)
    ]).first()
    return next((c for i, c in enumerate(named) if (share[f"s{i}"] or 0.0) >= TIME_PARSE_SHARE), None)
