"""Fit/transform column operators as ``pyspark.ml`` stages, so they chain in a ``Pipeline``.

Fit is one aggregation (or a short series of them) that yields a small set of parameters; transform is a
projection of native expressions, usable on batch and streaming frames alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import with_position
from .quantiles import clean_number, exact_quantiles
from .tabular_profile import iqr_bounds


class ColumnMap(Model):
    """A fitted stage: replaces columns by expressions."""

    def __init__(self, exprs: dict[str, Column], params: dict | None = None):
        super().__init__()
        self.exprs = exprs
        self.params_found = params or {}

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.exprs)


class _Columns(Estimator):
    def __init__(self, cols: Sequence[str]):
        super().__init__()
        self.cols = list(cols)


class ImputeNumber(_Columns):
    """Mean or exact-median imputation."""

    def __init__(self, cols: Sequence[str], strategy: str = "median"):
        super().__init__(cols)
        self.strategy = strategy

    def _fit(self, df: DataFrame) -> ColumnMap:
        if self.strategy == "mean":
            row = df.agg(*[F.avg(clean_number(c)).alias(f"v{i}") for i, c in enumerate(self.cols)]).first()
            fill = {c: row[f"v{i}"] for i, c in enumerate(self.cols)}
        else:
            fill = {c: q[0] for c, q in exact_quantiles(df, self.cols, [0.5]).items()}
        return ColumnMap(
            {c: F.coalesce(clean_number(c), F.lit(0.0 if v is None else float(v))) for c, v in fill.items()}, fill
        )


class ImputeCategory(_Columns):
    """Most frequent value (ties: smallest) or a constant."""

    def __init__(self, cols: Sequence[str], strategy: str = "mode", fill: str = "missing"):
        super().__init__(cols)
        self.strategy, self.fill = strategy, fill

    def _fit(self, df: DataFrame) -> ColumnMap:
        found = {}
        for c in self.cols:
            found[c] = self.fill
            if self.strategy == "mode":
                top = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
                found[c] = top[c] if top else self.fill
        return ColumnMap({c: F.coalesce(F.col(c), F.lit(v)) for c, v in found.items()}, found)


class ClipOutliers(_Columns):
    """Clip to the IQR fences learnt from the training rows."""

    def _fit(self, df: DataFrame) -> ColumnMap:
        bounds = {c: iqr_bounds(q) for c, q in exact_quantiles(df, self.cols, [0.25, 0.75]).items()}
        exprs = {}
        for c, b in bounds.items():
            x = clean_number(c)
            exprs[c] = x if b is None else F.when(
                x.isNotNull(), F.least(F.greatest(x, F.lit(float(b[0]))), F.lit(float(b[1]))))
        return ColumnMap(exprs, bounds)


class Scale(_Columns):
    """``standard`` (population deviation), ``minmax`` or ``robust`` (median, IQR); a zero spread scales by 1."""

    def __init__(self, cols: Sequence[str], kind: str = "standard"):
        super().__init__(cols)
        if kind not in ("standard", "minmax", "robust"):
            raise ValueError(f"no scaling named {kind}")
        self.kind = kind

    def _fit(self, df: DataFrame) -> ColumnMap:
        found = {}
        if self.kind == "robust":
            for c, (q1, med, q3) in exact_quantiles(df, self.cols, [0.25, 0.5, 0.75]).items():
                found[c] = (med, None if q1 is None else q3 - q1)
        else:
            centre, spread = (F.avg, F.stddev_pop) if self.kind == "standard" else (
                F.min, lambda x: F.max(x) - F.min(x))
            aggs = [F.struct(centre(clean_number(c)), spread(clean_number(c))).alias(f"v{i}") for i, c in enumerate(self.cols)]
            row = df.agg(*aggs).first()
            found = {c: tuple(row[f"v{i}"]) for i, c in enumerate(self.cols)}
        return ColumnMap(
            {c: (clean_number(c) - F.lit(float(m or 0.0))) / F.lit(float(s or 1.0)) for c, (m, s) in found.items()}, found
        )


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


class PowerTransform(_Columns):
    """Yeo-Johnson with the maximum-likelihood exponent, then standardisation. The exponent is searched on a
    grid that shrinks around the best point; every pass evaluates all columns and points in one aggregation."""

    def __init__(self, cols: Sequence[str], low: float = -3.0, high: float = 5.0, points: int = 9, passes: int = 6):
        super().__init__(cols)
        self.low, self.high, self.points, self.passes = low, high, points, passes

    def _fit(self, df: DataFrame) -> ColumnMap:
        span = {c: (self.low, self.high) for c in self.cols}
        best = {}
        for _ in range(self.passes):
            grid = {c: [a + (b - a) * k / (self.points - 1) for k in range(self.points)] for c, (a, b) in span.items()}
            aggs = []
            for i, c in enumerate(self.cols):
                x = clean_number(c)
                aggs.append(F.struct(
                    F.count(x).cast("double").alias("n"),
                    F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("jac"),
                    *[F.var_pop(yeo_johnson(x, lam)).alias(f"v{k}") for k, lam in enumerate(grid[c])],
                ).alias(f"c{i}"))
            row = df.agg(*aggs).first()
            for i, c in enumerate(self.cols):
                r = row[f"c{i}"]
                def gain(k):
                    v = r[f"v{k}"]
                    if v is None or v <= 0 or not math.isfinite(v):
                        return -math.inf
                    return -0.5 * r["n"] * math.log(v) + (grid[c][k] - 1) * (r["jac"] or 0.0)
                k = max(range(self.points), key=gain)
                best[c] = grid[c][k]
                step = grid[c][1] - grid[c][0]
                span[c] = (best[c] - step, best[c] + step)
        powered = ColumnMap({c: yeo_johnson(clean_number(c), lam) for c, lam in best.items()})
        scaled = Scale(self.cols, "standard").fit(powered.transform(df))
        out = _Chain([powered, scaled])
        out.params_found = best
        return out


class _Chain(Model):
    def __init__(self, stages):
        super().__init__()
        self.stages = stages

    def _transform(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = s.transform(df)
        return df


class OrdinalCodes(_Columns):
    """0-based code of the value in sorted order; unknown values get -1. The vocabulary stays a distributed
    table, joined with whatever strategy its size allows."""

    def _fit(self, df: DataFrame) -> Model:
        return _OrdinalModel({c: vocabulary(df, c) for c in self.cols})


class _OrdinalModel(Model):
    def __init__(self, vocab: dict[str, DataFrame]):
        super().__init__()
        self.vocab = vocab

    def _transform(self, df: DataFrame) -> DataFrame:
        for c, v in self.vocab.items():
            coded = v.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
            df = df.join(coded, F.col(c).cast("string") == F.col("_v"), "left")
            df = df.withColumn(c, F.coalesce(F.col("_code"), F.lit(-1)).cast("long")).drop("_v", "_code")
        return df


def vocabulary(df: DataFrame, col: str) -> DataFrame:
    """(value, code) of the distinct values in sorted order."""
    values = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("value")).distinct()
    return with_position(values, [F.col("value")], name="code").withColumn("code", F.col("code") - 1)


class OneHot(_Columns):
    """One 0/1 column per training category, for tables that people read. A column of many categories belongs into a
    sparse vector, see OneHotVectors. Unknown values are all zeros."""

    def __init__(self, cols: Sequence[str], numbered: bool = False):
        super().__init__(cols)
        self.numbered = numbered

    def _fit(self, df: DataFrame) -> Model:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in self.cols])).alias("x")
        found: dict[str, list[str]] = {c: [] for c in self.cols}
        for r in df.select(cells).select("x.c", "x.v").filter("v IS NOT NULL").distinct().collect():
            found[r["c"]].append(r["v"])
        return _OneHotModel({c: sorted(v) for c, v in found.items()}, self.numbered)


class OneHotVectors(_Columns):
    """All categories of all columns as one sparse vector, sorted within a column; unknown and NULL values are zeros.

    The categories of every column are counted in one pass with partial maps per task, and rows are coded where they
    stand: no join, so neither NULL nor a frequent value meets in one task. The model holds the categories."""

    def __init__(self, cols: Sequence[str], out: str = "_onehot"):
        super().__init__(cols)
        self.out = out

    def _fit(self, df: DataFrame) -> Model:
        from pyspark.ml import PipelineModel
        from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler

        codes, hot = [f"_code_{i}" for i in range(len(self.cols))], [f"_hot_{i}" for i in range(len(self.cols))]
        coder = StringIndexer(inputCols=self.cols, outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
        encoder = OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True).fit(coder.transform(df.limit(1)))
        together = VectorAssembler(inputCols=hot, outputCol=self.out)
        gone = ", ".join(f"`{c}`" for c in [*self.cols, *codes, *hot])
        model = PipelineModel([coder, encoder, together, SQLTransformer(statement=f"SELECT * EXCEPT ({gone}) FROM __THIS__")])
        model.categories = dict(zip(self.cols, coder.labelsArray))
        return model


class _OneHotModel(Model):
    def __init__(self, found: dict[str, list[str]], numbered: bool):
        super().__init__()
        self.categories, self.numbered = found, numbered

    def _transform(self, df: DataFrame) -> DataFrame:
        for c, values in self.categories.items():
            x = F.col(c).cast("string")
            names = [f"{c}_{i if self.numbered else v}" for i, v in enumerate(values)]
            df = df.withColumns({n: F.coalesce((x == v).cast("int"), F.lit(0)) for n, v in zip(names, values)})
        return df.drop(*self.categories)


MIN_VARIANCE = 0.01


class LowVariance(_Columns):
    """Drops columns whose population variance does not exceed the threshold."""

    def __init__(self, cols: Sequence[str], threshold: float = MIN_VARIANCE):
        super().__init__(cols)
        self.threshold = threshold

    def _fit(self, df: DataFrame) -> Model:
        row = df.agg(*[F.var_pop(clean_number(c)).alias(f"v{i}") for i, c in enumerate(self.cols)]).first()
        return _Drop([c for i, c in enumerate(self.cols) if not (row[f"v{i}"] or 0.0) > self.threshold])


class _Drop(Model):
    def __init__(self, cols):
        super().__init__()
        self.dropped = cols

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


class KnnImpute(_Columns):
    """Mean of the ``k`` nearest donors by NaN-aware Euclidean distance, equal distances by the donors' sorted order; the
    column mean where no donor has the value and a column in common. Donors stay a distributed table of any size."""

    def __init__(self, cols: Sequence[str], k: int = 5):
        super().__init__(cols)
        self.k = k

    def _fit(self, df: DataFrame) -> Model:
        donors = df.select(*[clean_number(c).alias(f"_{i}") for i, c in enumerate(self.cols)])
        numbered = cut_lineage(with_position(donors, [F.col(c) for c in donors.columns], name="_donor"))
        row = numbered.agg(*[F.avg(c).alias(c) for c in donors.columns]).first()
        return _KnnModel(self.cols, self.k, numbered.select("_donor", F.array(*donors.columns).alias("v")), [row[c] or 0.0 for c in donors.columns])


def _pattern(values: Column) -> Column:
    """Which values are there, as 0 and 1."""
    return F.concat_ws("", F.transform(values, lambda v: F.when(v.isNull(), "0").otherwise("1")))


class _KnnModel(Model):
    """Rows meet donors by missing pattern: in the columns that a row's pattern and a donor's pattern share, the distance is
    an ordinary one, so each pair of patterns is a group of its own in the neighbour index. The k best donors of the groups
    that hold a value are merged per value."""

    def __init__(self, cols: list[str], k: int, donors: DataFrame, means: list[float]):
        super().__init__()
        self.cols, self.k, self.donors, self.means = cols, k, donors, means

    def _transform(self, df: DataFrame) -> DataFrame:
        from . import neighbours

        n = len(self.cols)
        staged = cut_lineage(df.withColumn("_v", F.array(*[clean_number(c) for c in self.cols])).withColumn("_row", F.monotonically_increasing_id()))
        asked = staged.select("_row", F.col("_v").alias("v"), _pattern(F.col("_v")).alias("p")).filter(F.contains("p", F.lit("0")))
        held = self.donors.withColumn("p", _pattern(F.col("v")))
        rows, gives = ([r["p"] for r in x.select("p").distinct().collect()] for x in (asked, held))
        pairs = [(q, d) for q in rows for d in gives if any(a == b == "1" for a, b in zip(q, d)) and any(a == "0" and b == "1" for a, b in zip(q, d))]
        means = F.array(*[F.lit(float(m)) for m in self.means])
        if not pairs:
            filled = staged.withColumn("_f", F.zip_with("_v", means, lambda v, m: F.coalesce(v, m)))
            return filled.withColumns({c: F.col("_f")[j] for j, c in enumerate(self.cols)}).drop("_v", "_f", "_row")
        groups = df.sparkSession.createDataFrame(pairs, "q string, d string")

        def projected(side: DataFrame, own: str, ident: Column) -> DataFrame:
            """Every vector once per group of its pattern, with zeros outside the shared columns."""
            both = side.join(F.broadcast(groups), side["p"] == groups[own])
            shared = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.substr("q", i, F.lit(1)) == "1") & (F.substr("d", i, F.lit(1)) == "1"))
            x = F.transform(F.arrays_zip(F.col("v"), shared.alias("s")), lambda z: F.when(z["s"], z["v"]).otherwise(F.lit(0.0)))
            return both.select(F.concat_ws("|", "q", "d").alias("group"), ident.alias("id"), x.alias("x"))

        shelf = neighbours.rings(neighbours.entries(projected(held, "d", F.col("_donor")), "id", "x", self.k, "group"))
        queries = projected(asked, "q", F.concat_ws("|", F.col("_row").cast("string"), "q", "d"))
        found = neighbours.nearest_entries(neighbours.rings(queries.withColumn("keys", F.array("id")), pivots=shelf.pivots), shelf, self.k).rows
        at = F.split("id", r"\|")
        shared = F.length(F.regexp_replace(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.substr(at[1], i, F.lit(1)), F.substr(at[2], i, F.lit(1)), F.lit(",")))), "(00|01|10),", "")) / 3
        scaled = F.col("distance") * F.sqrt(F.lit(float(n)) / shared)  # the fewer columns are shared, the more each counts
        near = found.select(at[0].cast("long").alias("_row"), at[1].alias("q"), F.col("key").alias("_donor"), scaled.alias("distance")).join(self.donors, "_donor")
        missing = F.posexplode("v").alias("j", "value")
        best = Window.partitionBy("_row", "j").orderBy("distance", "_donor")
        values = near.select("_row", "q", "_donor", "distance", missing).filter((F.substr("q", F.col("j") + 1, F.lit(1)) == "0") & F.col("value").isNotNull())
        values = values.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= self.k).groupBy("_row", "j").agg(F.avg("value").alias("value"))
        fills = values.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("j", "value"))).alias("_m"))
        joined = staged.join(fills, "_row", "left")
        cell = lambda j: F.coalesce(F.get("_v", F.lit(j)), F.col("_m")[j], F.lit(float(self.means[j])))
        return joined.withColumns({c: cell(j) for j, c in enumerate(self.cols)}).drop("_v", "_row", "_m")


def keep_first(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """One row per feature combination, the one with the smallest key. Aggregates map-side, so a combination
    that holds a large share of the rows never meets in one task as raw rows."""
    rest = [c for c in df.columns if c not in features]
    first = df.groupBy(*features).agg(F.min_by(F.struct(*rest), F.col(key)).alias("_first"))
    return first.select(*features, "_first.*").select(*df.columns)
