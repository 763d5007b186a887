"""Tabular profile, cleaning, splitting, rules and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns, features, metrics, rules, sampling, series
from ..operators import tabular_profile as tp
from ..operators.correlations import pairwise_correlations
from ..session import table
from .registry import query, rounded

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def holed_lineitem(spark, d):
    """lineitem with NULLs at fixed keys: one column sparse, one mostly missing."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_orderkey") % 5 == 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        "l_quantity", "l_extendedprice",
    )


HOLED = """holed AS (SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS l_tax,
  CASE WHEN l_orderkey % 5 = 0 THEN l_discount END AS l_discount,
  CASE WHEN l_partkey % 11 <> 0 THEN l_returnflag END AS l_returnflag,
  l_quantity, l_extendedprice FROM lineitem)"""


def union_all(template: str, names) -> str:
    return " UNION ALL ".join(template.replace("{c}", n) for n in names)


HOLED_COLS = ["l_tax", "l_discount", "l_returnflag", "l_quantity"]


@query("prf02_missing", f"WITH {HOLED} " + union_all(
    "SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INT), 6) AS missing_ratio, avg(({c} IS NULL)::INT) > 0.5 AS high_missing FROM holed", HOLED_COLS))
def prf02(spark, d):
    return rounded(tp.missing_ratios(holed_lineitem(spark, d), HOLED_COLS))


@query("prf03_duplicates", """SELECT (SELECT count(*) FROM orders) - (SELECT count(*) FROM
  (SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey FROM orders)) AS n_duplicates""")
def prf03(spark, d):
    return tp.duplicate_rows(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("prf04_class_balance", """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1)
  SELECT count(*) AS n_classes, min(n) AS min_class, round(max(n) / min(n), 6) AS imbalance FROM c""")
def prf04(spark, d):
    return rounded(tp.class_balance(table(spark, d, "orders"), "o_orderstatus"))


OUTLIER_TABLE = {"l_quantity": "lineitem", "l_extendedprice": "lineitem", "l_discount": "lineitem", "l_tax": "lineitem"}


@query("prf05_outliers", union_all("""SELECT '{c}' AS column_name, round(q1, 2) AS q1, round(q3, 2) AS q3,
  CASE WHEN q1 = q3 THEN 0.0 ELSE round((SELECT avg((x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::INT)
    FROM (SELECT {c} * {c} AS x FROM lineitem)), 6) END AS outlier_ratio
  FROM (SELECT quantile_cont({c} * {c}, 0.25) AS q1, quantile_cont({c} * {c}, 0.75) AS q3 FROM lineitem)""", NUMS))
def prf05(spark, d):
    squared = table(spark, d, "lineitem").select(*[(F.col(c) * F.col(c)).alias(c) for c in NUMS])
    return rounded(rounded(tp.outlier_ratios(squared, NUMS), "q1", "q3", digits=2), "outlier_ratio")


@query("prf06_07_08_shape", union_all("""SELECT '{c}' AS column_name, count({c}) AS n, round(avg(({c} = 0)::INT), 6) AS zero_ratio,
  round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurt FROM lineitem""", NUMS))
def prf06(spark, d):
    return rounded(tp.numeric_shape(table(spark, d, "lineitem"), NUMS))


@query("prf09_cardinality", union_all(
    "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS cardinality, count(DISTINCT {c}) > 20 AS high_cardinality FROM part", ["p_brand", "p_type", "p_name"]))
def prf09(spark, d):
    return tp.cardinality(table(spark, d, "part"), ["p_brand", "p_type", "p_name"])


CONSTANTS_SQL = """WITH t AS (SELECT c_mktsegment, 'x' AS fixed, CASE WHEN c_custkey % 50 = 0 THEN 'rare' END AS mostly_null,
  c_nationkey FROM customer), s AS ({body})
  SELECT column_name, CASE WHEN top >= 0.95 THEN round(top, 6) END AS top_share,
  CASE WHEN top >= 1 THEN 'constant' WHEN top >= 0.95 THEN 'near_constant' ELSE 'varied' END AS kind FROM s"""


@query("prf10_constants", CONSTANTS_SQL.replace("{body}", union_all(
    "SELECT '{c}' AS column_name, max(n) / sum(n) AS top FROM (SELECT count(*) AS n FROM t GROUP BY {c})",
    ["c_mktsegment", "fixed", "mostly_null", "c_nationkey"])))
def prf10(spark, d):
    t = table(spark, d, "customer").select(
        "c_mktsegment", F.lit("x").alias("fixed"),
        F.when(F.col("c_custkey") % 50 == 0, "rare").alias("mostly_null"), "c_nationkey")
    return rounded(tp.dominant_values(t, t.columns))


@query("prf11_binary_numeric", union_all(
    "SELECT '{c}' AS column_name, count(DISTINCT {c}) = 2 AS is_binary FROM labels", ["quality", "toxic", "doc_id"]))
def prf11(spark, d):
    return tp.binary_numeric(table(spark, d, "labels"), ["quality", "toxic", "doc_id"])


CORR_COLS = ["l_quantity", "l_extendedprice", "revenue", "l_discount"]


@query("prf12_correlated", "WITH t AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM t"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]) + ") WHERE abs(r) > 0.85")
def prf12(spark, d):
    t = table(spark, d, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rounded(tp.correlated_pairs(t, CORR_COLS))


#: Twenty columns of every line, some with gaps.
WIDE = {c: f"CAST({c} AS DOUBLE)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")}
WIDE |= {"net": "l_extendedprice * (1 - l_discount)", "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "unit_price": "l_extendedprice / l_quantity"}
WIDE |= {f"{c}_gaps": f"CASE WHEN l_linenumber <> {i % 4 + 1} THEN {e} END" for i, (c, e) in enumerate(list(WIDE.items())[3:])}
WIDE |= {"always": "CAST(7 AS DOUBLE)"}


@query("prf12_wide_correlations", f"WITH t AS (SELECT {', '.join(f'{e} AS {c}' for c, e in WIDE.items())} FROM lineitem), p AS (SELECT unnest([" + ", ".join(
    f"{{'col_a': '{a}', 'col_b': '{b}', 'n': count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END), 'r': CASE WHEN '{b}' <> 'always' THEN corr({a}, {b}) END}}"
    for i, a in enumerate(WIDE) for b in list(WIDE)[i + 1:]) + "], recursive := true) FROM t) SELECT col_a, col_b, n, round(r, 6) AS r FROM p")
def prf12_wide(spark, d):
    t = table(spark, d, "lineitem").select(*[F.expr(e).alias(c) for c, e in WIDE.items()])
    return rounded(pairwise_correlations(t, list(WIDE)).withColumn("r", F.nanvl("r", F.lit(None).cast("double"))))


@query("prf01_13_summary_flags", f"""WITH {HOLED}, q AS (SELECT quantile_cont(l_tax, 0.25) AS t1, quantile_cont(l_tax, 0.75) AS t3,
    quantile_cont(l_discount, 0.25) AS d1, quantile_cont(l_discount, 0.75) AS d3 FROM holed),
  m AS (SELECT avg((l_tax IS NULL)::INT) AS mt, avg((l_discount IS NULL)::INT) AS md, avg((l_quantity IS NULL)::INT) AS mq,
    count(*) AS n, avg((l_tax = 0)::INT) AS zt, avg((l_discount = 0)::INT) AS zd, avg((l_quantity = 0)::INT) AS zq,
    abs(skewness(l_tax)) AS st, abs(skewness(l_discount)) AS sd, abs(skewness(l_quantity)) AS sq,
    abs(kurtosis(l_tax)) AS kt, abs(kurtosis(l_discount)) AS kd, abs(kurtosis(l_quantity)) AS kq FROM holed),
  c AS (SELECT count(*) AS k, max(n) / min(n) AS imb FROM (SELECT count(*) AS n FROM holed WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag)),
  dup AS (SELECT count(*) AS d FROM (SELECT DISTINCT l_tax, l_discount, l_quantity FROM holed))
  SELECT n AS n_rows, 3::BIGINT AS n_cols, 3::BIGINT AS n_numeric, 0::BIGINT AS n_categorical,
    round((mt + md + mq) / 3, 6) AS total_missing_ratio, n - d AS n_duplicates, k AS n_classes, round(imb, 6) AS imbalance,
    (mt + md + mq) / 3 > 0 AS has_missing, (mt + md + mq) / 3 > 0.1 AS has_high_missing,
    greatest(mt, md, mq) > 0.5 AS has_high_missing_cols, n > d AS has_duplicates,
    (SELECT greatest(avg((l_tax < t1 - 1.5 * (t3 - t1) OR l_tax > t3 + 1.5 * (t3 - t1))::INT),
       avg((l_discount < d1 - 1.5 * (d3 - d1) OR l_discount > d3 + 1.5 * (d3 - d1))::INT)) > 0.05 FROM holed, q) AS has_outliers,
    greatest(st, sd, sq) > 1 AS has_high_skew, greatest(kt, kd, kq) > 3 AS has_high_kurtosis,
    greatest(zt, zd, zq) > 0.5 AS has_sparse_features, imb > 1.5 AS is_imbalanced, imb > 3 AS is_highly_imbalanced,
    false AS has_categorical, false AS has_high_cardinality, false AS has_constant_cols, false AS has_binary_num_cols,
    false AS has_multicollinearity FROM m, c, dup""")
def prf13(spark, d):
    t = holed_lineitem(spark, d).select("l_tax", "l_discount", "l_quantity", "l_returnflag")
    return rounded(tp.profile_table(t, "l_returnflag").summary(spark))


@query("prf14_auxiliary_numeric", union_all("""SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INT), 6) AS missing_ratio,
  round(min({c}), 6) AS min_value, round(max({c}), 6) AS max_value, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std,
  round(skewness({c}), 6) AS skew, round((SELECT avg((s.{c} < q1 - 1.5 * (q3 - q1) OR s.{c} > q3 + 1.5 * (q3 - q1))::INT) FROM supplier s,
    (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM supplier)), 6) AS outlier_ratio
  FROM supplier""", ["s_acctbal", "s_nationkey"]))
def prf14(spark, d):
    return rounded(tp.numeric_feature_profile(table(spark, d, "supplier"), ["s_acctbal", "s_nationkey"]))


@query("prf15_top_values", """SELECT column_name, value, n AS count, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank
  FROM (SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL
        SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL)) WHERE rank <= 5""")
def prf15(spark, d):
    return tp.categorical_feature_profile(table(spark, d, "part"), ["p_brand", "p_type"])


@query("prf16_blank_cells", f"""WITH {HOLED} SELECT round(avg(b), 6) AS blank_ratio FROM (SELECT unnest([
  (l_tax IS NULL)::INT, (coalesce(trim(l_returnflag), '') = '')::INT, (l_quantity IS NULL)::INT]) AS b FROM holed)""")
def prf16(spark, d):
    return rounded(tp.blank_cell_ratio(holed_lineitem(spark, d).select("l_tax", "l_returnflag", "l_quantity")))


@query("flt01_03_05_prepare", f"""WITH {HOLED} SELECT count(*) AS n, round(sum(try_cast(l_returnflag_code AS DOUBLE)), 6) AS target_sum,
  'l_orderkey,l_tax,target' AS kept FROM (SELECT CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2.5' ELSE 'x' END AS l_returnflag_code
  FROM holed WHERE l_returnflag IS NOT NULL) WHERE try_cast(l_returnflag_code AS DOUBLE) IS NOT NULL""")
def flt01(spark, d):
    t = holed_lineitem(spark, d).select("l_orderkey", "l_tax", "l_discount", "l_returnflag")
    t = t.withColumn("target", F.when(F.col("l_returnflag").isNotNull(), F.when(F.col("l_returnflag") == "A", "1").when(
        F.col("l_returnflag") == "N", "2.5").otherwise("x"))).drop("l_returnflag")
    high = [r[0] for r in tp.missing_ratios(t).filter("high_missing").collect()]
    kept = columns.numeric_target(columns.prepare(t, "target", high), "target")
    return rounded(kept.agg(F.count("*").alias("n"), F.sum("target").alias("target_sum"))).withColumn("kept", F.lit(",".join(kept.columns)))


@query("flt04_low_variance", """WITH s AS (SELECT (l_discount - a) / (b - a) AS x, (l_tax - c) / (e - c) AS y, CASE WHEN l_orderkey % 200 = 0 THEN 1 ELSE 0 END AS z
  FROM lineitem, (SELECT min(l_discount) a, max(l_discount) b, min(l_tax) c, max(l_tax) e FROM lineitem))
  SELECT * FROM (SELECT 'l_discount' AS column_name, var_pop(x) > 0.01 AS kept FROM s UNION ALL SELECT 'l_tax', var_pop(y) > 0.01 FROM s
  UNION ALL SELECT 'rare', var_pop(z) > 0.01 FROM s)""")
def flt04(spark, d):
    t = table(spark, d, "lineitem").select("l_discount", "l_tax", (F.col("l_orderkey") % 200 == 0).cast("double").alias("rare"))
    scaled = features.Scale(["l_discount", "l_tax"], "minmax").fit(t).transform(t)
    dropped = features.LowVariance(t.columns).fit(scaled).dropped
    return scaled.agg(F.count("*").alias("n")).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(c not in dropped).alias("kept")) for c in t.columns])))


@query("flt19_auxiliary_features", """SELECT * FROM (SELECT 'l_linenumber' AS column_name, count(DISTINCT l_linenumber) AS cardinality, 'numeric' AS role FROM lineitem
  UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), 'categorical' FROM lineitem
  UNION ALL SELECT 'digits', count(DISTINCT l_partkey), 'numeric' FROM lineitem
  UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate), CASE WHEN count(DISTINCT l_shipdate) <= 50 THEN 'categorical' ELSE 'skipped' END FROM lineitem)""")
def flt19(spark, d):
    t = table(spark, d, "lineitem").select(
        "l_linenumber", "l_returnflag", F.col("l_partkey").cast("string").alias("digits"), "l_shipdate", F.col("l_orderkey").alias("order_id"))
    return columns.auxiliary_features(t)


@query("ftr01_mean_median_impute", f"""WITH {HOLED}, p AS (SELECT avg(l_tax) AS m, quantile_cont(l_discount, 0.5) AS q FROM holed)
  SELECT l_returnflag, count(*) AS n, round(avg(coalesce(l_tax, m)), 6) AS tax, round(avg(coalesce(l_discount, q)), 6) AS discount
  FROM holed, p GROUP BY l_returnflag""")
def ftr01(spark, d):
    t = holed_lineitem(spark, d)
    t = features.ImputeNumber(["l_tax"], "mean").fit(t).transform(t)
    t = features.ImputeNumber(["l_discount"], "median").fit(t).transform(t)
    return rounded(t.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("discount")))


@query("ftr03_mode_impute", f"""WITH {HOLED}, m AS (SELECT l_returnflag AS v FROM holed WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  SELECT coalesce(l_returnflag, v) AS mode_filled, coalesce(l_returnflag, 'missing') AS constant_filled, count(*) AS n FROM holed, m GROUP BY ALL""")
def ftr03(spark, d):
    t = holed_lineitem(spark, d).select(F.col("l_returnflag").alias("mode_filled"), F.col("l_returnflag").alias("constant_filled"))
    t = features.ImputeCategory(["mode_filled"]).fit(t).transform(t)
    t = features.ImputeCategory(["constant_filled"], "constant").fit(t).transform(t)
    return t.groupBy("mode_filled", "constant_filled").agg(F.count("*").alias("n"))


@query("ftr04_08_clip_robust", f"""WITH {HOLED}, p AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM holed WHERE l_quantity < 10),
  c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, least(greatest(l_extendedprice, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS x FROM holed, p),
  r AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS b FROM c WHERE l_quantity < 10)
  SELECT l_orderkey, l_linenumber, l_partkey, round((x - m) / (b - a), 6) AS l_extendedprice FROM c, r""")
def ftr04(spark, d):
    t = holed_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    train = F.col("l_quantity") < 10
    clip = features.ClipOutliers(["l_extendedprice"]).fit(t.filter(train))
    t = clip.transform(t)
    t = features.Scale(["l_extendedprice"], "robust").fit(t.filter(train)).transform(t)
    return rounded(t.drop("l_quantity"), "l_extendedprice")


@query("ftr06_07_scale", """WITH p AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, min(c_nationkey) AS a, max(c_nationkey) AS b FROM customer)
  SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal, round((c_nationkey - a) / (b - a), 6) AS c_nationkey FROM customer, p""")
def ftr06(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    t = features.Scale(["c_acctbal"], "standard").fit(t).transform(t)
    t = features.Scale(["c_nationkey"], "minmax").fit(t).transform(t)
    return rounded(t)


@query("ftr09_onehot", """SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS "o_orderpriority_1-URGENT", (o_orderpriority = '2-HIGH')::INT AS "o_orderpriority_2-HIGH" FROM orders""")
def ftr09(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return features.OneHot(["o_orderpriority"]).fit(t.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))).transform(t)


@query("ftr09_sparse_onehot", """WITH v AS (SELECT c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS place FROM (SELECT DISTINCT c_name FROM customer WHERE c_custkey % 4 <> 0)),
  s AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 + (SELECT count(*) FROM v) AS place FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 3 <> 0))
  SELECT c_custkey, v.place AS name_place, CASE WHEN c_custkey % 3 <> 0 THEN s.place END AS segment_place, (SELECT count(*) FROM v) + (SELECT count(*) FROM s) AS size
  FROM customer LEFT JOIN v USING (c_name) LEFT JOIN s USING (c_mktsegment)""")
def ftr09_sparse(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    model = features.OneHotVectors(["c_name", "c_mktsegment"], "hot").fit(t.filter("c_custkey % 4 <> 0"))
    names, segments = (len(model.categories[c]) for c in ("c_name", "c_mktsegment"))
    at = F.unwrap_udt("hot")["indices"]
    place = lambda low, high: F.get(F.filter(at, lambda i: (i >= low) & (i < high)), F.lit(0)).cast("long")
    return model.transform(t).select("c_custkey", place(0, names).alias("name_place"), place(names, names + segments).alias("segment_place"), F.unwrap_udt("hot")["size"].cast("long").alias("size"))


@query("ftr10_16_ordinal", """WITH v AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 25))
  SELECT p_partkey, coalesce(code, -1) AS p_brand FROM part LEFT JOIN v USING (p_brand)""")
def ftr10(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return features.OrdinalCodes(["p_brand"]).fit(t.filter("p_size < 25")).transform(t).drop("p_size")


@query("join12_vocabulary_alignment", """WITH v AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 4 <> 0))
  SELECT p_partkey, coalesce(code, -1) AS code FROM part LEFT JOIN v USING (p_name) WHERE p_partkey % 4 = 0""")
def join12(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("code"))
    model = features.OrdinalCodes(["code"]).fit(t.filter("p_partkey % 4 <> 0"))
    return model.transform(t.filter("p_partkey % 4 = 0"))


@query("ftr05_power_transform")
def ftr05(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return features.PowerTransform(["l_extendedprice", "l_quantity"]).fit(t).transform(t)


@query("ftr02_knn_impute", """WITH s AS (SELECT s_suppkey, s_nationkey::DOUBLE AS nk, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS bal FROM supplier),
  n AS (SELECT q.s_suppkey, d.bal, row_number() OVER (PARTITION BY q.s_suppkey ORDER BY abs(q.nk - d.nk), d.nk, d.bal) AS r FROM s q JOIN s d ON q.bal IS NULL AND d.bal IS NOT NULL),
  f AS (SELECT s_suppkey, avg(bal) AS bal FROM n WHERE r <= 5 GROUP BY s_suppkey)
  SELECT s_suppkey, nk AS s_nationkey, round(coalesce(s.bal, f.bal), 6) AS s_acctbal FROM s LEFT JOIN f USING (s_suppkey)""")
def ftr02(spark, d):
    sup = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"),
                                             F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    return rounded(features.KnnImpute(["s_nationkey", "s_acctbal"]).fit(sup).transform(sup))


@query("set01_dedup_first", """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER
  (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 100000 + l_linenumber * 10000 + l_quantity) AS rn,
  FROM lineitem) WHERE rn = 1""")
def set01(spark, d):
    t = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    t = t.withColumn("_key", F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_quantity"))
    return features.keep_first(t, ["l_partkey", "l_suppkey"], "_key").drop("_key", "l_quantity")


@query("smp01_stratified_folds", """SELECT doc_id, (((row_number() OVER (PARTITION BY quality ORDER BY doc_id)) - 1) %
  least(5, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))))::INT AS fold FROM labels""")
def smp01(spark, d):
    t = table(spark, d, "labels")
    k = sampling.fold_count(t, "quality")
    return sampling.stratified_folds(t, "quality", [F.col("doc_id")], k).select("doc_id", "fold")


@query("smp02_hashed_folds")
def smp02(spark, d):
    return sampling.hashed_folds(table(spark, d, "orders"), "o_orderkey").groupBy("fold").count()


@query("smp03_time_blocks", """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders),
  s AS (SELECT *, n // (k + 1) AS size FROM (SELECT *, least(5, greatest(2, n // 5)) AS k FROM p))
  SELECT o_orderkey, (CASE WHEN r <= n - k * size THEN 0 ELSE (r - 1 - (n - k * size)) // size + 1 END)::INT AS block FROM s""")
def smp03(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return sampling.time_ordered_blocks(t, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "block")


@query("smp04_holdout_sizes", """SELECT quality, greatest(1, round(count(*) * 0.25))::BIGINT AS n_test, count(*) - greatest(1, round(count(*) * 0.25))::BIGINT AS n_train
  FROM labels GROUP BY quality""")
def smp04(spark, d):
    t = sampling.stratified_holdout(table(spark, d, "labels"), "quality", "doc_id")
    return t.groupBy("quality").agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


@query("smp05_oversample_sizes", """SELECT quality, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS n,
  count(*) AS n_distinct FROM labels GROUP BY quality""")
def smp05(spark, d):
    t = sampling.oversample(table(spark, d, "labels"), "quality", "doc_id")
    return t.groupBy("quality").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct"))


@query("smp07_class_weights", """SELECT o_orderstatus, count(*) AS n, round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*)), 6) AS weight
  FROM orders GROUP BY o_orderstatus""")
def smp07(spark, d):
    return rounded(sampling.class_weights(table(spark, d, "orders"), "o_orderstatus"))


@query("smp08_profile_sample")
def smp08(spark, d):
    return sampling.profile_sample(table(spark, d, "pages").select("page_id", "url"), "page_id", 100)


def hourly(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd HH:00:00").alias("hour"), "event_type").agg(F.round(F.sum("value"), 4).alias("y"))


HOURLY = """hourly AS (SELECT strftime(ts, '%Y-%m-%d %H:00:00') AS hour, event_type, round(sum(value), 4) AS y FROM events GROUP BY ALL),
  lagged AS (SELECT *, lag(y, 1) OVER w AS y_lag_1, lag(y, 2) OVER w AS y_lag_2, lag(y, 3) OVER w AS y_lag_3 FROM hourly WINDOW w AS (PARTITION BY event_type ORDER BY hour))"""


@query("win01_lags", f"WITH {HOURLY} SELECT hour, event_type, y, y_lag_1, y_lag_2, y_lag_3 FROM lagged WHERE y_lag_3 IS NOT NULL")
def win01(spark, d):
    return series.lag_frame(hourly(spark, d), "y", "hour", [], ["event_type"])


@query("evl03_naive_forecast", f"""WITH {HOURLY}, f AS (SELECT *, row_number() OVER (ORDER BY hour, event_type) AS r, count(*) OVER () AS n FROM lagged WHERE y_lag_3 IS NOT NULL),
  s AS (SELECT *, n // 6 AS size FROM f), b AS (SELECT *, (r - 1 - (n - 5 * size)) // size + 1 AS block FROM s WHERE r > n - 5 * size),
  m AS (SELECT block, avg(abs(y - y_lag_1)) AS mae, sqrt(avg((y - y_lag_1) ^ 2)) AS rmse,
    avg(2 * abs(y - y_lag_1) / CASE WHEN abs(y) + abs(y_lag_1) <= 1e-12 THEN 1 ELSE abs(y) + abs(y_lag_1) END) * 100 AS smape,
    avg(CASE WHEN abs(y) > 1e-12 THEN abs((y - y_lag_1) / y) END) * 100 AS mape FROM b GROUP BY block)
  SELECT metric, round(avg(value), 6) AS value FROM (UNPIVOT m ON mae, rmse, smape, mape INTO NAME metric VALUE value) GROUP BY metric""")
def evl03(spark, d):
    frame = series.lag_frame(hourly(spark, d), "y", "hour", [], ["event_type"])
    return rounded(series.naive_forecast(frame, "y", ["hour", "event_type"], 5))


@query("win02_time_column", """SELECT 'o_orderdate' AS by_type, 'order_time' AS by_name""")
def win02(spark, d):
    o = table(spark, d, "orders")
    named = o.select("o_orderkey", F.col("o_orderpriority").alias("lead_time"), F.col("o_orderdate").cast("string").alias("order_time"))
    return o.agg(F.count("*").alias("n")).select(F.lit(columns.time_column(o)).alias("by_type"), F.lit(columns.time_column(named)).alias("by_name"))


BRANDS = """b AS (SELECT DISTINCT l_orderkey AS txn, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("evl06_rules", f"""WITH {BRANDS}, n AS (SELECT count(DISTINCT txn) AS n FROM b), i AS (SELECT item, count(*) AS c FROM b GROUP BY item),
  p AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM b x JOIN b y ON x.txn = y.txn AND x.item < y.item GROUP BY ALL),
  f AS (SELECT p.*, ia.c AS ca, ib.c AS cb, n FROM p JOIN i ia ON ia.item = a JOIN i ib ON ib.item = b, n WHERE p.c >= greatest(2, round_even(0.05 * n, 0))),
  r AS (SELECT a AS lhs, c / n AS s, c / ca AS conf, (c / ca) / (cb / n) AS lift FROM f UNION ALL SELECT b, c / n, c / cb, (c / cb) / (ca / n) FROM f),
  m AS (SELECT count(*) AS k, avg(s) AS s, avg(conf) AS conf, avg(lift) AS lift FROM r),
  cov AS (SELECT count(DISTINCT txn) / (SELECT n FROM n) AS cov FROM b WHERE item IN (SELECT lhs FROM r))
  SELECT k AS number_of_rules, round(s, 6) AS support, round(conf, 6) AS confidence, round(lift, 6) AS lift, round(cov, 6) AS coverage,
  round(0.3 * conf + 0.25 * lift / (lift + 1) + 0.2 * s + 0.2 * cov + 0.05 * exp(-abs(k - 20) / 20.0), 6) AS rule_quality FROM m, cov""")
def evl06(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn"), "l_partkey")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("item"))
    return rounded(rules.mine_rules(li.join(part, "l_partkey").select("txn", "item"))[1])


@query("ftr18_20_row_items", """WITH q AS (SELECT quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]) AS e FROM customer)
  SELECT bin, count(*) AS n FROM (SELECT CASE WHEN c_acctbal <= e[2] THEN 1 WHEN c_acctbal <= e[3] THEN 2 WHEN c_acctbal <= e[4] THEN 3 ELSE 4 END AS bin FROM customer, q)
  GROUP BY bin UNION ALL SELECT 5, count(*) FROM customer WHERE c_mktsegment = 'BUILDING'""")
def ftr18(spark, d):
    items = rules.row_items(table(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_mktsegment"])
    counts = items.groupBy("item").agg(F.count("*").alias("n"))
    bins = counts.filter(F.col("item").startswith("c_acctbal="))
    low = F.regexp_extract("item", r"\((-?[0-9.E]+),", 1).cast("double")
    from pyspark.sql import Window
    ranked = bins.withColumn("bin", F.row_number().over(Window.orderBy(low))).select("bin", "n")
    return ranked.unionByName(counts.filter("item = 'c_mktsegment=BUILDING'").select(F.lit(5).alias("bin"), "n"))


@query("ftr19_20_basket_column", """SELECT item, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct(list_transform(string_split(p_name || ' | ' || p_type || '|' || p_brand, '|'), lambda x: trim(x)))) AS item FROM part)
  WHERE item <> '' GROUP BY item""")
def ftr19(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.concat_ws("", "p_name", F.lit(" | "), "p_type", F.lit("|"), "p_brand").alias("basket"))
    col, delim = rules.basket_column(t)
    return rules.delimited_items(t, "p_partkey", col, delim).groupBy("item").agg(F.count("*").alias("n"))


def predictions(spark, d):
    """Deterministic predictions with tied scores, one 'model' per return flag."""
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_linenumber") % 3).alias("fold"),
        (F.col("l_quantity") > 25).cast("int").alias("y"),
        ((F.col("l_quantity") + F.col("l_discount") * 100) > 30).cast("int").alias("pred"),
        F.round(F.col("l_quantity") / 50 + F.col("l_discount"), 2).alias("score"),
        F.col("l_extendedprice").alias("yr"), (F.col("l_quantity") * 2000).alias("pr"),
        F.col("l_linestatus").alias("yc"), F.when(F.col("l_tax") > 0.04, "O").when(F.col("l_tax") > 0.01, "F").otherwise("Z").alias("pc"),
    )


PRED = """p AS (SELECT l_returnflag AS model, l_linenumber % 3 AS fold, (l_quantity > 25)::INT AS y, (l_quantity + l_discount * 100 > 30)::INT AS pred,
  round(l_quantity / 50 + l_discount, 2) AS score, l_extendedprice AS yr, l_quantity * 2000 AS pr, l_linestatus AS yc,
  CASE WHEN l_tax > 0.04 THEN 'O' WHEN l_tax > 0.01 THEN 'F' ELSE 'Z' END AS pc FROM lineitem)"""


@query("met01_binary", f"""WITH {PRED}, a AS (SELECT model, avg((y = pred)::INT) AS accuracy, sum(y * pred) AS tp, sum(pred) AS pp, sum(y) AS ap FROM p GROUP BY model),
  m AS (SELECT model, accuracy, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision, CASE WHEN ap > 0 THEN tp / ap ELSE 0 END AS recall, 2.0 * tp / (pp + ap) AS f1 FROM a)
  SELECT model, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT model, accuracy, precision, recall, f1 FROM m) ON accuracy, precision, recall, f1 INTO NAME metric VALUE value)""")
def met01(spark, d):
    return rounded(metrics.binary_metrics(predictions(spark, d), ["model"], 1))


@query("met02_multiclass", f"""WITH {PRED}, l AS (SELECT DISTINCT model, yc AS label FROM p UNION SELECT DISTINCT model, pc FROM p),
  s AS (SELECT l.model, label, count(*) FILTER (yc = label AND pc = label) AS tp, count(*) FILTER (yc = label) AS sup, count(*) FILTER (pc = label) AS pp FROM l JOIN p USING (model) GROUP BY ALL),
  k AS (SELECT model, tp, sup, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS pr, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rc, CASE WHEN pp + sup > 0 THEN 2.0 * tp / (pp + sup) ELSE 0 END AS f FROM s),
  m AS (SELECT model, sum(tp) / sum(sup) AS accuracy, avg(f) AS macro_f1, sum(f * sup) / sum(sup) AS weighted_f1, avg(pr) AS macro_precision, avg(rc) AS macro_recall FROM k GROUP BY model)
  SELECT model, metric, round(value, 6) AS value FROM (UNPIVOT m ON accuracy, macro_f1, weighted_f1, macro_precision, macro_recall INTO NAME metric VALUE value)""")
def met02(spark, d):
    return rounded(metrics.multiclass_metrics(predictions(spark, d), ["model"], "yc", "pc"))


@query("met03_multilabel", """WITH t AS (SELECT (l_quantity > 25)::INT AS a, (l_extendedprice > 40000)::INT AS pa, (l_tax > 0.04)::INT AS b, (l_discount > 0.05)::INT AS pb FROM lineitem),
  s AS (SELECT sum(a * pa) AS ta, sum(pa) AS pa, sum(a) AS aa, sum(b * pb) AS tb, sum(pb) AS pb, sum(b) AS ab,
    sum((a <> pa)::INT + (b <> pb)::INT) / (count(*) * 2) AS hamming_loss, avg((a = pa AND b = pb)::INT) AS subset_accuracy FROM t),
  m AS (SELECT hamming_loss, subset_accuracy, (ta + tb) / (pa + pb) AS precision, (ta + tb) / (aa + ab) AS recall, 2.0 * (ta + tb) / (pa + pb + aa + ab) AS micro_f1,
    (2.0 * ta / (pa + aa) + 2.0 * tb / (pb + ab)) / 2 AS macro_f1 FROM s)
  SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON hamming_loss, subset_accuracy, precision, recall, micro_f1, macro_f1 INTO NAME metric VALUE value)""")
def met03(spark, d):
    t = table(spark, d, "lineitem").select(
        (F.col("l_quantity") > 25).cast("int").alias("a"), (F.col("l_extendedprice") > 40000).cast("int").alias("pa"),
        (F.col("l_tax") > 0.04).cast("int").alias("b"), (F.col("l_discount") > 0.05).cast("int").alias("pb"))
    return rounded(metrics.multilabel_metrics(t, {"a": ("a", "pa"), "b": ("b", "pb")}))


@query("met04_05_regression", f"""WITH {PRED}, m AS (SELECT model, avg(abs(yr - pr)) AS mae, sqrt(avg((yr - pr) ^ 2)) AS rmse, 1 - sum((yr - pr) ^ 2) / (var_pop(yr) * count(*)) AS r2,
  avg(2 * abs(yr - pr) / (abs(yr) + abs(pr))) * 100 AS smape, avg(abs((yr - pr) / yr)) * 100 AS mape FROM p GROUP BY model)
  SELECT model, metric, round(value, 5) AS value FROM (UNPIVOT m ON mae, rmse, r2, smape, mape INTO NAME metric VALUE value)""")
def met04(spark, d):
    return rounded(metrics.regression_metrics(predictions(spark, d), ["model"], "yr", "pr"), digits=5)


@query("met06_roc_auc", f"""WITH {PRED}, r AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS rk FROM p)
  SELECT model, 'roc_auc' AS metric, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS value FROM r GROUP BY model""")
def met06(spark, d):
    return rounded(metrics.roc_auc(predictions(spark, d), ["model"]))


@query("met07_win03_average_precision", f"""WITH {PRED}, g AS (SELECT model, score, sum(y) AS pos, count(*) AS n FROM p GROUP BY ALL),
  c AS (SELECT model, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC))
  SELECT model, 'auprc' AS metric, round(sum(pos * tp / k) / sum(pos), 6) AS value FROM c GROUP BY model""")
def met07(spark, d):
    return rounded(metrics.average_precision(predictions(spark, d), ["model"]))


@query("met08_threshold_sweep", f"""WITH {PRED}, t AS (SELECT i / 20.0 AS th FROM range(0, 23) r(i)),
  s AS (SELECT model, th, sum((score >= th AND y = 0)::INT) AS fp, sum((score < th AND y = 1)::INT) AS fn, count(*) AS n, sum(y) AS p FROM p, t GROUP BY ALL),
  b AS (SELECT model, max(1 - (fp + fn) / n) AS verification_accuracy, min((fp + fn) / n) / 2 AS eer_share,
    min({{'gap': abs(fp / (n - p) - fn / p), 'eer': (fp / (n - p) + fn / p) / 2}}).eer AS eer FROM s GROUP BY model)
  SELECT model, metric, round(value, 6) AS value FROM (UNPIVOT b ON verification_accuracy, eer_share, eer INTO NAME metric VALUE value)""")
def met08(spark, d):
    return rounded(metrics.threshold_sweep(predictions(spark, d), [i / 20.0 for i in range(23)], ["model"]))


@query("met14_nmi_ari", """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
  r AS (SELECT a, sum(n) AS na FROM c GROUP BY a), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c),
  mi AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS idx FROM c JOIN r USING (a) JOIN k USING (b), t),
  ha AS (SELECT -sum(na / t * ln(na / t)) AS ha, sum(na * (na - 1) / 2) AS sa FROM r, t), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS hb, sum(nb * (nb - 1) / 2) AS sb FROM k, t)
  SELECT 'nmi' AS metric, round(mi / ((ha + hb) / 2), 6) AS value FROM mi, ha, hb UNION ALL
  SELECT 'ari', round((idx - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) FROM mi, ha, hb, t""")
def met14(spark, d):
    return rounded(metrics.cluster_agreement(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("met15_win06_correlations", """WITH t AS (SELECT l_quantity AS a, l_discount AS b FROM lineitem),
  r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM t)
  SELECT 'pearson' AS metric, round(corr(a, b), 6) AS value FROM t UNION ALL SELECT 'spearman', round(corr(ra, rb), 6) FROM r""")
def met15(spark, d):
    return rounded(metrics.correlation_metrics(table(spark, d, "lineitem"), "l_quantity", "l_discount"))


@query("met16_across_models", f"""WITH {PRED}, f AS (SELECT model, fold, avg((y = pred)::INT) AS accuracy, avg(abs(yr - pr)) AS mae FROM p GROUP BY ALL),
  m AS (SELECT model, avg(accuracy) AS accuracy, avg(mae) AS mae FROM f GROUP BY model)
  SELECT 'accuracy' AS metric, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM m UNION ALL
  SELECT 'mae', round(avg(mae), 5), round(stddev_pop(mae), 5) FROM m""")
def met16(spark, d):
    p = predictions(spark, d)
    long = metrics.binary_metrics(p, ["model", "fold"], 1).filter("metric = 'accuracy'").unionByName(
        metrics.regression_metrics(p, ["model", "fold"], "yr", "pr").filter("metric = 'mae'"))
    out = metrics.across_models(long)
    digits = {c: F.when(F.col("metric") == "mae", F.round(c, 5)).otherwise(F.round(c, 6)) for c in ("mean", "std")}
    return out.withColumns(digits)


@query("mth01_03_error_scales", """WITH t AS (SELECT stddev_pop(o_totalprice) AS s, max(o_totalprice) - min(o_totalprice) AS r, avg(abs(o_totalprice)) AS m FROM orders)
  SELECT round(s, 4) AS std, round(r, 4) AS range, round(m, 4) AS mean_abs, round(greatest(s, r / 4, 1), 4) AS error_scale FROM t""")
def mth03(spark, d):
    return rounded(metrics.error_scales(table(spark, d, "orders"), "o_totalprice"), digits=4)


@query("mth02_normalized_metrics", f"""WITH {PRED}, m AS (SELECT model, avg(abs(yr - pr)) AS mae, avg(2 * abs(yr - pr) / (abs(yr) + abs(pr))) * 100 AS smape, 1 - sum((yr - pr) ^ 2) / (var_pop(yr) * count(*)) AS r2 FROM p GROUP BY model)
  SELECT model, 'mae' AS metric, round(1 / (1 + mae / 1000), 6) AS score FROM m UNION ALL SELECT model, 'smape', round(1 - least(smape, 200) / 200, 6) FROM m
  UNION ALL SELECT model, 'r2', round(greatest(0, least(1, (r2 + 1) / 2)), 6) FROM m""")
def mth02(spark, d):
    long = metrics.regression_metrics(predictions(spark, d), ["model"], "yr", "pr").filter("metric in ('mae', 'smape', 'r2')")
    out = long.withColumn("score", metrics.normalized(F.col("metric"), F.col("value"), F.lit(1000.0))).drop("value")
    return rounded(out)


@query("exp12_profile_issues", f"""WITH {HOLED}, q AS (SELECT quantile_cont(l_tax, 0.25) AS t1, quantile_cont(l_tax, 0.75) AS t3, quantile_cont(l_discount, 0.25) AS d1, quantile_cont(l_discount, 0.75) AS d3 FROM holed),
  o AS (SELECT (avg((l_tax < t1 - 1.5 * (t3 - t1) OR l_tax > t3 + 1.5 * (t3 - t1))::INT) > 0.05)::BIGINT + (avg((l_discount < d1 - 1.5 * (d3 - d1) OR l_discount > d3 + 1.5 * (d3 - d1))::INT) > 0.05)::BIGINT AS n FROM holed, q)
  SELECT 'high_outlier_columns' AS issue, n FROM o UNION ALL SELECT 'high_skew_columns', (abs(skewness(l_tax)) > 1)::INT + (abs(skewness(l_discount)) > 1)::INT FROM holed
  UNION ALL SELECT 'high_kurtosis_columns', (abs(kurtosis(l_tax)) > 3)::INT + (abs(kurtosis(l_discount)) > 3)::INT FROM holed UNION ALL SELECT 'high_cardinality_columns', 0 UNION ALL SELECT 'constant_columns', 0
  UNION ALL SELECT 'correlated_pairs', (abs(corr(l_tax, l_discount)) > 0.85)::INT FROM holed UNION ALL SELECT 'high_missing_columns', (avg((l_tax IS NULL)::INT) > 0.5)::INT + (avg((l_discount IS NULL)::INT) > 0.5)::INT FROM holed
  UNION ALL SELECT 'duplicate_rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_tax, l_discount FROM holed)) FROM holed UNION ALL SELECT 'binary_numeric_columns', 0""")
def exp12(spark, d):
    return tp.profile_table(holed_lineitem(spark, d).select("l_tax", "l_discount", "l_returnflag"), "l_returnflag").issues(spark)


@query("exp12_model_breakdown", f"""WITH {PRED} SELECT model, fold, round(avg((y = pred)::INT), 6) AS accuracy, round(avg(abs(yr - pr)), 4) AS mae, count(*) AS n FROM p GROUP BY ALL""")
def exp12_models(spark, d):
    p = predictions(spark, d)
    keys = ["model", "fold"]
    acc = metrics.binary_metrics(p, keys, 1).filter("metric = 'accuracy'").select(*keys, F.round("value", 6).alias("accuracy"))
    mae = metrics.regression_metrics(p, keys, "yr", "pr").filter("metric = 'mae'").select(*keys, F.round("value", 4).alias("mae"))
    return acc.join(mae, keys).join(p.groupBy(*keys).agg(F.count("*").alias("n")), keys)


@query("snk01_cleaned_table")
def snk01(spark, d):
    from ..operators.models import CleanSpec, fit_clean
    from ..session import shared_folder

    t = table(spark, d, "orders").select("o_totalprice", "o_orderpriority", "o_orderstatus")
    path = shared_folder(spark, "cleaned")
    from ..sinks.datasets import write_cleaned_table

    write_cleaned_table(fit_clean(CleanSpec(num_imputer="median", scaler="robust", outlier_clip=True), t, ["o_totalprice"], ["o_orderpriority"], vectors_of_categories=False).columns_model(), t, "o_orderstatus", path)
    out = spark.read.parquet(path)
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in out.columns if c.startswith("o_orderpriority_")])


@query("snk03_corpus", """SELECT source AS label, count(*) AS n, count(DISTINCT lang) AS names FROM documents GROUP BY source""")
def snk03(spark, d):
    from ..functions.text import TextSpec
    from ..session import shared_folder
    from ..sinks.datasets import write_corpus

    path = shared_folder(spark, "corpus")
    write_corpus(table(spark, d, "documents"), "doc_id", "lang", "text", "source", path, TextSpec())
    out = spark.read.json(f"{path}/documents")
    stem = F.regexp_replace("file_name", "_[0-9]+$", "")
    return out.groupBy("label").agg(F.count_distinct("file_name").alias("n"), F.count_distinct(stem).alias("names"))
