"""Properties of physical plans: what is read, and which join strategies never appear."""

import pytest

from siftworks.operators import tabular_profile as tp
from siftworks.plans import load_all
from siftworks.plans.registry import QUERIES
from siftworks.session import table

SF = "/root/testdata/sf0.001"
load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_profiled_columns_are_read(spark):
    text = plan(tp.numeric_shape(table(spark, SF, "lineitem"), ["l_tax", "l_discount"]))
    assert "ReadSchema: struct<l_discount:double,l_tax:double>" in text


def test_filters_reach_the_scan(spark):
    text = plan(table(spark, SF, "lineitem").filter("l_quantity > 40").groupBy("l_returnflag").count())
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in text


NO_PRODUCTS = (
    "prf03_duplicates", "prf04_class_balance", "prf09_cardinality", "ftr10_16_ordinal", "set01_dedup_first", "evl06_rules", "met02_multiclass",
    "met06_roc_auc", "met14_nmi_ari", "met15_win06_correlations", "flt06_english_rows", "ftr12_tfidf", "evl10_pair_similarity",
    "evl11_str18_20_summarization", "src13_structure_profile", "src17_join01_metadata_join", "src21_join02_flt10_coco", "ipr02_annotation_profile",
    "src28_join05_set03_manifest", "join04_sidecars", "join08_events_in_clips", "mth05_box_iou", "apr01_signal_profile", "srt02_best_result",
    "exp01_flt13_set02_srt04_tabular_candidates",
)


@pytest.mark.parametrize("name", NO_PRODUCTS)
def test_no_cross_products(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_a_manifest_and_its_files_are_read_at_most_twice(spark):
    from pyspark.sql import functions as F

    from siftworks.sources import manifests

    o = table(spark, SF, "orders")
    m = manifests.canonical(o.select("o_orderkey", F.concat(F.lit("a/"), "o_custkey").alias("noisy"), F.col("o_orderpriority").alias("clean"), F.col("o_orderstatus").alias("label")), ["o_orderkey"])
    files = table(spark, SF, "customer").select(F.concat(F.lit("a/"), "c_custkey").alias("path"))
    kept = manifests.samples(manifests.resolved_records(m, "o_orderkey", files), "o_orderkey")
    for df in (kept, manifests.reference_profile(kept), manifests.presence_flags(kept)):
        text = plan(df)
        assert text.count("orders.parquet") <= 2 and text.count("customer.parquet") == 1
    records, kept = manifests.settled(m, "o_orderkey", files)
    text = plan(manifests.manifest_report(records, kept, files))
    assert "orders.parquet" not in text and text.count("customer.parquet") == 1 and text.count("FileScan") == 4
    for out in manifests.output_manifests(kept).values():
        assert plan(out).count("FileScan") == 1 and "Exchange" not in plan(out)


def test_paths_resolve_in_order_of_their_spelling(spark):
    from siftworks.sources.corpora import resolve_paths

    files = spark.createDataFrame([("d/A.txt",), ("d/a.txt",), ("e/a.txt",), ("f/B.TXT",)], "path string")
    rows = spark.createDataFrame([(1, "d/A.txt"), (2, "D/a.TXT"), (3, "x/a.txt"), (4, "b.txt"), (5, None), (6, "../a.txt"), (7, "no"), (8, "")], "k long, p string")
    got = {r["k"]: r["resolved_path"] for r in resolve_paths(rows, "k", "p", files).collect()}
    assert got == {1: "d/A.txt", 2: "d/A.txt", 3: "d/A.txt", 4: "f/B.TXT", 5: None, 6: None, 7: None, 8: None}
    text = plan(resolve_paths(table(spark, SF, "nation"), "n_nationkey", "n_name", files))
    assert text.count("nation.parquet") == 1
