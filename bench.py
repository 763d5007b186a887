"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftworks.plans import load_all  # noqa: E402
from siftworks.plans.registry import QUERIES  # noqa: E402
from siftworks.session import local_session  # noqa: E402

HEADLINE = (
    "prf02_missing", "prf03_duplicates", "prf05_outliers", "prf06_07_08_shape", "prf10_constants", "prf12_correlated", "prf01_13_summary_flags",
    "ftr04_08_clip_robust", "ftr10_16_ordinal", "set01_dedup_first", "smp01_stratified_folds", "win01_lags", "evl06_rules",
    "met02_multiclass", "met06_roc_auc", "met15_win06_correlations", "str03_11_clean_documents", "flt06_english_rows", "tpr05_noise",
    "ftr12_tfidf", "evl11_str18_20_summarization", "src02_07_json_records", "src21_join02_flt10_coco", "evl15_win04_join09_retrieval",
    "evl22_centroid_identification", "exp01_flt13_set02_srt04_tabular_candidates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    load_all()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
