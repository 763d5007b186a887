"""Rule sets, similarity and the forest over past runs for every modality."""

import pytest
from pyspark.sql import functions as F

from siftworks.experience import candidates, learner, rules, runs
from siftworks.plans import experience as plans

SF = "/root/testdata/sf0.001"
SIZES = {"tabular": 26, "text": 41, "image": 32, "audio": 29}


@pytest.mark.parametrize("kind", sorted(SIZES))
def test_candidates_are_distinct_capped_and_start_plain(spark, kind):
    p = plans.profiles(spark, SF, kind)
    r = rules.RULE_SETS[kind]
    made = candidates.candidates(p, r).persist()
    per = made.groupBy("dataset").agg(F.count("*").alias("n"), F.count_distinct(F.struct(*r.fields)).alias("d"), F.max("rank").alias("top"))
    assert per.filter("n <> d OR n <> top OR n > 14").count() == 0 and per.count() == p.count()
    free = made.filter("rank = 1").join(p.filter(F.array_contains("constraints", "none")).select("dataset"), "dataset", "left_semi")
    plain = candidates.propose(p, r).filter("idx = 0").select("dataset", *r.fields)
    assert free.select("dataset", *r.fields).exceptAll(plain).count() == 0


def test_avoided_patterns_go_and_good_specs_come(spark):
    p = plans.profiles(spark, SF, "tabular")
    made = candidates.propose(p, rules.TABULAR)
    bad = made.filter("idx = 1")
    left = candidates.avoid(made, bad, rules.TABULAR)
    hit = left.filter("idx > 0").join(bad.select("dataset", *rules.TABULAR.pattern), ["dataset", *rules.TABULAR.pattern], "left_semi")
    assert hit.count() == 0 and left.filter("idx = 0").count() == p.count()
    good = made.filter("idx = 0").withColumn("rank", F.lit(1)).withColumn("imbalance", F.lit("smote")).withColumn("scaler", F.lit("none"))
    fixed = candidates.adapt_injected(good, p).join(p.select("dataset", "min_class_size"), "dataset")
    assert {r[0] for r in fixed.filter("min_class_size < 6").select("imbalance").distinct().collect()} == {"oversample"}


@pytest.mark.parametrize("kind", sorted(SIZES))
def test_a_run_is_most_similar_to_itself(spark, kind):
    names = list(runs.FEATURES[kind])
    rows = [[i, "f1", "fam", 0.5 + i / 10] + [0.1 * ((i + j) % 5) for j in range(len(names))] for i in range(5)]
    df = spark.createDataFrame(rows, ["run_id", "metric", "family", "score", *names])
    me = df.filter("run_id = 2").first().asDict()
    best = runs.similar_runs(df, me, kind, "f1", "fam", 1).first()
    assert best["run_id"] == 2 and abs(best["similarity"] - 1) < 1e-12
    assert runs.similar_runs(df, me, kind, "accuracy", "fam").count() == 0


def encoded_row(kind):
    text = {"task_type": learner.TASKS[kind][1], "input_format": learner.FORMATS[kind][1], "domain": "x", "budget": "light", "quality": "noisy", "supervision": "supervised"}
    spec = {f: None for f in rules.RULE_SETS[kind].fields}
    return text, spec


@pytest.mark.parametrize("kind", sorted(SIZES))
def test_encodings_have_the_expected_size_and_range(spark, kind):
    p = plans.profiles(spark, SF, kind)
    text, _ = encoded_row(kind)
    made = candidates.candidates(p, rules.RULE_SETS[kind]).join(p.drop(*[c for c in p.columns if c in rules.RULE_SETS[kind].fields]), "dataset")
    used = " ".join(learner.ENCODINGS[kind])
    import re

    words = set(re.findall(r"\b[a-z][a-z0-9_]+\b", re.sub(r"'[^']*'", "", used))) - {"least", "greatest", "log10", "pmod", "xxhash64", "lower", "trim"}
    extra = {w: F.lit(text[w]) if w in text else (F.lit(True) if w.startswith(("has_", "is_")) else F.lit(0.5)) for w in words if w not in made.columns}
    x = learner.encoded(made.withColumns(extra), kind)
    row = x.agg(F.max(F.size("x")).alias("size"), F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi")).first()
    assert row["size"] == SIZES[kind] and row["lo"] >= 0 and row["hi"] <= 1


def test_weight_grows_with_experience():
    assert [learner.weight(n) for n in (4, 5, 20, 50)] == [0.0, 0.0, 0.25, 0.25] and abs(learner.weight(14) - 0.15) < 1e-12


def test_repeated_runs_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.1), (2, "a", 0.1), (3, "b", 0.2)], "run_id int, name string, v double")
    assert runs.append_runs(df, str(tmp_path / "t"), ["name", "v"]).count() == 2
    assert runs.append_runs(df, str(tmp_path / "t"), ["name", "v"]).count() == 0
    assert spark.read.parquet(str(tmp_path / "t" / f"v{runs.SCHEMA_VERSION}")).count() == 2


def test_reports_of_one_time_are_not_sorted_in_one_task(spark, tmp_path):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        made = spark.range(2000).select(F.col("id").alias("dataset"), F.concat(F.lit('{"n": '), F.col("id").cast("string"), F.lit("}")).alias("report"))
        runs.write_reports(made, str(tmp_path / "reports"))
        found = runs.history(spark, str(tmp_path / "reports")).withColumn("_task", F.spark_partition_id())
        sizes = [r["count"] for r in found.groupBy("_task").count().collect()]
    finally:
        spark.conf.set(coalesce, before)
    assert sum(sizes) == 2000 and max(sizes) < 1000
