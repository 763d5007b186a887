"""A corpus is cleaned once, whatever is written of it."""

from pyspark.sql import functions as F

from siftworks.sinks import datasets


def test_each_text_is_cleaned_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def clean(text, spec):
        def one(t):
            seen.add(1)
            return t.strip()

        return F.udf(one, "string")(text)

    monkeypatch.setattr(datasets, "clean_text", clean)
    df = spark.range(300).selectExpr("id", "'n' || id % 7 AS name", "' text ' || id AS text", "'l' || id % 3 AS label")
    manifest = datasets.write_corpus(df, "id", "name", "text", "label", str(tmp_path / "c"))
    assert manifest.agg(F.sum("n_chars")).first()[0] == sum(len(f"text {i}") for i in range(300))
    assert spark.read.json(str(tmp_path / "c" / "documents")).select("label", "file_name").distinct().count() == 300
    assert seen.value == 300
