"""Records cut out of byte ranges against readers that see whole files."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from siftworks.sources import records, splits


@pytest.fixture
def small_splits(spark):
    """Files of a few hundred bytes are read in several tasks."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def words(rng, kind):
    return "".join(rng.choice(kind) for _ in range(rng.choice((0, 1, 5, 30, 220))))


def test_csv_fields_with_line_breaks(spark, tmp_path, small_splits):
    rng = random.Random(4)
    want = []
    for name in ("a.csv", "b.csv"):
        rows = [(i, words(rng, ['ab ,"\n\nä', "c\r\n"][i % 2]), i / 4, words(rng, 'xy"\n\r')) for i in range(150)]
        with open(tmp_path / name, "w", newline="") as f:
            out = csv.writer(f, lineterminator="\r\n" if name == "b.csv" else "\n", quoting=csv.QUOTE_NONNUMERIC)
            out.writerow(("id", "long text", "part", "y"))
            out.writerows(rows)
        want += rows
    df = splits.read_split_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"id": "int", "long text": "string", "part": "double", "y": "string"}
    assert sorted((r[0], r[1] or "", r[2], r[3] or "") for r in df.collect()) == sorted(want)
    assert splits.csv_lines(spark, str(tmp_path)).count() == 302
    assert splits.pieces(spark, str(tmp_path), "\n").rdd.getNumPartitions() > 20


def test_csv_equals_the_whole_file_reader(spark, tmp_path, small_splits):
    text = 'id,name,when,flag,empty\n1,"x, ""y""\nz",2024-01-02,true,\n\n2,"",2024-02-03,FALSE,\n7,"r\rs\r\nt",2024-02-03,true,\n-3,plain,2024-02-04,true,\n30000000000,"a\n\nb",2024-02-05,false,'
    (tmp_path / "a.csv").write_bytes(text.encode())
    got, want = splits.read_split_csv(spark, str(tmp_path)), records.read_csv(spark, str(tmp_path))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    typed = splits.read_split_csv(spark, str(tmp_path), schema=want.schema)
    assert sorted(map(tuple, typed.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("text", ["", "a,b\n", "a,b\n\n\n"])
def test_csv_without_rows(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(text)
    with pytest.raises(records.RecordError):
        splits.read_split_csv(spark, str(tmp_path))


@pytest.mark.parametrize("style", [{}, {"indent": 1}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_json_lists(spark, tmp_path, small_splits, style):
    rng = random.Random(5)
    want = {}
    for name in ("a.json", "b.json"):
        want[name] = [{"i": i, "t": words(rng, 'ab{}[]"\\\n,ü'), "in": [{"k": words(rng, '}"{')}] * rng.choice((0, 1, 3)), "o": {"p": {}}} for i in range(60)]
        (tmp_path / name).write_text(json.dumps(want[name], **style) + "\n")
    (tmp_path / "c.json").write_text(" [ ]\n")
    found = splits.read_split_json(spark, str(tmp_path)).select("file", "rec_no", F.to_json("rec").alias("j")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rec_no"]):
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append(json.loads(r["j"]))
    assert got == want
    assert sorted(r["rec_no"] for r in found) == sorted([*range(60)] * 2)


@pytest.mark.parametrize("text", ['{"a": 1}', '{"a": 1}\n{"a": 2}', '[1, {"a": 1}]', '[{"a": 1}, 2]', '[{"a": 1}, [2]]', '[{"a": 1}', '[{"a": 1 b}]', '[[{"a": 1}]]', "nope", '[{"a": 1}] x', '[{"a": 1},,{"a": 2}]', '[{"a": 1} {"a": 2}]', '[{"a": 1},]'])
def test_json_that_is_no_list_of_objects(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(records.RecordError):
        splits.read_split_json(spark, str(tmp_path))
