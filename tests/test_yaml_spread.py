"""YAML documents are parsed by all cores, and once."""

import json

from siftworks.sources import records


def test_one_split_of_documents_is_dealt_to_the_cores(spark):
    docs = spark.range(400).selectExpr("concat('id: ', id, '\\nitems:\\n  - {v: ', id * 2, '}\\n') AS value").coalesce(1)
    made = records.yaml_as_json(docs)
    assert len(made.inputFiles()) > 1  # parts written by several tasks; readers do not parse again
    got = sorted((r["id"], r["items"][0]["v"]) for r in (json.loads(x["value"]) for x in made.collect()))
    assert got == [(i, 2 * i) for i in range(400)]
    assert records.json_records(made, "value", "items").count() == 400
