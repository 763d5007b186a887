"""Record files (CSV, JSON, JSON lines, XML, YAML) as DataFrames, record selection and flattening."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binding import let
from ..operators.rows import side_by_side
from ..session import cut_lineage

# Array join limit, shortest list that counts as records, tolerated share of bad lines.
ARRAY_JOIN_LIMIT = 16
MIN_RECORDS = 2
MAX_INVALID_SHARE = 0.5


class RecordError(ValueError):
    """The file does not hold one unambiguous record collection."""


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """Delimited text with a header. Give a schema for large inputs: type inference reads the data once more."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if not df.columns or df.isEmpty():
        raise RecordError(f"{path} holds no rows")
    return df


def whole_json(text: Column) -> Column:
    """The only JSON value of a text as an array of one VARIANT, or NULL. The parser stops after the first value, so the
    text is read as the elements of an array, where anything after it is an error or a second element."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(F.try_variant_get(boxed, "$", "array<variant>"), lambda items: F.when(F.size(items) == 1, items))


@dataclass(frozen=True)
class LineReport:
    total: int
    invalid: int
    first_invalid: list[str]


def json_lines(lines: DataFrame, col: str = "value") -> tuple[DataFrame, LineReport]:
    """(records as VARIANT column ``rec``, report). Blank lines are skipped, broken ones counted; more than half broken or
    any non-object record is an error."""
    text = lines.filter(F.trim(F.col(col)) != "").select(F.col(col).alias("_line"))
    parsed = text.withColumn("rec", F.get(whole_json(F.col("_line")), F.lit(0)))
    bad = F.col("rec").isNull()
    is_object = F.schema_of_variant("rec").startswith("OBJECT")
    seen = parsed.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(~bad & ~is_object).alias("other")).first()
    sample = [r[0] for r in parsed.filter(bad).select("_line").limit(5).collect()] if seen["bad"] else []
    if seen["n"] == seen["bad"]:
        raise RecordError("no valid JSON line")
    if seen["bad"] > MAX_INVALID_SHARE * seen["n"]:
        raise RecordError(f"{seen['bad']} of {seen['n']} lines are not valid JSON")
    if seen["other"]:
        raise RecordError("every line must hold a JSON object")
    return parsed.filter(~bad).select("rec"), LineReport(seen["n"], seen["bad"], sample)


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, LineReport]:
    return json_lines(spark.read.text(path))


def json_path(path: str) -> str:
    """``a.b[0].c`` as a JSON path."""
    out = "$"
    for part in [p for p in re.split(r"[.\[\]]", path) if p]:
        out += f"[{part}]" if part.isdigit() else f"['{part}']"
    return out


def _record_lists(kind: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(kind, T.ArrayType):
        return [prefix] if isinstance(kind.elementType, T.StructType) else []
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _record_lists(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    return []


def _as_type(ddl: str) -> T.DataType:
    return T.DataType.fromDDL(re.sub(r"\bOBJECT<", "STRUCT<", ddl).replace("VOID", "STRING"))


def json_records(docs: DataFrame, col: str, record_path: str = "", keys: list[str] | None = None) -> DataFrame:
    """One VARIANT row ``rec`` per record of every JSON document.

    With a path, the list at that path. Without one: the root list; else the only list of at least two objects in
    the documents; a document without such a list is one record; several lists are an error."""
    keys = keys or []
    parsed = docs.select(*keys, F.explode(whole_json(F.col(col))).alias("_v"))
    if record_path:
        at = json_path(record_path)
        there, listed = F.try_variant_get("_v", at, "variant"), F.try_variant_get("_v", at, "array<variant>")
        plain = F.exists(listed, lambda r: ~F.schema_of_variant(r).startswith("OBJECT"))
        seen = parsed.agg(
            F.count_if(there.isNull()).alias("missing"), F.count_if(there.isNotNull() & listed.isNull()).alias("other"),
            F.count_if(F.coalesce(plain, F.lit(False))).alias("plain")).first()
        if seen["missing"]:
            raise RecordError(f"record path {record_path} not found")
        if seen["other"]:
            raise RecordError(f"record path {record_path} does not point to a list")
        if seen["plain"]:
            raise RecordError(f"elements at {record_path} are not all objects")
    else:
        ddl = parsed.agg(F.schema_of_variant_agg("_v")).first()[0]
        if ddl is None:
            raise RecordError("no valid JSON document")
        kind = _as_type(ddl)
        if isinstance(kind, T.ArrayType):
            if not isinstance(kind.elementType, T.StructType):
                raise RecordError("list elements are not all objects")
            at = "$"
        else:
            paths = _record_lists(kind)
            if paths:
                longest = parsed.agg(*[
                    F.max(F.size(F.try_variant_get("_v", json_path(p), "array<variant>"))).alias(f"n{i}") for i, p in enumerate(paths)
                ]).first()
                paths = [p for i, p in enumerate(paths) if (longest[f"n{i}"] or 0) >= MIN_RECORDS]
            if len(paths) > 1:
                raise RecordError(f"several record lists found: {', '.join(paths[:5])}; name one")
            at = json_path(paths[0]) if paths else None
    if at is None:
        return parsed.select(*keys, F.col("_v").alias("rec"))
    return parsed.select(*keys, F.explode(F.try_variant_get("_v", at, "array<variant>")).alias("rec"))


def read_json_records(spark: SparkSession, path: str, record_path: str = "") -> DataFrame:
    return json_records(spark.read.text(path, wholetext=True), "value", record_path)


def structured(records: DataFrame, rec: str = "rec", keys: list[str] | None = None) -> DataFrame:
    """VARIANT records as typed columns of their merged schema."""
    kind = _as_type(records.agg(F.schema_of_variant_agg(rec)).first()[0])
    out = records.select(*(keys or []), F.from_json(F.to_json(F.col(rec)), kind).alias("_r"))
    return out.select(*(keys or []), "_r.*")


def read_xml_records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Repeated ``row_tag`` elements; attributes as ``@name``, mixed text as ``#text``, repeated children as arrays."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@").option("valueTag", "#text")
    df = reader.load(path)
    if not df.columns:
        raise RecordError(f"no <{row_tag}> element in {path}")
    return df


def yaml_as_json(docs: DataFrame, col: str = "value") -> DataFrame:
    """YAML documents as JSON text. Parsing costs far more than moving the documents, so they are dealt to all cores, however
    few row groups or files hold them, and the JSON is written once for its readers."""
    def convert(batches):
        import json

        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for pdf in batches:
            yield pd.DataFrame({"value": [json.dumps(yaml.load(t, loader), default=str) for t in pdf[col]]})

    texts = docs.select(col)
    dealt = texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions()))
    return cut_lineage(dealt.mapInPandas(convert, "value string"))


def read_yaml_records(spark: SparkSession, path: str, record_path: str = "") -> DataFrame:
    return json_records(yaml_as_json(spark.read.text(path, wholetext=True)), "value", record_path)


def _scalar_list(c: Column) -> Column:
    text = F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("")))
    head = F.array_join(F.slice(text, 1, ARRAY_JOIN_LIMIT), "|")
    more = F.size(c) - ARRAY_JOIN_LIMIT
    tail = F.concat(head, F.lit("|...(+"), more.cast("string"), F.lit(")"))
    return F.when(F.size(c) > ARRAY_JOIN_LIMIT, tail).when(F.size(c) > 0, head)


def flatten(df: DataFrame, arrays: str = "join", keep_parents: bool = False, leaf_alias: bool = False) -> DataFrame:
    """Nested columns as dotted columns.

    ``arrays='join'``: scalar arrays joined by ``|`` (16 at most, then the number left out) with a ``.count`` column, object
    arrays as JSON with a count. ``arrays='json'``: every array as JSON, no counts. ``keep_parents`` also keeps each struct
    as JSON, ``leaf_alias`` also offers a leaf under its own name when that name is free."""
    out: dict[str, Column] = {}
    leaves: list[tuple[str, str]] = []

    def visit(name: str, c: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            if keep_parents:
                out[name] = F.to_json(c)
            for f in kind.fields:
                visit(f"{name}.{f.name}", c[f.name], f.dataType)
                leaves.append((f.name, f"{name}.{f.name}"))
        elif isinstance(kind, T.ArrayType):
            nested = isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType))
            if arrays == "json":
                out[name] = F.to_json(c)
            else:
                out[name] = F.when(F.size(c) > 0, F.to_json(c)) if nested else _scalar_list(c)
                out[f"{name}.count"] = F.when(F.size(c) > 0, F.size(c))
        else:
            out[name] = c

    for f in df.schema.fields:
        visit(f.name, F.col(f"`{f.name}`"), f.dataType)
    if leaf_alias:
        for short, full in leaves:
            if short not in out and full in out:
                out[short] = out[full]
    return df.select(*[c.alias(n) for n, c in out.items()])


PATHS = "depth int, paths array<struct<path:string,kind:string,type:string>>"


def record_paths(records: DataFrame, json_col: str) -> DataFrame:
    """Nesting depth and flattened paths of each record given as JSON text."""
    def walk(value, name, depth, found):
        if isinstance(value, dict) and value:
            if name:
                found.append((name, "object", ""))
            return max(walk(v, f"{name}.{k}" if name else k, depth + 1, found) for k, v in value.items())
        if isinstance(value, list):
            found.append((name or "value", "array", "" if not value else "str"))
            if value:
                found.append(((name or "value") + ".count", "scalar", "int"))
        else:
            empty = value is None or isinstance(value, dict)
            found.append((name or "value", "scalar", "" if empty else type(value).__name__))
        return depth

    def scan(batches):
        import json

        for pdf in batches:
            rows = []
            for text in pdf[json_col]:
                found: list = []
                depth = walk(json.loads(text), "", 1, found)
                rows.append((depth, [{"path": p, "kind": k, "type": t} for p, k, t in found]))
            yield pd.DataFrame(rows, columns=["depth", "paths"])

    return records.select(json_col).mapInPandas(scan, PATHS)


def structure_profile(records: DataFrame, json_col: str) -> DataFrame:
    """One row: records, depth, field paths, schema variants, array/object/scalar fields, columns of mixed type."""
    paths = record_paths(records, json_col)
    columns = F.filter("paths", lambda p: p["kind"] != "object")
    shape = F.array_join(F.array_sort(F.transform(columns, lambda p: p["path"])), "\n")
    totals = paths.groupBy(shape.alias("shape")).agg(
        F.count("*").alias("n"), F.max("depth").alias("d"), F.sum("depth").alias("s"))
    one = totals.agg(
        F.sum("n").alias("record_count"), F.max("d").alias("max_nesting_depth"),
        (F.sum("s") / F.sum("n")).alias("average_nesting_depth"), F.count("*").alias("schema_variant_count"))
    fields = paths.select(F.explode("paths").alias("p")).groupBy("p.path").agg(
        F.bool_or(F.col("p.kind") != "object").alias("is_column"),
        F.bool_or(F.col("p.kind") == "array").alias("is_array"),
        F.bool_or(F.col("p.kind") == "object").alias("is_object"),
        F.count_distinct(F.when(F.col("p.type") != "", F.col("p.type"))).alias("types"))
    kinds = fields.agg(
        F.count_if("is_column").alias("unique_field_paths"), F.count_if("is_array").alias("array_field_count"),
        F.count_if("is_object").alias("object_field_count"),
        F.count_if(F.col("is_column") & ~F.col("is_array")).alias("scalar_field_count"),
        F.count_if(F.col("is_column") & (F.col("types") > 1)).alias("type_inconsistency_count"))
    return side_by_side(one, kinds)
