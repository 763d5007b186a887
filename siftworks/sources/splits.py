"""Records that run over several lines, read in as many tasks as a file has splits.

A text scan cuts a file at a separator into pieces and gives each task a byte range of them. Where a record ends depends on
everything before: whether a quote is open, how deep the brackets are. Each range is summed up for either state it may start
in, the sums of one row per range give the true starts, and the pieces between two record ends are joined. Only records that
cross a range are exchanged by record; all others are put together where their range stands."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import RecordError, whole_json

RANGE = ["file", "block"]


def pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, block, at, value): the parts of the files between separators, ``at`` rising within each byte range."""
    text = spark.read.option("lineSep", sep).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def up_to(c: Column, before: bool = False) -> Column:
    """Sum over the pieces of a range up to each one, or before it."""
    rows = Window.partitionBy(*RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return F.coalesce(F.sum(c).over(rows), F.lit(0))


def over_earlier_ranges(c: Column) -> Column:
    rows = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(c).over(rows), F.lit(0))


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def joined(marked: DataFrame, sep: str) -> DataFrame:
    """(file, rec, value, ended): records numbered by file from 0; the last one of a file may lack its end. ``marked`` pieces carry ``ends``, whether a record ends with them,
    and of their range ``earlier``, the records that end before it, and ``fresh``, whether it starts with a new one."""
    numbered = marked.withColumn("id", up_to(F.col("ends").cast("long"), before=True))
    parts = numbered.groupBy(*RANGE, "id").agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"), F.bool_or("ends").alias("ended"), F.first("earlier").alias("earlier"), F.first("fresh").alias("fresh"))
    parts = parts.select(*RANGE, (F.col("earlier") + F.col("id")).alias("rec"), F.array_join("p.value", sep).alias("value"),
                         "ended",
                         (F.col("ended") & ((F.col("id") > 0) | F.col("fresh"))).alias("whole"))
    crossing = parts.filter(~F.col("whole")).groupBy("file", "rec").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("p"), F.bool_or("ended").alias("ended"))
    return parts.filter("whole").select("file", "rec", "value", "ended").unionAll(crossing.select("file", "rec", F.array_join("p.value", sep), "ended"))


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, value, ended): the records of delimited files as text, line breaks inside quotes kept. Quotes stand around whole
    fields and are doubled inside them, so a line ends a record when the quotes up to its end are even in number."""
    quotes = occurrences(F.col("value"), '"')
    lines = pieces(spark, path, "\n").withColumn("q", quotes).withColumn("upto", up_to(F.col("q")) % 2)
    ranges = lines.groupBy(*RANGE).agg((F.sum("q") % 2).alias("odd"), *[F.count_if(F.col("upto") == h).alias(f"ends{h}") for h in (0, 1)])
    ranges = ranges.withColumn("open", over_earlier_ranges(F.col("odd")) % 2)
    ranges = ranges.withColumn("earlier", over_earlier_ranges(F.when(F.col("open") == 0, F.col("ends0")).otherwise(F.col("ends1"))))
    marked = lines.join(ranges.select(*RANGE, "open", "earlier"), RANGE).withColumns({"ends": F.col("upto") == F.col("open"), "fresh": F.col("open") == 0})
    out = joined(marked.drop("q", "upto", "open"), "\n")
    return out.withColumn("value", F.regexp_replace("value", "\r$", ""))


# The order in which types are tried, with the form a text must have.
TYPE_FORMS = (("int", r"^[+-]?\d+$"), ("bigint", r"^[+-]?\d+$"), ("double", r"^\S+$"), ("date", r"^\d{4}-\d{2}-\d{2}$"),
              ("timestamp", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}\S*$"), ("boolean", r"(?i)^(true|false)$"))


def narrowest_types(df: DataFrame) -> T.StructType:
    """Per text column the first type that all its values have; text where none fits or no value is present. One job."""
    cells = [F.col(f"`{c}`") for c in df.columns]
    seen = df.agg(*[F.count_if(c.isNotNull() & ~(F.coalesce(F.rlike(c, F.lit(form)) & c.try_cast(kind).isNotNull(), F.lit(False)))).alias(f"{kind}{i}")
                    for i, c in enumerate(cells) for kind, form in TYPE_FORMS], *[F.count(c).alias(f"n{i}") for i, c in enumerate(cells)]).first()
    kinds = [next((k for k, _ in TYPE_FORMS if seen[f"n{i}"] and not seen[f"{k}{i}"]), "string") for i in range(len(cells))]
    return T.StructType([T.StructField(c, T.DataType.fromDDL(k)) for c, k in zip(df.columns, kinds)])


def read_split_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """Delimited text with a header line in every file, read by all tasks although fields hold line breaks. Blank lines are
    skipped. Without a schema the first file's header names the columns and one more pass types them; an empty input is an
    error. Needs quoting by RFC 4180; ``records.read_csv`` takes files with quotes inside bare fields."""
    found = csv_lines(spark, path)
    if schema is None:
        head = found.filter("rec = 0").select("file", "value").orderBy("file").first()
        if head is None:
            raise RecordError(f"{path} holds no rows")
        names = next(csv.reader([head["value"].removeprefix("﻿")], delimiter=sep))
        text = _parsed(found, sep, T.StructType([T.StructField(n, T.StringType()) for n in names]))
        schema = narrowest_types(text)
    df = _parsed(found, sep, schema)
    if df.isEmpty():
        raise RecordError(f"{path} holds no rows")
    return df


def _parsed(found: DataFrame, sep: str, schema: T.StructType) -> DataFrame:
    body = found.filter((F.col("rec") > 0) & (F.trim("value") != ""))
    return body.select(F.from_csv("value", _ddl(schema), {"sep": sep, "escape": '"', "multiLine": "true"}).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


# The lexical form of JSON strings.
ESCAPE = r"\\."
STRING = r'"[^"]*(?:"|\z)'
STRING_REST = r'^[^"]*(?:"|\z)'


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between closing braces with what each does in a range that starts outside (0) or inside (1) a string: ``out``,
    whether its brace closes something, and ``depth``, the brackets open after it, counted from the start of the range."""
    found = pieces(spark, path, "}").withColumn("b", F.regexp_replace("value", ESCAPE, "")).withColumn("q", occurrences(F.col("b"), '"'))
    found = found.withColumn("upto", up_to(F.col("q")) % 2)
    rest = F.when((F.col("upto") + F.col("q")) % 2 == 0, F.col("b"))  # starts like its range
    turned = F.when((F.col("upto") + F.col("q")) % 2 == 1, F.col("b"))
    for h, (outside, inside) in enumerate(((rest, turned), (turned, rest))):
        code = F.regexp_replace(F.coalesce(outside, F.regexp_replace(inside, STRING_REST, "")), STRING, "")
        found = found.withColumn("c", code).withColumn(f"out{h}", F.col("upto") == h)
        opened = occurrences(F.col("c"), "{") + occurrences(F.col("c"), "[") - occurrences(F.col("c"), "]") - F.col(f"out{h}").cast("int")
        found = found.withColumn("step", opened).withColumn(f"depth{h}", up_to(F.col("step")))
    return found.drop("b", "c", "step")


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, value, ended): the texts between the ends of the outermost list's objects, and the rest of each file."""
    found = json_pieces(spark, path)
    ranges = found.groupBy(*RANGE).agg((F.sum("q") % 2).alias("odd"), *[F.max_by(f"depth{h}", "at").alias(f"total{h}") for h in (0, 1)])
    ranges = ranges.withColumn("open", over_earlier_ranges(F.col("odd")) % 2)
    ranges = ranges.withColumn("depth", over_earlier_ranges(F.when(F.col("open") == 0, F.col("total0")).otherwise(F.col("total1"))))
    known = found.join(ranges.select(*RANGE, "open", "depth"), RANGE)
    ends = F.when(F.col("open") == 0, F.col("out0") & (F.col("depth0") + F.col("depth") == 1)).otherwise(F.col("out1") & (F.col("depth1") + F.col("depth") == 1))
    fresh = (F.col("open") == 0) & (F.col("block") == 0)  # a later range may start within the comma before an object
    known = known.select(*RANGE, "at", "value", ends.alias("ends"), fresh.alias("fresh"))
    counts = known.groupBy(*RANGE).agg(F.count_if("ends").alias("n"))
    counts = counts.select(*RANGE, over_earlier_ranges(F.col("n")).alias("earlier"))
    return joined(known.join(counts, RANGE), "}")


def read_split_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec_no, rec as VARIANT) of files that each hold one list of objects, cut at closing braces and read by all
    tasks, also when a file is a single line. An empty list has no rows. Anything else than a list of objects is an error;
    ``records.json_records`` takes other documents."""
    found = json_elements(spark, path)
    lead = F.when(F.col("rec") == 0, F.regexp_replace("value", r"^\x{feff}?\s*\[\s*(?=\{)", "")).otherwise(F.regexp_replace("value", r"^\s*,\s*(?=\{)", ""))
    text = F.when(F.col("ended") & (lead != F.col("value")), F.concat(lead, F.lit("}")))
    out = found.withColumn("item", F.get(whole_json(text), F.lit(0)))
    tail = F.rlike(F.col("value"), F.when(F.col("rec") == 0, F.lit(r"\A\x{feff}?\s*\[\s*\]\s*\z")).otherwise(F.lit(r"\A\s*\]\s*\z")))
    seen = out.agg(F.count_if(F.when(F.col("ended"), F.col("item").isNull()).otherwise(~tail)).alias("bad"),
                   F.count_if(~F.col("ended")).alias("tails"), F.count_if(F.col("rec") == 0).alias("files")).first()
    if seen["bad"] or seen["tails"] != seen["files"]:
        raise RecordError(f"{path} does not hold lists of objects only")
    return out.filter("ended").select("file", F.col("rec").alias("rec_no"), F.col("item").alias("rec"))
