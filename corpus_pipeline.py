"""Cleans a corpus and packs it: toxicity, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet below the shared folder
and hands the reread table to the next stage. All stages but the last return the columns of documents, further columns of
any name among them, untouched.

NULL, empty and very long texts go through every stage like others; an empty table stays empty. Repeated rows are judged
alike: of rows that share doc_id and text all stay or go, as a doc_id stands for one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from siftworks.llm.common import counted
from siftworks.llm.tokens import public_path
from siftworks.session import cut_lineage, table

#: Ids to drop that may be sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among ``ids``; a NULL doc_id is an id like any other."""
    gone = cut_lineage(ids.select(F.col("doc_id").alias("_gone")).distinct())
    gone = F.broadcast(gone) if counted(gone, BROADCAST_IDS) else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone")), "left_anti")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model, learned from the labelled documents, does not call toxic."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scores(model, spark, F.col("text")) < toxicity.THRESHOLD)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long line runs go; a document that consists of them altogether goes with them."""
    lines, gone = "_pipeline_lines", "_pipeline_gone"
    out = line_dedup.dedup(docs, counts=(lines, gone)).filter((F.col(gone) == 0) | (F.col(gone) < F.col(lines)))
    return out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of similar documents the one with the smallest doc_id stays."""
    found = jaccard_join.near_duplicates(docs)
    return _without(docs, found.filter("component_id <> doc_id"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in a training sequence."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL has no tokenizer and no trained lexicon; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
