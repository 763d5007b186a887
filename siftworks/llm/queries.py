"""The registered query of every operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..session import table
from . import bpe_codec, decontamination, jaccard_join, lexical_search, license_scans, line_dedup, packing, quality_rules, secret_scans, token_counts, toxicity, url_filters, whitening
from .common import ORACLES, QUERIES, query
from .tokens import public_path, public_pattern

__all__ = ["ORACLES", "QUERIES"]


@query("op1_license_scans")
def licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scans.scan(docs, license_scans.train(docs))


@query("op2_token_counts")
def token_counts_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_by_section(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


@query("op3_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op4_line_dedup")
def lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text")).alias("text_crc32"))


@query("op7_decontamination")
def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_url_filters", url_filters.SQL)
def filtered_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(url_filters.dated_captures(pages), url_filters.derived_entries(pages))


@query("op6_quality_rules")
def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op8_secret_scans")
def secrets_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_index", F.md5("value").alias("value_md5"), F.length("value").alias("n_chars"), "label", "score", "is_secret")


@query("op9_jaccard_join")
def near_duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_packing")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


@query("op11_whitening")
def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_bpe_codec")
def bpe_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    file, pattern = public_path("byte_bpe_multi_50k.tiktoken"), public_pattern()
    both = bpe_codec.decode(bpe_codec.encode(table(spark, sf_dir, "documents"), file, pattern), file)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_lexical_search", lexical_search.SQL)
def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
