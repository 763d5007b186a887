"""Quality rules with thresholds that follow the data.

Base figures of a text are array functions over its words; no row leaves its task for them. A quantile sketch counts
values in buckets whose bounds grow by a constant factor (relative error ``GAMMA`` - 1). Sketches of (language, source)
merge by adding counts, so a group that is too small uses the sketch of its language, and that one the sketch of all
rows. Fences lie three quartile ranges beyond the quartiles; a least range per figure keeps groups without any spread
from failing everything else. The filter joins the fences back to the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import cut_lineage
from .common import SPACES, words_of

GAMMA = 1.02
FENCE = 3.0
MIN_ROWS = 100
#: Least quartile range of each figure. Figures are per thousand, word length is in hundredths of a character.
LEAST_RANGE = {"symbols": 5.0, "repeats": 40.0, "dup_lines": 60.0, "capitals": 25.0, "word_length": 40.0}
TWO_SIDED = ("word_length",)
MIN_WORDS = 50


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows that stand twice or more in the text."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(positions: Column) -> Column:
        steps = F.transform(positions, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(positions, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def marked(ordered: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(ordered, k)["h"] == e["h"], F.lit(False))
        hit = F.filter(ordered, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return let(F.sort_array(F.transform(hit, lambda e: e["i"])), covered)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, marked)).otherwise(0)

    return F.when(F.size(words) < 3, 0).otherwise(let(hashes, count))


def base_figures(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_chars, n_lines. NULL counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    by_words = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("rep")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    out = docs.select(
        *keys,
        by_words.alias("_w"),
        by_lines.alias("_l"),
        F.length(F.translate(t, SPACES, "")).alias("word_chars"),
        _without(t, "#*$%&|<>").alias("n_symbols"),
        _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        F.length(t).alias("n_chars"),
    )
    long = lambda c: F.col(c).cast("long")
    return out.select(
        *keys,
        long("_w.n").alias("n_words"), long("word_chars").alias("word_chars"), long("n_symbols").alias("n_symbols"),
        long("_l.dup").alias("n_dup_lines"), long("_w.rep").alias("n_repeat_words"),
        long("n_capitals").alias("n_capitals"), long("n_chars").alias("n_chars"), long("_l.n").alias("n_lines"),
    )


def shares() -> dict[str, Column]:
    per = lambda a, b, k: k * F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols": per("n_symbols", "n_chars", 1000.0),
        "repeats": per("n_repeat_words", "n_words", 1000.0),
        "dup_lines": per("n_dup_lines", "n_lines", 1000.0),
        "capitals": per("n_capitals", "n_chars", 1000.0),
        "word_length": per("word_chars", "n_words", 100.0),
    }


def sketch(df: DataFrame, values: dict[str, Column], groups: tuple[str, ...]) -> DataFrame:
    """Counts by group, figure and bucket; adding counts merges sketches. Bucket -1 holds zero."""
    bucket = lambda v: F.when(v <= 0, -1).otherwise(F.greatest(F.lit(0), F.floor(F.log(v) / math.log(GAMMA)).cast("int")))
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), bucket(v).alias("bucket")) for k, v in values.items()]))
    return df.select(*groups, entries.alias("_e")).groupBy(*groups, "_e.figure", "_e.bucket").agg(F.count("*").alias("n"))


def quartiles(sketched: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """n, q25 and q75 of every group and figure."""
    keys = [*groups, "figure"]
    merged = sketched.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys).orderBy("bucket")
    run = merged.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    value = F.when(F.col("bucket") < 0, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") + 0.5))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    return run.groupBy(*keys).agg(F.max("total").alias("n"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def fences(figures: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Lower and upper fence by lang, source and figure."""
    sketched = sketch(figures, shares(), ("lang", "source"))
    own = quartiles(sketched, ("lang", "source"))
    lang = quartiles(sketched, ("lang",)).select(F.col("lang").alias("_lang"), F.col("figure").alias("_f1"), F.struct("n", "q25", "q75").alias("_by_lang"))
    every = quartiles(sketched, ()).select(F.col("figure").alias("_f2"), F.struct("n", "q25", "q75").alias("_all"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("figure") == F.col("_f1"))).join(every, F.col("figure") == F.col("_f2"))
    used = F.when(F.col("n") >= min_rows, F.struct("n", "q25", "q75")).when(F.col("_by_lang.n") >= min_rows, F.col("_by_lang")).otherwise(F.col("_all"))
    least = F.create_map(*[F.lit(x) for kv in LEAST_RANGE.items() for x in kv])
    spread = F.greatest(F.col("_u.q75") - F.col("_u.q25"), F.element_at(least, F.col("figure"))) * FENCE
    low = F.when(F.col("figure").isin(*TWO_SIDED), F.col("_u.q25") - spread)
    return joined.withColumn("_u", used).select("lang", "source", "figure", low.alias("low"), (F.col("_u.q75") + spread).alias("high"))


def judge(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, lang, source, base figures, base_failed, kept.

    A NULL or empty text has no words and fails the base rule; NULL languages and sources are groups of their own; rows
    that repeat are judged each; other columns are not read; an empty table gives an empty result.
    """
    figures = cut_lineage(base_figures(docs))
    limits = fences(figures).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("figure", F.struct("low", "high")))).alias("_limits"))  # five figures
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_limits")
    joined = figures.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for name, value in shares().items():
        fence = F.element_at(F.col("_limits"), F.lit(name))
        inside = inside & F.coalesce(value <= fence["high"], F.lit(True)) & F.coalesce(value >= fence["low"], F.lit(True))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & inside).drop("_lang", "_source", "_limits")
