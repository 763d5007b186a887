"""Removes later copies of repeated line runs, found with a suffix array over line ids.

Sequence: the non-blank lines of each document, in order of (doc_id, line). A line that stands once breaks the sequence,
as no repeated run holds it, so only repeated lines are ever sorted.

Suffix array: ``rank`` of a suffix at level k is the number of suffixes whose first 2^k lines sort before its own. Level
k + 1 sorts the pairs (rank at p, rank at p + 2^k): prefix doubling. The distinct pairs are range-partitioned and
counted, so no task orders the whole array, and suffixes whose prefix has become unique leave.

LCP intervals: suffixes with the same first m lines are one interval of the array. With 2^k <= m, they are the ones with
equal ranks at p and at p + m - 2^k of level k. A run counts when it has at least ``min_words`` words. Every line of
such a run lies in a shortest counting run from its first line on or up to its last line, so the intervals of these two
depths per line cover exactly the union of all maximal repeated runs that count, and depth never exceeds ``min_words``.
In each interval the first member stays; the lines of all others are deleted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..operators.ordering import running_totals
from ..session import cut_lineage
from .common import SPACES, counted, words_of

MIN_WORDS = 50
#: Runs to delete that may be sent to every task; more are joined by a shuffle.
BROADCAST_RUNS = 1_000_000


def _solid_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _doc_key(key: Column) -> Column:
    """The key, or the smallest number where it is NULL."""
    return F.coalesce(key.cast("long"), F.lit(-(2**63)))


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.lit(7), F.coalesce(text, F.lit("")))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that stand twice or more: d, t (row key), pos, words, id (level 0 rank)."""
    line = F.posexplode(_solid_lines(F.col(text)))
    lines = docs.select(_doc_key(F.col(key)).alias("d"), _text_key(F.col(text)).alias("t"), line.alias("pos", "line"))
    # repeated rows are one document
    lines = cut_lineage(lines.select("d", "t", "pos", F.xxhash64(F.lit(1), "line").alias("a"), F.xxhash64(F.lit(2), "line").alias("b"), F.size(words_of(F.col("line"))).alias("words")))
    counts = lines.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1")
    return _ranked(lines, counts, ["a", "b"]).dropDuplicates(["d", "t", "pos"])


def _ranked(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key stands in ``counts``, with the number of rows before that key as ``rank``."""
    order = running_totals(counts, [F.col(k) for k in keys], {"upto": F.col("n")})
    ranks = cut_lineage(order.select(*keys, (F.col("upto").cast("long") - F.col("n")).alias("rank")))
    return rows.join(ranks, keys)


def suffix_levels(first: DataFrame, top: int) -> DataFrame:
    """Ranks of all levels up to ``top``: d, t, pos, level, rank."""
    level = cut_lineage(first.select("d", "t", "pos", "rank"))
    out = level.withColumn("level", F.lit(0))
    for k in range(top):
        ahead = level.select("d", "t", (F.col("pos") - F.lit(2**k)).alias("pos"), F.col("rank").alias("rank_2"))
        pairs = cut_lineage(level.withColumnRenamed("rank", "rank_1").join(ahead, ["d", "t", "pos"]))
        counts = pairs.groupBy("rank_1", "rank_2").agg(F.count("*").alias("n")).filter("n > 1")
        level = cut_lineage(_ranked(pairs, counts, ["rank_1", "rank_2"]).select("d", "t", "pos", "rank"))
        out = out.unionByName(level.withColumn("level", F.lit(k + 1)))
        if level.isEmpty():
            break
    return out


def counting_runs(first: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Shortest runs with enough words from each line on and up to each line: d, t, pos, m."""
    rows = Window.partitionBy("d", "t").orderBy("pos")
    chained = first.select("d", "t", "pos", "words").withColumn("chain", F.col("pos") - F.row_number().over(rows))
    chain = Window.partitionBy("d", "t", "chain").orderBy("pos")
    sums = chained.withColumn("upto", F.sum("words").over(chain)).withColumn("before", F.col("upto") - F.col("words"))
    ahead = F.collect_list("upto").over(chain.rowsBetween(0, min_words - 1))
    behind = F.collect_list("before").over(chain.rowsBetween(1 - min_words, 0))
    sums = sums.withColumn("_ahead", ahead).withColumn("_behind", behind)
    short = F.size(F.filter("_ahead", lambda c: c < F.col("before") + min_words))
    far = F.size(F.filter("_behind", lambda b: b <= F.col("upto") - min_words))
    onward = F.when(short < F.size("_ahead"), F.struct(F.col("pos").alias("pos"), (short + 1).alias("m")))
    length = F.size("_behind") - far + 1
    backward = F.when(far > 0, F.struct((F.col("pos") - length + 1).alias("pos"), length.alias("m")))
    run = F.explode(F.array_compact(F.array(onward, backward)))
    return sums.select("d", "t", run.alias("_r")).select("d", "t", "_r.pos", "_r.m").distinct()


def later_copies(first: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs that stand earlier too: d, t, pos, m."""
    top = max(0, math.floor(math.log2(max(1, min_words))))
    levels = cut_lineage(suffix_levels(first, top))
    runs = counting_runs(first, min_words).withColumn("level", F.floor(F.log2("m")).cast("int"))
    head = levels.select("d", "t", "pos", "level", F.col("rank").alias("r1"))
    tail = levels.select("d", "t", F.col("pos").alias("_tail"), "level", F.col("rank").alias("r2"))
    at_tail = runs.withColumn("_tail", (F.col("pos") + F.col("m") - F.pow(F.lit(2.0), F.col("level"))).cast("int"))
    named = cut_lineage(at_tail.join(head, ["d", "t", "pos", "level"]).join(tail, ["d", "t", "_tail", "level"]).select("d", "t", "pos", "m", "r1", "r2"))
    intervals = named.groupBy("m", "r1", "r2").agg(F.min(F.struct("d", "t", "pos")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    found = named.join(cut_lineage(intervals), ["m", "r1", "r2"])
    same = (F.col("d") == F.col("f.d")) & (F.col("t") == F.col("f.t")) & (F.col("pos") == F.col("f.pos"))
    return found.filter(~same).select("d", "t", "pos", "m")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """Rows of ``docs`` with later copies cut from ``text``, and n_lines, n_removed (non-blank lines), named by ``counts``.

    Order of copies: key, then line; the first stays. Blank lines stay where they are in a text that loses no line and go
    with it otherwise. NULL texts stay NULL, empty texts empty. Rows equal in key and text are one document: all get the
    same text. Rows with a NULL key come first, in the order of their texts' hashes. The counts replace columns of those
    names. Texts of any length are split whole; an empty table gives an empty result.
    """
    first = cut_lineage(repeated_lines(docs, key, text))
    copies = cut_lineage(later_copies(first, min_words))
    span = F.flatten(F.collect_list(F.sequence(F.col("pos"), F.col("pos") + F.col("m") - 1)))
    gone = copies.groupBy("d", "t").agg(F.array_distinct(span).alias("_gone")).withColumnsRenamed({"d": "_gone_d", "t": "_gone_t"})  # at most the lines of one text
    if counted(copies, BROADCAST_RUNS):
        gone = F.broadcast(gone)
    kept = [c for c in docs.columns if c.lower() not in counts]
    base = docs.select(*kept)
    joined = base.join(gone, (_doc_key(F.col(key)) == F.col("_gone_d")) & (_text_key(F.col(text)) == F.col("_gone_t")), "left")
    all_lines = _solid_lines(F.col(text))
    rest = let(all_lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)), "\n"))
    new_text = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(rest)
    found = (F.size(all_lines).cast("long"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    return joined.select(*[new_text.alias(c) if c == text else base[c] for c in kept], *[v.alias(k) for k, v in zip(counts, found, strict=True)])
