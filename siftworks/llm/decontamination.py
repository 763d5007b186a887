"""Benchmark decontamination: item-sized windows, SimHash, multi-index Hamming search, exact verification.

1. A window can only be similar to an item if it shares a word shingle with one. Positions where a document holds a
   shingle of the benchmark give the windows of item size that align with an item there.
2. Each window and item gets a 64-bit SimHash of its words. Fingerprints are cut into ``BLOCKS`` blocks; two that differ
   in at most r bits differ in at most r // BLOCKS bits in some block. So an item, entered under each of its blocks and
   their neighbours of so many bits, meets every window within the radius: ``RADIUS`` for items of one shingle, whose
   similar windows are equal to them, and ``REACH`` for all longer ones.
3. A candidate is confirmed by the weighted Jaccard similarity of the two shingle multisets. Weight of a shingle:
   log(1 + items / items that hold it); shingles that the item doesn't hold weigh as if one item held them.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import cut_lineage
from .common import ascii_lower, counted, words_of

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 64, 8, 15
REACH = 23
#: Sums of weights in another order differ by less.
ROUNDING = 1e-9
#: Rows of benchmark shingles, and documents with candidates, that may be sent to every task.
BROADCAST_ROWS = 500_000


def _shingles(words: Column, size: int | Column) -> Column:
    """Hashes of the shingles of ``size`` words, in order."""
    if isinstance(size, int):
        at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
        return F.when(F.size(words) < size, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - size), at))
    out = _shingles(words, SHINGLE)
    for n in range(1, SHINGLE):
        out = F.when(size == n, _shingles(words, n)).otherwise(out)
    return out


def simhash(words: Column) -> Column:
    """64-bit SimHash of the words; a bit is set where more than half of the word hashes have it."""

    def bits(hashes: Column) -> Column:
        one = F.lit(1).cast("long")
        vote = lambda b: 2 * F.aggregate(hashes, F.lit(0), lambda a, x: a + F.getbit(x, b).cast("int")) > F.size(hashes)
        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when(vote(b), F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long"))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), bits)


def _block(fingerprint: Column, i: Column) -> Column:
    width = BITS // BLOCKS
    return F.call_function("shiftrightunsigned", fingerprint, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def items_of(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, n, words, size (of its shingles), shingles, fingerprint; items without words drop out, repeated rows count once."""
    words = words_of(ascii_lower(F.col(text)))
    out = benchmark.select(F.col(key).alias("item"), words.alias("words")).distinct().withColumn("n", F.size("words")).filter("n > 0")
    size = F.least(F.col("n"), F.lit(SHINGLE))
    return out.withColumn("size", size).withColumn("shingles", _shingles(F.col("words"), F.col("size"))).withColumn("fingerprint", simhash(F.col("words")))


def _weighted_items(items: DataFrame) -> DataFrame:
    """With the item's distinct shingles as (s, c, w) and the weight of unknown shingles."""
    total = F.lit(items.count()).cast("double")
    each = items.select("item", "words", F.explode("shingles").alias("s"))
    counts = each.groupBy("item", "words", "s").agg(F.count("*").alias("c"))
    held = each.select("item", "words", "s").distinct().groupBy("s").agg(F.count("*").alias("df"))
    entry = F.struct("s", "c", F.log1p(total / F.col("df")).alias("w"))
    entries = counts.join(held, "s").groupBy("item", "words").agg(F.collect_list(entry).alias("entries"))  # one item's words
    return items.join(entries, ["item", "words"]).withColumn("unknown", F.log1p(total))


def similarity(entries: Column, unknown: Column, shingles: Column) -> Column:
    """Weighted Jaccard of an item's shingle entries and a window's shingles."""
    in_both = F.transform(entries, lambda e: F.struct((F.size(F.filter(shingles, lambda x: x == e["s"]))).alias("k"), e["c"].alias("c"), e["w"].alias("w")))

    def ratio(both: Column) -> Column:
        total = lambda value: F.aggregate(both, F.lit(0.0), lambda a, e: a + value(e))
        common = total(lambda e: e["w"] * F.least(e["c"], e["k"]))
        own = total(lambda e: e["w"] * e["c"])
        known = total(lambda e: e["w"] * e["k"])
        others = unknown * (F.size(shingles) - F.aggregate(both, F.lit(0), lambda a, e: a + e["k"]))
        return common / (own + known + others - common)

    return let(in_both, ratio)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item it holds: key, item_id, start_word, n_words, similarity (its best window).

    A-Z count as a-z, words end at white space. NULL and empty texts or items hold nothing; items under five words count
    as one shingle; ties go to the first window; rows that repeat give one result; other columns are not read.
    """
    items = cut_lineage(items_of(benchmark))
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # 1 to 5
    shingles = items.select("size", "n", F.posexplode("shingles").alias("i", "s")).distinct()
    small = counted(shingles, BROADCAST_ROWS)
    words = words_of(ascii_lower(F.col(text)))
    # a text that occurs in many rows is many documents; a key in several rows is searched in each of them
    at = None
    for size in sizes:
        held = docs.select(F.col(key).alias("d"), F.posexplode(let(words, lambda w, size=size: _shingles(w, size))).alias("j", "s"))
        own = shingles.filter(F.col("size") == size).select("n", "i", "s")
        hit = held.join(F.broadcast(own) if small else own, "s").select("d", F.greatest(F.col("j") - F.col("i"), F.lit(0)).alias("start"), "n")
        at = hit if at is None else at.unionByName(hit)
    if at is None:
        return docs.select(F.col(key)).limit(0).selectExpr(f"`{key}`", "cast(null as bigint) item_id", "0 start_word", "0 n_words", "0D similarity")
    starts = cut_lineage(at.distinct().groupBy("d").agg(F.collect_list(F.struct("start", "n")).alias("starts")))  # within one text
    wanted = F.broadcast(starts) if counted(starts, BROADCAST_ROWS) else starts
    found = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(wanted, F.col("_k").eqNullSafe(F.col("d")))
    sliced = let(words_of(ascii_lower(F.col("_t"))), lambda w: F.transform("starts", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.slice(w, x["start"] + 1, x["n"]).alias("words"))))
    windows = found.select("d", F.explode(sliced).alias("x")).select("d", "x.*").filter(F.size("words") > 0)
    windows = cut_lineage(windows.withColumn("fingerprint", simhash(F.col("words"))))

    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    width = BITS // BLOCKS
    radius = lambda short: RADIUS if short else REACH
    masks = lambda short: F.array(*[F.lit(m) for m in range(1 << width) if m.bit_count() <= radius(short) // BLOCKS])
    short = F.col("n") <= SHINGLE
    entered = items.select("item", "words", "n", "fingerprint", block.alias("block"))
    entered = entered.select("item", F.col("words").alias("item_words"), "n", F.col("fingerprint").alias("item_print"), "block", F.explode(F.transform(F.when(short, masks(True)).otherwise(masks(False)), lambda x: _block(F.col("fingerprint"), F.col("block")).bitwiseXOR(x))).alias("value"))
    asked = windows.select("d", "start", "n", "words", "fingerprint", block.alias("block")).withColumn("value", _block(F.col("fingerprint"), F.col("block")))
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= F.when(short, radius(True)).otherwise(radius(False))
    pairs = asked.join(entered, ["n", "block", "value"]).filter(close).select("d", "start", "n", "words", "item", "item_words").distinct()
    weighted = _weighted_items(items).select(F.col("item").alias("_i"), F.col("words").alias("_iw"), "size", "entries", "unknown")
    judged = pairs.join(weighted, F.col("item").eqNullSafe(F.col("_i")) & (F.col("item_words") == F.col("_iw")))
    own = let(F.col("words"), lambda w: _shingles(w, F.col("size")))
    judged = judged.withColumn("similarity", let(own, lambda s: similarity(F.col("entries"), F.col("unknown"), s))).filter(F.col("similarity") >= least - ROUNDING)
    best = judged.groupBy("d", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n")).alias("b"))
    return best.select(F.col("d").alias(key), F.col("item").alias("item_id"), (-F.col("b.start")).alias("start_word"), F.col("b.n").alias("n_words"), F.col("b.similarity").alias("similarity"))
