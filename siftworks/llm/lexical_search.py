"""Ranked lexical search by presence masks.

A document matters to an item only through the item's terms, and what it can score is bounded by which of them it holds:

* One pass reads every whole text: its length in terms and how often it holds each term of any item. The number of
  documents, their total length and the document frequencies are counted over all of them.
* Documents meet the items block by block. In a block every term has a bitmap of the documents that hold it; the bitmaps
  of an item's terms, read across, give each document its mask of matched terms, and equal masks form a group.
* A mask's highest possible score takes each of its terms at the largest count the block has for the term and the shortest
  length in the group. Masks are evaluated by falling bound until the bound is below the score of the item's k-th best
  document so far; later masks cannot enter the list. The k best of an item are carried from block to block of a task.
* The k best of every task are merged, first within parts, then per item.

All arithmetic that decides is in 64-bit integers; a term's weight is one logarithm in double precision.

Rows: an item is all rows of one item_id (their terms together, each once); a NULL item_id is an item like any other. NULL
or empty texts have no terms: such documents do not count and such items have no rows. Every row of documents is a
document, repeated ones as well. Equal scores go by ascending key, a NULL key first; rows that agree in both are
interchangeable. Texts are read whole. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ascii_lower, slices, utf8

#: What stands between terms, as a pattern and as the same bytes.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP_BYTES = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_UPPER + _GAP_BYTES, _UPPER.lower() + b" " * len(_GAP_BYTES))
#: Bounds of what one task holds: items that are searched together, their different terms, and counts in a block.
ITEMS = 5_000
ITEM_TERMS = 20_000
BLOCK_COUNTS = 8_000_000


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and everything beyond ASCII; only A-Z are lower-cased."""
    return (text or b"").translate(_FOLD).split()


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item and its different terms, one row per term."""
    words = F.explode(F.split(ascii_lower(F.col(text)), GAPS)).alias("term")
    return items.select(F.col(item).alias("item"), words).filter("term <> ''").distinct()


def term_counts(docs: DataFrame, terms: list[bytes], key: str, text: str) -> DataFrame:
    """key, n (terms with repeats), and the ids (places in ``terms``) and counts of the given terms it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # at most ITEM_TERMS and one item's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        for batch in slices(batches):
            n, ids, counts = [], [], []
            for t in utf8(batch.column(1)):
                words = terms_of(t)
                n.append(len(words))
                held = np.fromiter((i for i in map(place.get, words) if i is not None), np.int32)
                i, c = np.unique(held, return_counts=True)
                ids.append(i.astype("<i4").tobytes())
                counts.append(c.astype("<i8").tobytes())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "ids", "counts"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n long, ids binary, counts binary")


def document_frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            total += np.bincount(held, minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])

    found = counted.select("ids").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(n_terms, np.int64)
    for r in found.collect():  # a row per term of the items
        df[r["term"]] = r["df"]
    return df


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's count adds per weight; grows with the count, falls with the document's m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Best:
    """The k best (score, key) of an item so far: higher scores first, equal ones by ascending key."""

    def __init__(self, k: int):
        self.k, self.scores, self.rows = k, np.empty(0, np.int64), np.empty((0, 2), np.int64)

    @property
    def least(self) -> int:
        """A document needs this score to enter the list."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """Keys as rows (0 for NULL else 1, key)."""
        s, r = np.concatenate([self.scores, scores]), np.concatenate([self.rows, keys])
        order = np.lexsort((r[:, 1], r[:, 0], -s))[: self.k]
        self.scores, self.rows = s[order], r[order]


def masks(bitmaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different masks (masks x terms) and the number of each document's mask, from one bitmap per term."""
    packed = np.packbits(bitmaps, axis=0, bitorder="little")
    wide = np.zeros((-(-len(packed) // 8) * 8, bitmaps.shape[1]), np.uint8)
    wide[: len(packed)] = packed
    words = np.ascontiguousarray(wide.T).view(np.uint64)
    if words.shape[1] == 1:
        _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    else:
        _, first, group = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return bitmaps[:, first].T, group.reshape(-1)


def search_block(tf: np.ndarray, m: np.ndarray, keys: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Enters a block's documents (tf: terms x documents) into one item's list. Returns how many documents were scored."""
    own = tf[terms]
    bitmaps = own > 0
    some = np.flatnonzero(bitmaps.any(axis=0))
    if not len(some):
        return 0
    present, group = masks(bitmaps[:, some])
    low = np.full(len(present), np.iinfo(np.int64).max)
    np.minimum.at(low, group, m[some])
    top = own.max(axis=1)
    # in doubles, rounded up beyond any error of the sum: a bound may be too high, never too low
    gain = weights * (1e9 * top) / (1000.0 * top + 20.0 * low[:, None])
    bound = np.where(present, gain, 0.0).sum(axis=1) * (1 + 1e-9) + 1
    order = np.argsort(-bound, kind="stable")
    members = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[members], np.arange(len(present) + 1))
    scored, at, step = 0, 0, 8
    while at < len(order) and bound[order[at]] >= best.least:
        chosen = order[at : at + step]
        chosen = chosen[bound[chosen] >= best.least]
        d = some[np.concatenate([members[starts[g] : starts[g + 1]] for g in chosen])]
        scores = (weights[:, None] * saturation(own[:, d], m[d])).sum(axis=0)
        enters = scores >= best.least
        best.add(scores[enters], keys[d[enters]])
        scored += len(d)
        at, step = at + step, step * 2
    return scored


def best_of_tasks(counted: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, total: int, n_terms: int, k: int, key: str) -> DataFrame:
    """place (of the item), key, score: the k best documents of every task for every item (term ids, weights)."""
    shared = counted.sparkSession.sparkContext.broadcast(items)
    width = max(64, BLOCK_COUNTS // max(1, n_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lists = [Best(k) for _ in own]
        for batch in slices(batches, width):
            n = batch.column(1).to_numpy()
            ids = [np.frombuffer(b, "<i4") for b in batch.column(2).to_pylist()]
            tf = np.zeros((n_terms, batch.num_rows), np.int64)
            tf[np.concatenate(ids), np.repeat(np.arange(batch.num_rows), [len(i) for i in ids])] = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i8")
            m = np.array([50 + (50 * x * n_docs) // total for x in n.tolist()], np.int64)
            there = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            keys = np.stack([there.astype(np.int64), batch.column(0).fill_null(0).cast(pa.int64()).to_numpy()], axis=1)
            for (terms, weights), best in zip(own, lists, strict=True):
                search_block(tf, m, keys, terms, weights, best)
        place = np.repeat(np.arange(len(own), dtype=np.int32), [len(b.scores) for b in lists])
        rows = np.concatenate([b.rows for b in lists] or [np.empty((0, 2), np.int64)])
        scores = np.concatenate([b.scores for b in lists] or [np.empty(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(rows[:, 1], mask=rows[:, 0] == 0), pa.array(scores)], names=["place", key, "score"])

    return counted.filter("n > 0").select(key, "n", "ids", "counts").mapInArrow(run, f"place int, `{key}` long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """The k best documents of every item: item, rank (from 1), key, score. Keys are integers.

    Items are searched in blocks whose different terms are bounded, each against all documents.
    """
    spark = docs.sparkSession
    pairs = cut_lineage(item_terms(items, item, text))
    per_item = cut_lineage(pairs.groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    kind = items.schema[item].dataType.simpleString()
    block: list = []
    known: dict[bytes, int] = {}
    parts: list[DataFrame] = []

    def searched() -> DataFrame:
        counted = cut_lineage(term_counts(docs, list(known), key, text))
        sums = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        n_docs, total = sums["docs"] or 0, sums["terms"] or 0
        weights = np.array([weight(n_docs, int(x)) for x in document_frequencies(counted, len(known))], np.int64)
        own = [(ids, weights[ids]) for ids in (np.array([known[t.encode()] for t in terms], np.int64) for _, terms in block)]
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"place int, item {kind}")
        found = best_of_tasks(counted, own, n_docs, max(total, 1), len(known), k, key)
        return cut_lineage(_first(found, k, key)).join(F.broadcast(names), "place").select("item", "rank", key, "score")

    for r in per_item.toLocalIterator():  # a block of items at a time; none is held longer
        fresh = [t for t in (x.encode() for x in r["terms"]) if t not in known]
        if block and (len(block) == ITEMS or len(known) + len(fresh) > ITEM_TERMS):
            parts.append(searched())
            block, known = [], {}
            fresh = [x.encode() for x in r["terms"]]
        known |= {t: len(known) + i for i, t in enumerate(fresh)}
        block.append((r["item"], r["terms"]))
    if block:
        parts.append(searched())
    if not parts:
        return docs.limit(0).select(F.lit(None).cast(kind).alias(item), F.lit(0).alias("rank"), F.col(key).cast("long").alias(key), F.lit(0).cast("long").alias("score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("item").alias(item), "rank", key, "score")


def _first(found: DataFrame, k: int, key: str) -> DataFrame:
    """The k best rows of every place, with their rank: first within 32 parts of a place, then over what is left."""
    order = (F.desc("score"), F.asc_nulls_first(key))
    parts = found.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(32)))
    some = parts.withColumn("_r", F.row_number().over(Window.partitionBy("place", "_part").orderBy(*order))).filter(F.col("_r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).filter(F.col("rank") <= k).select("place", "rank", key, "score")


#: The same ranking in SQL, for k = 50.
SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT d, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts
), lengths AS (
  SELECT d, count(*) AS n FROM words GROUP BY d
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), counts AS (
  SELECT d, term, count(*) AS tf FROM words GROUP BY d, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals
), scored AS (
  SELECT i.item_id, c.d, CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * l.n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM items i JOIN counts c USING (term) JOIN weights w USING (term) JOIN lengths l USING (d), totals t
  GROUP BY i.item_id, c.d
)
SELECT * FROM (
  SELECT s.item_id, CAST(row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, x.doc_id) AS INTEGER) AS rank, x.doc_id, s.score
  FROM scored s JOIN texts x USING (d) WHERE s.score > 0
) WHERE rank <= 50
"""
