"""Exact Jaccard join of word-shingle sets with set-relation skipping.

Sets are 64-bit hashes of five-word shingles; a set is known by the 64-bit digest of its hashes, so exact copies are one
set from the start (with n sets, two different ones meet by chance with probability n^2 / 2^65).

* Order of shingles: rare before frequent, by hash among each. All shingles of all sets are counted. The list of
  frequent shingles sent to the tasks is bounded by ``MAX_FREQUENT``: with more, the least frequent of them count as
  rare, which changes the order, not the result.
* Index: two sets can only reach the threshold t if they share a shingle among the first n - ceil(t n) + 1 of both. A
  list holds the (set, size, position) entries of one shingle. Lists of frequent shingles are salted until they are
  rows.
* Skipping inside lists: entries are put into blocks by size and position. A block pair whose best entries cannot reach
  the overlap bound, or whose sizes differ too much, is skipped whole.
* Skipping by set relations: in every list the members of a size class first meet one leader, the
  set with the fewest rarer shingles; each set is checked against
  the leader it meets most. Sets left over elect new leaders among themselves, for as long as rounds link a good part of
  them. A set linked to its leader belongs to the leader's cluster, its difference from the leader
  is known, and its other answers derive from the leader's: |y - z| lies within |x - w| -+ (|x - y| + |w - z|) for leaders
  x, w. Leaders of different clusters that share a list are checked once; members are compared only where these bounds
  leave the answer open. Clusters of one component never meet, and in crowded lists the leaders' sketches are part of the
  join's condition, so clusters that these bounds keep apart give no row.

* Verification: a set of n shingles has an odd sketch of 2n to 4n bits, bit i telling whether an odd number of its shingles
  hash to i. Every bit in which two sketches differ is a shingle in one set only, so the differing bits are a lower bound
  of |x - y|. Only pairs that this bound leaves open have their sets fetched and compared shingle by shingle; for the
  others the bound takes the place of the difference.

Documents need components, so pairs inside a component are never compared again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_rows, counted, mixed, shingle_sets, slices, utf8
from .components import components

SHINGLE = 5
PERCENT = 80
#: A shingle is frequent if more sets hold it.
FREQUENT = 64
MAX_FREQUENT = 1_000_000
BLOCK_SHINGLES = 500_000
#: Texts or sets that are sent to Python at a time.
BATCH_ROWS = 500
#: Documents whose sets are compared that may be sent to every task as ids.
BROADCAST_IDS = 1_000_000
#: Lists with more blocks than this carry their clusters' sketches into the join; shorter ones give few rows without.
CROWDED = 16
#: Leader rounds go on while they link at least this share of the sets they try.
WORTH_A_ROUND = 0.05


#: Upper half of a hash.
_HIGH = np.uint64(0xFFFFFFFF00000000)


def odd_sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles per bit; the number of bits is a power of two, so that sketches fold to each other's size."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _differing(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _folded(odd: bytes, n: int, percent: int) -> np.ndarray:
    """A sketch folded to the power of two of bits that is at least four times the difference a link allows between sets of
    this size: 64-bit words, a power of two of them."""
    words, most = np.frombuffer(odd, np.int64), max(64, 4 * (100 - percent) * 2 * n // (100 + percent))
    while len(words) * 32 >= most and len(words) > 1:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _prints(sketches: DataFrame, percent: int) -> DataFrame:
    """cluster and print of leaders, from sig, n and odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_folded(o, n, percent) for n, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["cluster", "print"])

    return sketches.select("sig", "n", "odd").mapInArrow(run, "cluster long, print array<long>")


def _differing_bits(x: Column, y: Column) -> Column:
    """Differing bits of two folded sketches, of one size or one twice the other's. Compared sets differ less than twofold
    in size, as their leaders do."""

    def halved(c: Column, other: Column) -> Column:
        half = F.floor(F.size(c) / 2).cast("int")
        folded = F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(c) > F.size(other), folded).otherwise(c)

    bits = F.zip_with(halved(x, y), halved(y, x), lambda p, q: F.coalesce(F.bit_count(p.bitwiseXOR(q)), F.lit(0)))
    return F.aggregate(bits, F.lit(0), lambda total, k: total + k)


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """key, n_shingles, sig and odd sketch (NULL for texts without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(shingle_sets(utf8(batch.column(1)), size))
            n = pa.array([len(s) for s in found], pa.int64())
            sig = pa.array([digest(s) if len(s) else None for s in found], pa.int64())
            odd = pa.array([odd_sketch(s) if len(s) else None for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, sig, odd], names=[key, "n_shingles", "sig", "odd"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_shingles long, sig long, odd binary")


def _new_sets(batch: Iterable[bytes | None], size: int, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Sets that this task has not met lately."""
    for s in shingle_sets(batch, size):
        if len(s) and (d := digest(s)) not in seen:
            if len(seen) > 500_000:
                seen.clear()
            seen.add(d)
            yield d, s


def _dealt(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket that holds its part of every column as bytes."""
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    cut = [(a, b) for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True)]
    blobs = {c: [v[a:b].tobytes() for a, b in cut] for c, v in ((c, v[order]) for c, v in columns.items())}
    return pa.RecordBatch.from_pydict({"bucket": pa.array(names.astype(np.int64))} | {c: pa.array(v, pa.binary()) for c, v in blobs.items()})


def _named(s: np.ndarray, mask: np.uint64) -> np.ndarray:
    return s & (_HIGH | mask)


def _among(s: np.ndarray, often: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Which shingles are frequent."""
    if not len(often):
        return np.zeros(len(s), bool)
    names = _named(s, mask)
    return often[np.minimum(np.searchsorted(often, names), len(often) - 1)] == names


def frequent_shingles(docs: DataFrame, buckets: int, size: int = SHINGLE, text: str = "text") -> np.ndarray:
    """Sorted names of the shingles that more than FREQUENT sets hold, the most frequent MAX_FREQUENT of them. A name is the
    bucket and the upper half of a hash: shingles of one name would count together, which changes the order alone."""
    mask = np.uint64(buckets - 1)

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)  # a hot shingle is one entry from here on
        return _dealt(values & mask, {"s": (values >> np.uint64(32)).astype(np.uint32), "n": counts.astype(np.uint32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seen = [], 0, set()
        for batch in slices(batches):
            for _, s in _new_sets(utf8(batch.column(0)), size, seen):
                parts.append(_named(s, mask))
                held += len(parts[-1])
                if held > BLOCK_SHINGLES:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.frombuffer(b, np.uint32) for b in group["s"]])
        counts = np.concatenate([np.frombuffer(b, np.uint32) for b in group["n"]])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        total = np.add.reduceat(counts.astype(np.int64), starts)
        often = total > FREQUENT
        names = values[starts][often].astype(np.uint64) << np.uint64(32) | np.uint64(group["bucket"].iloc[0])
        return pd.DataFrame({"s": names.view(np.int64), "n": total[often]})

    blocks = docs.select(text).mapInArrow(run, "bucket long, s binary, n binary")
    top = blocks.groupBy("bucket").applyInPandas(count, "s long, n long").orderBy(F.desc("n"), "s").limit(MAX_FREQUENT)
    return np.sort(np.array([r["s"] for r in top.select("s").collect()], np.int64).view(np.uint64))


def lists(docs: DataFrame, frequent: np.ndarray, buckets: int, size: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """Entries of the lists with two or more sets: s (shingle), sig, n, pos."""
    mask = np.uint64(buckets - 1)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MAX_FREQUENT numbers

    def flush(parts: list[tuple[int, int, np.ndarray]], often: np.ndarray) -> pa.RecordBatch:
        s = np.concatenate([p[2] for p in parts])
        lengths = [len(p[2]) for p in parts]
        sig = np.repeat(np.array([p[0] for p in parts], np.int64), lengths)
        n = np.repeat(np.array([p[1] for p in parts], np.uint32), lengths)
        pos = np.concatenate([np.arange(k, dtype=np.uint32) for k in lengths])
        hot = _among(s, often, mask)
        bucket = np.where(hot, mixed(s ^ mixed(sig.view(np.uint64))) & mask, s & mask)  # frequent shingles are salted
        return _dealt(bucket, {"s": s, "sig": sig, "n": n, "pos": pos, "hot": hot})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, parts, held, seen = shared.value, [], 0, set()
        for batch in slices(batches):
            for d, s in _new_sets(utf8(batch.column(0)), size, seen):
                need = len(s) - (percent * len(s) + 99) // 100 + 1
                hot = _among(s, often, mask)
                parts.append((d, len(s), np.concatenate([s[~hot], s[hot]])[:need]))
                held += need
                if held > BLOCK_SHINGLES // 4:
                    yield flush(parts, often)
                    parts, held = [], 0
        if held:
            yield flush(parts, often)

    kinds = {"s": np.uint64, "sig": np.int64, "n": np.uint32, "pos": np.uint32, "hot": np.bool_}

    def shared_ones(group: pd.DataFrame) -> pd.DataFrame:
        e = {c: np.concatenate([np.frombuffer(b, k) for b in group[c]]) for c, k in kinds.items()}
        order = np.lexsort((e["sig"], e["s"]))
        e = {c: v[order] for c, v in e.items()}
        fresh = np.append(True, (e["s"][1:] != e["s"][:-1]) | (e["sig"][1:] != e["sig"][:-1]))  # copies met by other tasks
        e = {c: v[fresh] for c, v in e.items()}
        same = e["s"][1:] == e["s"][:-1]
        many = e["hot"] | np.append(same, False) | np.append(False, same)
        return pd.DataFrame({"s": e["s"][many].view(np.int64), "sig": e["sig"][many], "n": e["n"][many].astype(np.int32), "pos": e["pos"][many].astype(np.int32)})

    blocks = docs.select(text).mapInArrow(run, "bucket long, s binary, sig binary, n binary, pos binary, hot binary")
    return blocks.groupBy("bucket").applyInPandas(shared_ones, "s long, sig long, n int, pos int")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b with diff (a lower bound of the shingles in one set only) and open (whether it allows a link)."""
    of = lambda c: sketches.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"_o{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            diff = np.array([_differing(x, y) for x, y in zip(*(batch.column(i).to_pylist() for i in (4, 5)), strict=True)], np.int64)
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            may = (100 + percent) * diff <= (100 - percent) * total
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(diff), pa.array(may)], names=["a", "b", "diff", "open"])

    joined = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "_oa", "_ob")
    return cut_lineage(joined.mapInArrow(run, "a long, b long, diff long, open boolean"))


def _fetched(docs: DataFrame, ids: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """sig and shingles of the sets whose documents ``ids`` (_k, _sig) names; a key that repeats gives a set twice."""
    ids = F.broadcast(ids) if counted(ids, BROADCAST_IDS) else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wanted = batch.column(0).to_pylist()
            found = [(d, s.tobytes()) for d, s in zip(wanted, shingle_sets(utf8(batch.column(1)), size), strict=True) if len(s) and digest(s) == d]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["sig", "shingles"])

    texts = docs.select(F.col(key).alias("_k"), text).join(ids, "_k").select("_sig", text)
    return cut_lineage(texts.mapInArrow(run, "sig long, shingles binary"))


def _overlap(pairs: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b with diff (shingles in one set only) and linked."""
    left = stored.select(F.col("sig").alias("a"), F.col("shingles").alias("_sa"))
    right = stored.select(F.col("sig").alias("b"), F.col("shingles").alias("_sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            total = np.array([len(x) + len(y) for x, y in both], np.int64)
            c = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in both], np.int64)
            linked = 100 * c >= percent * (total - c)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (total - 2 * c, linked))], names=["a", "b", "diff", "linked"])

    if counted(pairs, BROADCAST_IDS):  # only the sets asked for are shuffled
        left = left.join(F.broadcast(pairs), "a")
        right = right.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    else:
        left = left.join(pairs, "a")
    joined = left.join(right, "b").select("a", "b", "_sa", "_sb")
    return cut_lineage(joined.mapInArrow(run, "a long, b long, diff long, linked boolean"))


def _compatible(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Sizes and positions that leave room for the overlap the threshold asks for."""
    room = F.least(n1 - p1, n2 - p2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * room >= percent * (n1 + n2))


def _reachable(common: Column, n1: Column, last1: Column, n2: Column, last2: Column, percent: int) -> Column:
    """Shingles in common up to the last common positions leave room for the overlap the threshold asks for."""
    return (100 + percent) * (common + F.least(n1 - 1 - last1, n2 - 1 - last2)) >= percent * (n1 + n2)


def _band(n: Column, percent: int) -> Column:
    """Sizes of one band differ by less than the threshold allows."""
    return F.floor(F.log(n.cast("double")) / -np.log(percent / 100)).cast("int")


def _block_pairs(entries: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Cluster pairs (a < b) of different labels among entries s, sig, n, pos, cluster, away, label that share a list, found
    block by block. Linked members of two clusters share no label and pass every condition in each list they share."""
    width = 16
    blocks = entries.withColumn("band", _band(F.col("n"), percent)).withColumn("pb", F.floor(F.col("pos") / width))
    heads = blocks.groupBy("s", "cluster", "label", "band", "pb").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("p"), F.max("away").alias("r"))
    alone = entries.groupBy("cluster").agg((F.min("sig") == F.max("sig")).alias("alone"))
    heads = cut_lineage(heads.join(alone, "cluster"))
    crowds = cut_lineage(heads.groupBy("s").count().filter(F.col("count") > CROWDED).select("s"))
    crowded = heads.join(crowds, "s", "left_semi")
    leaders = sketches.join(crowded.select(F.col("cluster").alias("sig")).distinct(), "sig", "left_semi")
    crowded = cut_lineage(crowded.join(_prints(leaders, percent), "cluster"))
    columns = ("cluster", "label", "band", "pb", "lo", "hi", "p", "alone", "r")
    near = F.abs(F.col("band") - F.col("band2")) <= 1
    sizes = (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo"))
    room = F.least(F.col("hi") - F.col("p"), F.col("hi2") - F.col("p2"))
    reach = (100 + percent) * room >= percent * (F.col("lo") + F.col("lo2"))
    able = (F.col("cluster") < F.col("cluster2")) & (F.col("label") != F.col("label2")) & near & sizes
    apart = _differing_bits(F.col("print"), F.col("print2")) - F.col("r") - F.col("r2")
    close = (100 + percent) * apart <= (100 - percent) * (F.col("hi") + F.col("hi2"))

    def met_in(some: DataFrame, more: tuple[str, ...], condition: Column) -> DataFrame:
        other = some.select(F.col("s").alias("s2"), *[F.col(c).alias(f"{c}2") for c in (*columns, *more)])
        return some.join(other, (F.col("s") == F.col("s2")) & condition).drop("print", "print2")

    found = met_in(heads.join(crowds, "s", "left_anti"), (), able).unionByName(met_in(crowded, ("print",), able & close))
    met = found.groupBy(F.col("cluster").alias("a"), F.col("cluster2").alias("b")).agg(
        F.count("*").alias("m"), F.max(reach).alias("reach"), F.min(F.col("alone") & F.col("alone2")).alias("alone"), F.max("p").alias("p1"), F.max("p2").alias("p2"),
        *[f(c).alias(f"{c}_") for f, names in ((F.max, ("hi", "hi2")), (F.min, ("lo", "lo2"))) for c in names],
    )
    # m counts a list once per block pair, at least as often as there are shingles in common
    # beyond the prefix that ends first, two sets have at most its set's other shingles in common
    behind = (F.greatest("hi_", "hi2_") * percent + 99) / 100 - 1
    enough = (100 + percent) * (F.col("m") + behind) >= percent * (F.col("lo_") + F.col("lo2_"))
    single = ~F.col("alone") | _reachable(F.col("m"), F.col("hi_"), F.col("p1"), F.col("hi2_"), F.col("p2"), percent)
    return met.filter(F.col("reach") & enough & single).select("a", "b")


def _led(entries: DataFrame, percent: int) -> DataFrame:
    """For sets of entries s, sig, n, pos, label the leader they meet most among those of another label: a, b."""
    # of each size class of a list the set with the fewest rarer shingles, as copies differ by rare ones
    banded = entries.withColumn("band", _band(F.col("n"), percent))
    first = banded.groupBy("s", "band").agg(F.min(F.struct("pos", "sig", "n", "label")).alias("_m"))
    leaders = cut_lineage(first.select("s", "band", F.col("_m.sig").alias("leader"), F.col("_m.pos").alias("pos2"), F.col("_m.n").alias("n2"), F.col("_m.label").alias("label2")))
    both = leaders.unionByName(leaders.withColumn("band", F.col("band") + 1))
    met = banded.join(both, ["s", "band"]).filter("label <> label2")
    shared = met.groupBy("sig", "leader").agg(F.count("*").alias("n"), F.max("n").alias("n1"), F.max("n2").alias("n2"), F.max("pos").alias("p1"), F.max("pos2").alias("p2"))
    # where they follow other leaders they may share some more; what this leaves out the block pairs bring back
    hopeful = _reachable(F.col("n") * 1.25 + 4, F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2"), percent)
    most = shared.filter(hopeful).groupBy("sig").agg(F.max(F.struct("n", F.bitwise_not("leader").alias("leader"))).alias("m"))
    return most.select(F.col("sig").alias("a"), F.bitwise_not("m.leader").alias("b"))


def links(docs: DataFrame, entries: DataFrame, known: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Component labels of sets: node, label. ``known`` has key, n_shingles, sig and odd sketch of every document."""
    entries = cut_lineage(entries)
    wanted = entries.select("sig").distinct()
    per_set = known.filter("sig is not null").groupBy("sig").agg(F.min(key).alias("_k"), F.first("n_shingles").alias("n"), F.first("odd").alias("odd"))
    sketches = cut_lineage(per_set.join(wanted, "sig"))
    have: list[DataFrame] = []

    def compared(pairs: DataFrame) -> DataFrame:
        """Pairs a, b with linked and diff, a lower bound of it where that rules the link out."""
        possible = _possible(pairs, sketches, percent)
        left = possible.filter("open").select("a", "b")
        sigs = left.select(F.col("a").alias("sig")).union(left.select("b")).distinct()
        for h in have:
            sigs = sigs.join(h.select("sig"), "sig", "left_anti")
        have.append(_fetched(docs, cut_lineage(sketches.join(sigs, "sig").select("_k", F.col("sig").alias("_sig"))), key, text, size))
        exact = _overlap(left, reduce(DataFrame.unionByName, have), percent)
        return exact.unionByName(possible.filter("not open").select("a", "b", "diff", F.lit(False).alias("linked")))

    def labelled(edges: DataFrame) -> DataFrame:
        return components(edges) if not edges.isEmpty() else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))

    of, rest, edges, follows = None, entries.withColumn("label", F.col("sig")), None, None
    while True:
        tried = compared(_led(rest, percent))
        found = tried.filter("linked")
        edges = found.select("a", "b") if edges is None else cut_lineage(edges.unionByName(found.select("a", "b")))
        label = labelled(edges)
        # clusters: a leader and the sets linked to it that follow no one else
        fresh = found.select(F.col("a").alias("sig"), F.col("b").alias("cluster"), F.col("diff").alias("away"))
        fresh = fresh.join(fresh.select(F.col("sig").alias("_h")), F.col("cluster") == F.col("_h"), "left_anti")
        follows = cut_lineage(fresh if follows is None else follows.unionByName(fresh))
        of = entries.join(follows, "sig", "left").join(label, F.col("sig") == F.col("node"), "left")
        of = cut_lineage(of.select("s", "sig", "n", "pos", F.coalesce("cluster", "sig").alias("cluster"), F.coalesce("away", F.lit(0)).alias("away"), F.coalesce("label", "sig").alias("label")))
        mixed_lists = of.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("s")
        of = cut_lineage(of.join(mixed_lists, "s"))
        if found.count() <= WORTH_A_ROUND * tried.count():
            break
        taken = follows.select("sig").union(follows.select("cluster")).distinct()
        rest = of.join(taken, "sig", "left_anti")  # neither leader nor led

    pairs = _apart(_block_pairs(of, sketches, percent), label)
    second = compared(pairs)
    edges = cut_lineage(edges.unionByName(second.filter("linked").select("a", "b")))
    label = labelled(edges)

    # members whose answer the leaders leave open
    reach = of.groupBy("cluster").agg(F.max("away").alias("r"), F.max("n").alias("hi"))
    ends = lambda c: reach.select(F.col("cluster").alias(c), F.col("r").alias(f"r{c}"), F.col("hi").alias(f"hi{c}"))
    slack = (100 - percent) * (F.col("hia") + F.col("hib")) / (100 + percent)
    unsure = _apart(second.filter("not linked"), label).join(ends("a"), "a").join(ends("b"), "b")
    unsure = cut_lineage(unsure.filter((F.col("ra") + F.col("rb") > 0) & (F.col("diff") - F.col("ra") - F.col("rb") <= slack)).select("a", "b", "diff"))
    if not unsure.isEmpty():
        open_ones = _open_members(of, _meetings(of, unsure, percent), percent)
        third = compared(open_ones)
        edges = cut_lineage(edges.unionByName(third.filter("linked").select("a", "b")))
        label = labelled(edges)
    return label


def _meetings(of: DataFrame, unsure: DataFrame, percent: int) -> DataFrame:
    """Lists s in which clusters of the pairs a, b, diff meet with sizes, positions and distances that leave a link between
    members open. Clusters meet here by one row a list each, whatever their number of members."""

    def heads(c: str) -> DataFrame:
        mine = of.join(unsure.select(F.col(c).alias("cluster")).distinct(), "cluster", "left_semi")
        return mine.groupBy("s", F.col("cluster").alias(c)).agg(
            F.min("n").alias(f"lo_{c}"), F.max("n").alias(f"hi_{c}"), F.max(F.col("n") - F.col("pos")).alias(f"room_{c}"), F.max("away").alias(f"r_{c}"))

    def possible(x: str, y: str) -> Column:
        """With x as it is in the list and y as it is there, or as it is anywhere."""
        (lo1, hi1, room1, r1), (lo2, hi2, r2) = [F.col(f"{n}_{x}") for n in ("lo", "hi", "room", "r")], [F.col(f"{n}_{y}") for n in ("lo", "hi", "r")]
        sizes = (100 * hi1 >= percent * lo2) & (100 * hi2 >= percent * lo1) & ((100 + percent) * room1 >= percent * (lo1 + lo2))
        return sizes & ((100 + percent) * (F.col("diff") - r1 - r2) <= (100 - percent) * (hi1 + hi2))

    ends = of.groupBy(F.col("cluster").alias("b")).agg(F.min("n").alias("lo_any"), F.max("n").alias("hi_any"), F.max("away").alias("r_any"))
    some = heads("a").join(unsure.select("a", "b", "diff").join(ends, "b"), "a").filter(possible("a", "any"))
    met = some.drop("lo_any", "hi_any", "r_any").join(heads("b"), ["s", "b"]).filter(possible("a", "b") & possible("b", "a"))
    return cut_lineage(met)


def _open_members(of: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of members that share one of the lists in which their clusters meet and whose link is still open."""
    mine = of.select("s", *[F.col(c).alias(f"{c}_a") for c in ("sig", "n", "pos", "away")], F.col("cluster").alias("a"))
    yours = of.select("s", *[F.col(c).alias(f"{c}_b") for c in ("sig", "n", "pos", "away")], F.col("cluster").alias("b"))
    na, slack = F.col("n_a"), 100 - percent
    room = F.least(na - F.col("pos_a"), F.col("room_b"))
    some = mine.join(met, ["s", "a"]).filter(
        (100 * na >= percent * F.col("lo_b")) & (100 * F.col("hi_b") >= percent * na) & ((100 + percent) * room >= percent * (na + F.col("lo_b")))
        & ((100 + percent) * (F.col("diff") - F.col("away_a") - F.col("r_b")) <= slack * (na + F.col("hi_b"))))
    at_least = F.col("diff") - F.col("away_a") - F.col("away_b")
    return (
        some.select("s", "b", "sig_a", "n_a", "pos_a", "away_a", "diff").join(yours, ["s", "b"])
        .filter(_compatible(na, F.col("pos_a"), F.col("n_b"), F.col("pos_b"), percent))
        .filter((100 + percent) * at_least <= slack * (na + F.col("n_b")))
        .select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b")).distinct()
    )


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs that no component holds yet."""
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"_l{c}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.filter(F.coalesce("_la", "a") != F.coalesce("_lb", "b")).drop("_la", "_lb")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links).

    NULL, empty and blank texts have no shingles and stand alone, as do rows with a NULL key. Repeated rows give repeated
    results; equal texts are one set. Other columns are not read; an empty table gives an empty result.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        known = cut_lineage(sets(docs, key, text, size))
        total = known.agg(F.sum("n_shingles")).first()[0] or 0
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, total / BLOCK_SHINGLES * 4)))))
        often = frequent_shingles(docs, buckets, size, text)
        label = links(docs, lists(docs, often, buckets, size, percent, text), known, percent, key, text, size)
    full = known.join(label, F.col("sig") == F.col("node"), "left")
    group = F.when(F.col("sig").isNotNull() & F.col(key).isNotNull(), F.coalesce("label", "sig"))
    grouped = cut_lineage(full.select(key, "n_shingles", group.alias("_g")))
    smallest = cut_lineage(grouped.filter("_g is not null").groupBy("_g").agg(F.min(key).alias("_first")))
    return grouped.join(smallest, "_g", "left").select(key, "n_shingles", F.coalesce("_first", key).alias("component_id"))
