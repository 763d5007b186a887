"""Exact Euclidean neighbours by pivots and rings.

Some rows serve as pivots; every row belongs to the cell of its nearest pivot and is ordered there by its distance to it.
Consecutive rows of a cell are a block: a ring around the pivot. By the triangle inequality a row at distance d from a pivot
is at least d - hi or lo - d away from all rows of a ring from lo to hi, so most pairs of blocks are never compared. Equal
vectors are one entry, which keeps copies from being compared with each other.

Pairs of blocks meet in joins, and what a pair yields is small: the k best of each row, a count, a spanning set of edges.
Vectors may stand in groups (``group``), which have their own pivots and never meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .ordering import with_position

BLOCK_ROWS = 1024
#: Blocks and pivots of all groups, which every task knows.
MAX_BLOCKS = 100_000
MAX_PIVOTS = 2_000
#: Parts of the blocks at least, and the bytes of vectors in one.
PARTS = 8
PART_BYTES = 64 << 20
#: Entries of the shelf whose distances a task holds at a time.
STRIP_ROWS = 4096


def rounding(*sides: np.ndarray) -> float:
    """How far a distance by ``distances`` may be off: the root of what squares of this size lose."""
    return 1e-7 * (1e-3 + sum(float(np.sqrt((x * x).sum(1)).max(initial=0.0)) for x in sides))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


@dataclass
class Rings:
    """Blocks of entries. ``packed`` has a row per block: block, group, ids, keys, x (flat) and what else was given; the
    rest describes pivots and blocks on the driver."""

    packed: DataFrame
    pivots: dict
    blocks: pd.DataFrame
    kind: str
    d: int

    def parts(self) -> int:
        """Parts that the blocks are dealt into: enough tasks, and none too large for a task."""
        entries = int(self.blocks["n"].sum())
        return max(1, min(len(self.blocks), max(PARTS, -(-entries * self.d * 8 // PART_BYTES))))

    def bounds(self, group, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks of a group, their sizes, and a lower bound of the distance of each row of x to each block."""
        own = self.blocks[self.blocks["group"] == group]
        if group not in self.pivots or not len(own):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((len(x), 0))
        to = distances(x, self.pivots[group])[:, own["cell"].to_numpy()]
        low = np.maximum(to - own["hi"].to_numpy(), own["lo"].to_numpy() - to) - 2 * rounding(x, self.pivots[group])
        low = np.maximum(low, 0.0)
        return own["block"].to_numpy(), own["n"].to_numpy(), low


def entries(df: DataFrame, key: str, vec: str, keep: int, group: str | None = None) -> DataFrame:
    """Different vectors: group, x, id (the smallest key) and the ``keep`` smallest keys."""
    rows = df.select((F.col(group) if group else F.lit(0)).alias("group"), F.transform(F.col(vec), lambda v: v.cast("double") + 0.0).alias("x"), F.col(key).alias("k"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("group", "x").orderBy("k"))).filter(F.col("_r") <= keep)
    return first.groupBy("group", "x").agg(F.sort_array(F.collect_list("k")).alias("keys")).withColumn("id", F.col("keys")[0])


def rings(shelf: DataFrame, block_rows: int = BLOCK_ROWS, pivots: dict | None = None, more: tuple[str, ...] = ()) -> Rings:
    """Blocks of the entries group, id, x, keys. With ``pivots`` of other rings the entries go to those."""
    shelf = cut_lineage(shelf)
    sizes = {r["group"]: r["n"] for r in shelf.groupBy("group").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    block_rows = max(block_rows, n // MAX_BLOCKS)
    d = (shelf.agg(F.max(F.size("x"))).first()[0]) or 0
    if pivots is None:
        share = {g: max(1, min(-(-2 * m // block_rows), MAX_PIVOTS * m // max(n, 1))) for g, m in sizes.items()}
        want = F.coalesce(*[F.when(F.col("group") == F.lit(g), F.lit(m)) for g, m in share.items()], F.lit(0)) if sizes else F.lit(0)
        order = Window.partitionBy("group").orderBy(F.xxhash64("id", F.lit(7)), "id")
        picked = shelf.select("group", "id", "x").withColumn("_r", F.row_number().over(order)).filter((F.col("_r") <= MAX_PIVOTS) & (F.col("_r") <= want)).collect()
        pivots = {}
        for r in picked:
            pivots.setdefault(r["group"], []).append(r["x"])
        pivots = {g: np.array(v, float) for g, v in pivots.items()}
    known = pivots

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            cell, r = np.zeros(len(part), np.int32), np.zeros(len(part))
            x = np.array(part["x"].tolist(), float).reshape(len(part), -1)
            for g in pd.unique(part["group"]):
                at = np.flatnonzero(part["group"].to_numpy() == g)
                if g in known:
                    to = distances(x[at], known[g])
                    cell[at] = to.argmin(1)
                    r[at] = to[np.arange(len(at)), cell[at]]
            yield part.assign(cell=cell, r=r)

    kinds = dict(shelf.dtypes)
    names = ["group", "id", "x", "keys", *more]
    placed = shelf.select(*names).mapInPandas(place, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", cell int, r double")
    ordered = with_position(placed, [F.col("r"), F.col("id")], ["group", "cell"], "_p")
    split = cut_lineage(ordered.withColumn("_b", F.floor((F.col("_p") - 1) / block_rows)))
    blocks = split.groupBy("group", "cell", "_b").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).orderBy("group", "cell", "_b").toPandas()
    blocks["block"] = np.arange(len(blocks), dtype=np.int64)
    numbered = shelf.sparkSession.createDataFrame(blocks[["group", "cell", "_b", "block"]].to_records(index=False).tolist(), f"group {kinds['group']}, cell int, _b long, block long")
    packed = split.join(F.broadcast(numbered), ["group", "cell", "_b"]).groupBy("block", "group").agg(
        F.collect_list("id").alias("ids"), F.collect_list("keys").alias("keys"), F.flatten(F.collect_list("x")).alias("x"), *[F.collect_list(c).alias(c) for c in more])
    return Rings(cut_lineage(packed), pivots, blocks, kinds["id"], d)


def _block(row: dict, tag: str) -> dict:
    side = {c[2:]: v for c, v in row.items() if c.startswith(tag)}
    return {**side, "x": np.asarray(side["x"], float).reshape(len(side["ids"]), -1)}


def met(queries: Rings, shelf: Rings, pairs: DataFrame, kernel: Callable[[dict, list[dict]], pd.DataFrame], schema: str, more: DataFrame | None = None,
        once: bool = False, whole: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """What ``kernel`` makes of each query block and the blocks that it visits in one part of the shelf. ``more`` adds
    columns to the query blocks by qblock; with ``once`` a pair of blocks of the same rings is met from one side only;
    ``whole`` sums up what a task found.

    Query blocks are dealt into parts like the shelf, and a task takes one part of each, so a block is sent as often as the
    other side has parts, however many blocks it meets."""
    parts, ways = shelf.parts(), queries.parts()
    left = queries.packed.select(F.col("block").alias("qblock"), *[F.col(c).alias(f"q_{c}") for c in queries.packed.columns if c not in ("block", "group")])
    if more is not None:
        left = left.join(more, "qblock")
    way = F.pmod(F.floor(F.col("qblock") / parts), F.lit(ways)).cast("int").alias("way")
    asked = pairs.select("qblock", way, "part", "visited")
    left = left.join(asked, "qblock")
    right = shelf.packed.select("block", F.pmod("block", F.lit(parts)).cast("int").alias("to_part"), *[F.col(c).alias(f"s_{c}") for c in shelf.packed.columns if c not in ("block", "group")])
    right = right.join(F.broadcast(asked.select(F.col("way").alias("to_way"), F.col("part").alias("to_part")).distinct()), "to_part")

    def run(q_rows: pd.DataFrame, s_rows: pd.DataFrame) -> pd.DataFrame:
        held = {row["block"]: _block(row, "s_") for row in s_rows.to_dict("records")}
        out = []
        for row in q_rows.to_dict("records"):
            near = [held[b] for b in row["visited"] if not once or b >= row["qblock"]]
            if near:
                out.append(kernel(_block(row, "q_"), near))
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return whole(found) if whole else found

    # A count of its own keeps the parts, which are small but costly, in tasks of their own.
    tasks = 4 * parts * ways
    asking = left.repartition(tasks, "way", "part").groupBy("way", "part")
    return asking.cogroup(right.repartition(tasks, "to_way", "to_part").groupBy("to_way", "to_part")).applyInPandas(run, schema)


def visits(queries: Rings, shelf: Rings, wanted: Callable[[dict, np.ndarray, np.ndarray, np.ndarray], np.ndarray], more: DataFrame | None = None) -> DataFrame:
    """(qblock, part, visited, n): the blocks of each part of the shelf that ``wanted`` picks for a query block, and how
    many pairs of entries they hold with it."""
    left = queries.packed.select(F.col("block").alias("qblock"), "group", F.col("x").alias("q_x"), F.col("ids").alias("q_ids"))
    if more is not None:
        left = left.join(more, "qblock")
    known, parts = Rings(None, shelf.pivots, shelf.blocks, shelf.kind, shelf.d), shelf.parts()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x = np.asarray(row["q_x"], float).reshape(len(row["q_ids"]), -1)
                block, n, low = known.bounds(row["group"], x)
                at = np.flatnonzero(wanted(row, block, n, low)) if len(block) else np.empty(0, np.int64)
                of = block[at] % parts
                found = [(row["qblock"], p, block[at[of == p]].tolist(), n[at[of == p]].sum() * len(x)) for p in np.unique(of)]
                yield pd.DataFrame(found, columns=["qblock", "part", "visited", "n"])

    return cut_lineage(left.mapInPandas(run, "qblock long, part int, visited array<long>, n long"))


def _nearest_first(n: np.ndarray, low: np.ndarray, most: int) -> np.ndarray:
    """Per row the blocks of smallest bound that hold ``most`` entries together; all rows' blocks."""
    order = np.argsort(low, axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    first = np.zeros(low.shape[1], bool)
    first[np.unique(order[before < most])] = True
    return first


@dataclass
class Nearest:
    """(id, key, distance): the nearest keys of each query entry, and how many pairs of entries were compared."""

    rows: DataFrame
    compared: int


def nearest_entries(queries: Rings, shelf: Rings, most: int) -> Nearest:
    """The ``most`` nearest keys of every query entry by (distance, key). Two rounds: the closest blocks give each entry a
    distance that it need not exceed, the second visits the blocks that could still hold something nearer."""

    def best(q: dict, shelves: list[dict]) -> pd.DataFrame:
        x = np.concatenate([s["x"] for s in shelves])
        keys = [list(k) for s in shelves for k in s["keys"]]
        limit = np.asarray(q["tau"], float) if "tau" in q else np.full(len(q["x"]), np.inf)
        slack = 2 * rounding(q["x"], x)
        cut, row, at, near = limit + slack, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for first in range(0, len(x), STRIP_ROWS):
            d = distances(q["x"], x[first:first + STRIP_ROWS])
            if not first and d.shape[1] > most:
                cut = np.minimum(cut, np.partition(d, most - 1, axis=1)[:, most - 1] + slack)
            i, j = np.nonzero(d <= cut[:, None])
            row, at, near = np.concatenate([row, i]), np.concatenate([at, j + first]), np.concatenate([near, d[i, j]])
            order = np.lexsort((near, row))
            row, at, near = row[order], at[order], near[order]
            start = np.searchsorted(row, np.arange(len(cut)))
            last = start + most - 1
            full = np.flatnonzero(np.append(start[1:], len(row)) > last)
            cut[full] = np.minimum(cut[full], near[last[full]] + slack)
            kept = near <= cut[row]
            row, at, near = row[kept], at[kept], near[kept]
        exact = np.concatenate([np.empty(0), *[np.sqrt(((x[at[p:p + STRIP_ROWS]] - q["x"][row[p:p + STRIP_ROWS]]) ** 2).sum(1)) for p in range(0, len(at), STRIP_ROWS)]])
        inside = exact <= limit[row]
        pairs = [(i, e, k) for i, j, e in zip(row[inside].tolist(), at[inside].tolist(), exact[inside].tolist(), strict=True) for k in keys[j]]
        pairs.sort()
        out, seen, last_row = [], 0, -1
        for i, e, k in pairs:
            seen, last_row = (seen + 1, i) if i == last_row else (1, i)
            if seen <= most:
                out.append((q["ids"][i], k, e))
        return pd.DataFrame(out, columns=["id", "key", "distance"])

    schema = f"id {queries.kind}, key {shelf.kind}, distance double"
    first = visits(queries, shelf, lambda row, block, n, low: _nearest_first(n, low, most))
    found = cut_lineage(met(queries, shelf, first, best, schema))
    top = Window.partitionBy("id").orderBy("distance", "key")
    so_far = found.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= most)
    reach = so_far.groupBy("id").agg(F.when(F.count("*") >= most, F.max("distance")).otherwise(F.lit(float("inf"))).alias("tau"))
    one = queries.packed.select(F.col("block").alias("qblock"), F.posexplode("ids").alias("_p", "id")).join(reach, "id", "left")
    taus = cut_lineage(one.groupBy("qblock").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("tau", F.lit(float("inf"))).alias("t")))), lambda s: s["t"]).alias("q_tau")))

    def open_ones(row: dict, block: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
        return (low <= np.asarray(row["q_tau"], float)[:, None]).any(axis=0) & ~_nearest_first(n, low, most)

    second = visits(queries, shelf, open_ones, taus)
    more = met(queries, shelf, second, best, schema, taus)
    rows = found.unionByName(more).withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= most).drop("_r")
    return Nearest(cut_lineage(rows), first.unionByName(second).agg(F.sum("n")).first()[0] or 0)


def nearest(df: DataFrame, key: str, vec: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, neighbour, distance, rank) of the ``k`` nearest other rows, equal distances by key."""
    return nearest_counted(df, key, vec, k, block_rows)[0]


def nearest_counted(df: DataFrame, key: str, vec: str, k: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """nearest, and how many pairs of different vectors were compared."""
    shelf = cut_lineage(entries(df, key, vec, k + 1))
    own = rings(shelf, block_rows)
    found = nearest_entries(own, own, k + 1)
    vector = F.transform(F.col(vec), lambda v: v.cast("double") + 0.0)
    ids = df.select(F.col(key).alias("_me"), vector.alias("x")).join(shelf.select("x", "id"), "x").select("_me", "id")
    pairs = ids.join(found.rows, "id").filter("_me <> key").select(F.col("_me").alias(key), F.col("key").alias("neighbour"), "distance")
    w = Window.partitionBy(key).orderBy("distance", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), found.compared


def _close(q: dict, s: dict, radius: float) -> np.ndarray:
    """Which pairs are within the radius; those near it are decided by their differences."""
    near = distances(q["x"], s["x"])
    close = near <= radius
    for i, j in np.argwhere(np.abs(near - radius) <= rounding(q["x"], s["x"])):
        close[i, j] = np.sqrt(((q["x"][i] - s["x"][j]) ** 2).sum()) <= radius
    return close


def _spanning(links: pd.DataFrame) -> pd.DataFrame:
    """Links from every id to the smallest one that it reaches through the given links."""
    ids, at = np.unique(links[["a", "b"]].to_numpy(np.int64).ravel(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            far = np.flatnonzero(low != np.arange(len(ids)))
            return pd.DataFrame({"a": ids[far], "b": ids[low[far]]})
        low = new


def density_clusters(df: DataFrame, key: str, vec: str, radius: float, min_samples: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, cluster): core rows have ``min_samples`` rows within the radius, themselves included; core rows that reach each
    other share the smallest key among them as cluster; other rows join the smallest cluster within the radius, or are noise
    (-1). Block pairs are found once; a pair yields counts, then a spanning set of edges between core rows."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.transform(F.col(vec), lambda v: v.cast("double") + 0.0).alias("x"))
    shelf = cut_lineage(rows.groupBy("x").agg(F.min("k").alias("id"), F.count("*").alias("n")).select(F.lit(0).alias("group"), "id", "x", F.array("id").alias("keys"), "n"))
    own = rings(shelf, block_rows, more=("n",))
    pairs = visits(own, own, lambda row, block, n, low: (low <= radius).any(axis=0))

    def count(q: dict, shelves: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({"id": q["ids"], "n": sum(_close(q, s, radius) @ np.asarray(s["n"], np.int64) for s in shelves)})

    core = cut_lineage(met(own, own, pairs, count, "id long, n long").groupBy("id").agg((F.sum("n") >= min_samples).alias("core")))
    flags = own.packed.select(F.col("block"), F.posexplode("ids").alias("_p", "id")).join(core, "id")
    flags = cut_lineage(flags.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "core"))), lambda s: s["core"]).alias("core")))
    marked = Rings(cut_lineage(own.packed.join(flags, "block")), own.pivots, own.blocks, own.kind, own.d)

    def edges(q: dict, shelves: list[dict]) -> pd.DataFrame:
        found = [np.empty((0, 2), np.int64)]
        a = np.flatnonzero(np.asarray(q["core"], bool))
        left, top = np.asarray(q["ids"], np.int64)[a], np.iinfo(np.int64).max
        for s in shelves:
            b = np.flatnonzero(np.asarray(s["core"], bool))
            right = np.asarray(s["ids"], np.int64)[b]
            close = _close({"x": q["x"][a]}, {"x": s["x"][b]}, radius)
            low, high = left.copy(), right.copy()
            while len(a) and len(b):  # the smallest id that each reaches inside this pair of blocks
                new_high = np.minimum(high, np.where(close, low[:, None], top).min(0))
                new_low = np.minimum(low, np.where(close, new_high[None, :], top).min(1))
                if (new_low == low).all() and (new_high == high).all():
                    break
                low, high = new_low, new_high
            links = np.stack([np.concatenate([left, right]), np.concatenate([low, high])], 1)
            found.append(links[links[:, 0] != links[:, 1]])
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    linked = met(marked, marked, pairs, edges, "a long, b long", once=True, whole=_spanning).distinct()
    label = components(linked)

    inside = core.join(label, core["id"] == label["node"], "left").select("id", "core", F.when(F.col("core"), F.coalesce("label", "id")).alias("label"))
    labelled = own.packed.select("block", F.posexplode("ids").alias("_p", "id")).join(inside, "id")
    labelled = cut_lineage(labelled.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "label"))), lambda s: s["label"]).alias("label")))
    named = Rings(cut_lineage(own.packed.join(labelled, "block")), own.pivots, own.blocks, own.kind, own.d)

    def smallest(q: dict, shelves: list[dict]) -> pd.DataFrame:
        alone = [i for i, v in enumerate(q["label"]) if v is None or v != v]
        low = np.full(len(alone), np.iinfo(np.int64).max)
        for s in shelves if alone else []:
            known = [j for j, v in enumerate(s["label"]) if not (v is None or v != v)]
            if known:
                close = _close({"x": q["x"][alone]}, {"x": s["x"][known]}, radius)
                low = np.minimum(low, np.where(close, np.array([int(s["label"][j]) for j in known], np.int64)[None, :], np.iinfo(np.int64).max).min(1))
        hit = low < np.iinfo(np.int64).max
        return pd.DataFrame({"id": np.asarray([q["ids"][i] for i in alone], np.int64)[hit], "label": low[hit]})

    border = met(named, named, pairs, smallest, "id long, label long").groupBy("id").agg(F.min("label").alias("near"))
    cluster = inside.join(border, "id", "left").select("id", F.coalesce("label", "near", F.lit(-1)).cast("long").alias("cluster"))
    ids = shelf.select("x", "id").join(cluster, "id").select("x", "cluster")
    return df.select(F.col(key).alias("_me"), F.transform(F.col(vec), lambda v: v.cast("double") + 0.0).alias("x")).join(ids, "x").select(F.col("_me").alias(key), "cluster")
