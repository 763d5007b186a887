"""Exact linear-interpolation quantiles of many columns at once.

Up to ``in_memory_rows`` values the built-in ``percentile`` is exact and cheap. Beyond that its value map would
not fit one reducer, so the wanted order statistics are bracketed with quantile sketches and the bracket is
narrowed until few values are left; each pass is one aggregation with a constant-size buffer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 200
IN_MEMORY_ROWS = 2_000_000


def clean_number(c: Column | str) -> Column:
    """Numeric value as double, NaN read as NULL."""
    d = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(d), d)


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], in_memory_rows: int = IN_MEMORY_ROWS, counts: dict[str, int] | None = None
) -> dict[str, list[float | None]]:
    """Quantiles of each column; ``counts`` saves a pass when the number of values is known."""
    cols = list(cols)
    if not cols:
        return {}
    n = counts
    if n is None:
        row = df.agg(*[F.count(clean_number(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        n = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    small = [c for c in cols if n[c] <= in_memory_rows]
    out: dict[str, list[float | None]] = {}
    if small:
        p = F.array(*[F.lit(float(x)) for x in probs])
        row = df.agg(*[F.percentile(clean_number(c), p).alias(f"q{i}") for i, c in enumerate(small)]).first()
        for i, c in enumerate(small):
            out[c] = list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
    large = [c for c in cols if c not in out]
    if large:
        want = {(c, r) for c in large for p in probs for r in _ranks(p, n[c])}
        stat = _order_statistics(df, sorted(want), in_memory_rows)
        for c in large:
            out[c] = []
            for p in probs:
                lo, hi = _ranks(p, n[c])
                frac = p * (n[c] - 1) - lo
                out[c].append(stat[c, lo] + (stat[c, hi] - stat[c, lo]) * frac)
    return out


def _ranks(p: float, n: int) -> tuple[int, int]:
    pos = p * (n - 1)
    return math.floor(pos), math.ceil(pos)


def _order_statistics(df: DataFrame, want, limit: int) -> dict:
    """Value at each 0-based rank. ``a`` and ``b`` bound the open interval that holds the rank."""
    found: dict = {}
    state = {t: (-math.inf, math.inf) for t in want}
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    while state:
        todo = list(state)
        aggs = []
        for i, t in enumerate(todo):
            x, (a, b) = clean_number(t[0]), state[t]
            inside = F.when((x > F.lit(a)) & (x < F.lit(b)), x)
            aggs += [
                F.count(F.when(x < F.lit(a), x)).alias(f"lta{i}"),
                F.count(F.when(x <= F.lit(a), x)).alias(f"lea{i}"),
                F.count(F.when(x < F.lit(b), x)).alias(f"ltb{i}"),
                F.count(F.when(x <= F.lit(b), x)).alias(f"leb{i}"),
                F.percentile_approx(inside, grid, 10_000).alias(f"g{i}"),
            ]
        row = df.agg(*aggs).first()
        last = []
        for i, t in enumerate(todo):
            (a, b), r = state[t], t[1]
            lta, lea, ltb, leb, g = (row[f"{k}{i}"] for k in ("lta", "lea", "ltb", "leb", "g"))
            if r < lta:
                state[t] = (-math.inf, a)
            elif r >= leb:
                state[t] = (b, math.inf)
            elif r < lea or r >= ltb:
                found[t] = a if r < lea else b
                del state[t]
            elif ltb - lea <= limit:
                last.append((t, lea))
            else:
                at = (r - lea) / (ltb - lea) * GRID
                lo, hi = math.floor(at) - 1, math.ceil(at) + 1
                state[t] = (g[lo] if lo >= 0 else a, g[hi] if hi <= GRID else b)
                if state[t][0] == state[t][1]:
                    state[t] = (math.nextafter(state[t][0], -math.inf), state[t][1])
        if last:
            aggs = []
            for i, (t, lea) in enumerate(last):
                x, (a, b) = clean_number(t[0]), state[t]
                kept = F.collect_list(F.when((x > F.lit(a)) & (x < F.lit(b)), x))
                aggs.append(F.element_at(F.array_sort(kept), t[1] - lea + 1).alias(f"v{i}"))
            row = df.agg(*aggs).first()
            for i, (t, _) in enumerate(last):
                found[t] = row[f"v{i}"]
                del state[t]
    return found
