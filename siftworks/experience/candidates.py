"""Candidate specs of many datasets at once: propose, avoid, inject, constrain, deduplicate, cap."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import RuleSet

MEMORY_OFFSET = 1000
SMOTE_MIN = 6


def _derived(profiles: DataFrame, rules: RuleSet) -> DataFrame:
    for name, expr in rules.derived.items():
        profiles = profiles.withColumn(name, F.expr(expr))
    return profiles


def propose(profiles: DataFrame, rules: RuleSet, key: str = "dataset") -> DataFrame:
    """(key, idx, spec fields): idx 0 is the plain spec. One projection per profile row, no join."""
    cells = []
    for i, (cond, spec) in enumerate(rules.specs()):
        body = F.struct(F.lit(i).alias("idx"), *[F.expr(e).alias(f) for f, e in spec.items()])
        cells.append(F.when(F.expr(cond), body))
    return _derived(profiles, rules).select(key, F.inline(F.array_compact(F.array(*cells))))


def _of_cell(expr: str, fields: Sequence[str], cell: str) -> str:
    """An SQL expression over spec fields as one over the fields of ``cell``; quoted text stays."""
    return re.sub(r"'[^']*'|\b\w+\b", lambda m: f"{cell}.{m[0]}" if m[0] in fields else m[0], expr)


def within_rows(profiles: DataFrame, rules: RuleSet, keep: Sequence[str] = ("dataset",), constrained: bool = True) -> DataFrame:
    """(kept columns, spec fields, rank): proposed, constrained, once each and capped inside every profile row, so nothing is
    shuffled and a task holds the specs of one profile at a time. Profiles have one row per dataset."""
    fields = list(rules.fields)
    cells = [F.when(F.expr(cond), F.struct(*[F.expr(spec[f]).alias(f) for f in fields])) for cond, spec in rules.specs()]
    df = _derived(profiles, rules).withColumn("_specs", F.array_compact(F.array(*cells)))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema["_specs"].dataType.elementType.fields}
    for name, target, value in rules.constraints if constrained else ():
        changed = {f: f"k.{f}" for f in fields} | {target: f"CAST({_of_cell(value, fields, 'k')} AS {kinds[target]})"}
        struct = ", ".join(f"'{f}', {e}" for f, e in changed.items())
        df = df.withColumn("_specs", F.expr(f"CASE WHEN array_contains(constraints, '{name}') THEN transform(_specs, k -> named_struct({struct})) ELSE _specs END"))
    once = F.filter(F.array_distinct("_specs"), lambda _, i: i < F.col("_cap"))  # the earliest of equal ones stays
    ranked = F.transform(once, lambda s, i: F.struct(*[s[f].alias(f) for f in fields], (i + 1).alias("rank")))
    return df.withColumn("_cap", F.expr(rules.cap)).select(*keep, F.inline(ranked))


def avoid(candidates: DataFrame, bad: DataFrame, rules: RuleSet, key: str = "dataset") -> DataFrame:
    """Drops candidates that repeat the pattern of a poor past run; the plain spec always stays."""
    on = [key, *rules.pattern]
    patterns = bad.select(*on).distinct()
    kept = candidates.filter("idx > 0").join(patterns, on, "left_anti").select(candidates.columns)
    return candidates.filter("idx = 0").unionByName(kept)


def inject(candidates: DataFrame, good: DataFrame, rules: RuleSet, key: str = "dataset") -> DataFrame:
    """Adds the specs of good similar runs (key, rank, fields) behind the proposed ones."""
    extra = good.filter("rank <= 3").select(key, (F.lit(MEMORY_OFFSET) + F.col("rank")).cast("int").alias("idx"), *rules.fields)
    return candidates.unionByName(extra)


def adapt_injected(good: DataFrame, profiles: DataFrame, key: str = "dataset") -> DataFrame:
    """SMOTE from memory becomes oversampling when a class is too small, nothing when the profile does not ask for it."""
    need = profiles.select(key, "min_class_size", (
        F.col("is_highly_imbalanced") & (F.col("min_class_size") >= SMOTE_MIN) & (F.col("budget") != "minimal")).alias("_ok"))
    both = good.join(need, key)
    smote = F.col("imbalance") == "smote"
    fixed = F.when(smote & (F.col("min_class_size") < SMOTE_MIN), "oversample").when(smote & ~F.col("_ok"), "none").otherwise(F.col("imbalance"))
    return both.withColumn("imbalance", fixed).select(good.columns)


def constrain(candidates: DataFrame, profiles: DataFrame, rules: RuleSet, key: str = "dataset") -> DataFrame:
    out = candidates.join(profiles.select(key, "constraints"), key)
    for name, target, value in rules.constraints:
        out = out.withColumn(target, F.when(F.array_contains("constraints", name), F.expr(value)).otherwise(F.col(target)))
    return out.drop("constraints")


def finish(candidates: DataFrame, profiles: DataFrame, rules: RuleSet, key: str = "dataset") -> DataFrame:
    """Equal specs once (the earliest), numbered and cut to the cap of the dataset. A dataset has a handful of rows."""
    once = candidates.groupBy(key, *rules.fields).agg(F.min("idx").alias("idx"))
    w = Window.partitionBy(key).orderBy("idx")
    ranked = once.withColumn("rank", F.row_number().over(w))
    caps = profiles.select(key, F.expr(rules.cap).alias("_cap"))
    return ranked.join(caps, key).filter(F.col("rank") <= F.col("_cap")).drop("_cap", "idx")


def candidates(profiles: DataFrame, rules: RuleSet, bad: DataFrame | None = None, good: DataFrame | None = None, key: str = "dataset") -> DataFrame:
    """(key, rank, spec fields) for every profile row."""
    if bad is None and good is None:
        return within_rows(profiles, rules, [key])
    out = propose(profiles, rules, key)
    if bad is not None:
        out = avoid(out, bad, rules, key)
    if good is not None:
        out = inject(out, adapt_injected(good, profiles, key) if "num_imputer" in rules.plain else good, rules, key)
    return finish(constrain(out, profiles, rules, key), profiles, rules, key)
