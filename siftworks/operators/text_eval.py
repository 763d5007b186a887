"""Text task scores without a learned model: overlap metrics, sentence QA, lexicon entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.binding import let
from .metrics import ratio

EPS = 1e-12


def ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens

    def runs(tok):
        size = F.size(tok)
        starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tok, i, n), " "))

    return let(tokens, runs)


def numbered(items: Column) -> Column:
    """Each text of an array marked with how many equal ones it completes, so that a multiset becomes a set. Equal texts
    lie together after sorting; a run's start gives the count, so the work is one sort and one pass."""

    def marks(run):
        last = F.size(run) - 1
        return let(F.filter(F.transform(run, lambda g, i: F.when((i == 0) | (g != F.get(run, i - 1)), i)), lambda i: i.isNotNull()), lambda starts: F.flatten(F.transform(
            starts, lambda at, j: F.transform(F.sequence(at, F.coalesce(F.get(starts, j + 1) - 1, last)), lambda i: F.concat(F.get(run, at), F.lit("\x01"), (i - at).cast("string"))))))

    return let(F.array_sort(items), marks)


def multiset_f1(pred: Column, ref: Column) -> Column:
    """F1 of the overlap of two arrays of texts, repeats counted; 0 when one is empty. Stays inside the row."""

    def f1(sides):
        shared = F.size(F.array_intersect(numbered(sides["p"]), numbered(sides["r"])))
        prec, rec = shared / F.greatest(F.size(sides["p"]), F.lit(1)), shared / F.greatest(F.size(sides["r"]), F.lit(1))
        return 2 * prec * rec / F.greatest(prec + rec, F.lit(EPS))

    return let(F.struct(pred.alias("p"), ref.alias("r")), f1)


def lower_words(text: Column) -> Column:
    """Lower-cased words; a missing text has none."""
    return tx.words(F.lower(F.coalesce(text, F.lit(""))))


def overlap_f1(pred: str, ref: str, n: int) -> Column:
    """F1 of the n-grams two text columns share."""
    return multiset_f1(*[ngrams(lower_words(F.col(c)), n) for c in (pred, ref)])


@F.pandas_udf(T.IntegerType())
def longest_common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest run of consecutive tokens both texts share; one numpy row per token of the shorter text."""
    import numpy as np

    def one(x, y):
        x, y = (x or "").lower().split(), (y or "").lower().split()
        if len(x) > len(y):
            x, y = y, x
        codes: dict[str, int] = {}
        yy = np.array([codes.setdefault(t, len(codes)) for t in y], dtype=np.int64)
        run = np.zeros(len(y) + 1, dtype=np.int64)
        best = 0
        for t in x:
            c = codes.get(t)
            nxt = np.zeros_like(run)
            if c is not None:
                nxt[1:] = np.where(yy == c, run[:-1] + 1, 0)
                best = max(best, int(nxt.max()))
            run = nxt
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def run_f1(pred: Column, ref: Column) -> Column:
    run = longest_common_run(pred, ref)
    p = run / F.greatest(F.size(tx.words(pred)), F.lit(1))
    r = run / F.greatest(F.size(tx.words(ref)), F.lit(1))
    return 2 * p * r / F.greatest(p + r, F.lit(EPS))


def rouge(df: DataFrame, key: str, pred: str, ref: str) -> DataFrame:
    """rouge1, rouge2 and rouge_l (contiguous run) per row."""
    words = df.select(key, lower_words(F.col(pred)).alias("_pw"), lower_words(F.col(ref)).alias("_rw"), run_f1(F.col(pred), F.col(ref)).alias("rouge_l"))
    return words.select(key, *[multiset_f1(ngrams(F.col("_pw"), n), ngrams(F.col("_rw"), n)).alias(f"rouge{n}") for n in (1, 2)], "rouge_l")


def summarization_scores(df: DataFrame, key: str, source: str, summary: str) -> DataFrame:
    """Lead-N baseline scored against the reference summaries."""
    leads = df.select(key, F.coalesce(F.col(summary), F.lit("")).alias("_ref"),
                      tx.lead_summary(tx.clean_text(F.col(source), keep_alignment=True)).alias("_pred"))
    return rouge(leads, key, "_pred", "_ref").agg(*[F.avg(m).alias(m) for m in ("rouge1", "rouge2", "rouge_l")])


def qa_scores(df: DataFrame, key: str, context: str, question: str, answer: str) -> DataFrame:
    """Best-sentence baseline: exact match and token F1."""
    pred = tx.best_sentence(F.coalesce(F.col(context), F.lit("")), F.coalesce(F.col(question), F.lit("")))
    picked = df.select(key, pred.alias("_pred"), F.coalesce(F.col(answer), F.lit("")).alias("_ref"))
    em = (F.lower(F.trim("_pred")) == F.lower(F.trim("_ref"))).cast("double")
    return picked.select(em.alias("exact_match"), overlap_f1("_pred", "_ref", 1).alias("token_f1")).agg(
        F.avg("exact_match").alias("exact_match"), F.avg("token_f1").alias("token_f1"))


def bio_entities(tokens: Column, tags: Column) -> Column:
    """Surfaces and labels of B-/I- runs: array of (surface, label), lower-cased."""
    empty = F.array().cast("array<struct<surface:string,label:string>>")
    both = F.arrays_zip(tokens.alias("w"), tags.alias("t"))
    pairs = F.transform(F.filter(both, lambda p: p["w"].isNotNull() & p["t"].isNotNull()), lambda p: F.struct(F.lower(p["w"]).alias("w"), p["t"].alias("t")))
    start = F.struct(empty.alias("done"), F.lit("").alias("s"), F.lit("").alias("l"))

    def flush(acc):
        return F.when(acc["l"] != "", F.concat(acc["done"], F.array(F.struct(acc["s"].alias("surface"), acc["l"].alias("label"))))).otherwise(acc["done"])

    def step(acc, x):
        label = F.substr(x["t"], F.lit(3))
        inside = x["t"].startswith("I-") & (acc["l"] != "") & (label == acc["l"])
        return (
            F.when(x["t"].startswith("B-"), F.struct(flush(acc).alias("done"), x["w"].alias("s"), label.alias("l")))
            .when(inside, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["s"], x["w"]).alias("s"), acc["l"].alias("l")))
            .otherwise(F.struct(flush(acc).alias("done"), F.lit("").alias("s"), F.lit("").alias("l")))
        )

    return F.aggregate(pairs, start, step, flush)


def span_entities(text: Column, cell: Column) -> Column:
    """Surfaces and labels of character spans given as JSON objects or triples."""
    objects = F.from_json(cell, "array<struct<start:int,end:int,label:string>>")
    triples = F.transform(F.from_json(cell, "array<array<string>>"), lambda t: F.struct(
        t[0].cast("int").alias("start"), t[1].cast("int").alias("end"), t[2].alias("label")))
    spans = F.when(F.rlike(cell, F.lit(r"^\s*\[\s*\{")), objects).otherwise(triples)
    whole = F.filter(spans, lambda e: e["start"].isNotNull() & e["end"].isNotNull() & e["label"].isNotNull())
    return F.transform(whole, lambda e: F.struct(
        F.lower(F.substr(text, e["start"] + 1, e["end"] - e["start"])).alias("surface"), e["label"].alias("label")))


def parse_entities(text: Column, cell: Column) -> Column:
    """Entity cell as (surface, label) pairs: spans when it is a list, else BIO tags over the words."""
    return F.when(F.rlike(cell, F.lit(r"^\s*\[")), span_entities(text, cell)).otherwise(bio_entities(tx.words(text), tx.words(cell)))


LEXICON_CHUNK = 200_000


def lexicon_matches(docs: DataFrame, key: str, text: str, lexicon: DataFrame, chunk_rows: int = LEXICON_CHUNK) -> DataFrame:
    """(key, surface, label) for every lexicon surface that occurs in the text.

    The lexicon is cut into chunks of bounded size by surface hash; each chunk becomes one automaton that scans
    every text once, so there is no document x surface product and no unbounded broadcast."""
    sized = lexicon.select("surface", "label").filter("surface <> ''").distinct().persist()
    chunks = max(1, -(-sized.count() // chunk_rows) * (2 if sized.count() > chunk_rows else 1))
    parts = []
    for i in range(chunks):
        rows = sized.filter(F.pmod(F.xxhash64("surface"), F.lit(chunks)) == i).collect()
        if rows:
            parts.append(_scan(docs.select(key, F.lower(F.col(text)).alias("_t")), key, [(r[0], r[1]) for r in rows]))
    sized.unpersist()
    if not parts:
        return docs.select(key, F.lit("").alias("surface"), F.lit("").alias("label")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scan(docs: DataFrame, key: str, entries) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches):
        import ahocorasick

        labels: dict[str, list[str]] = {}
        for surface, label in entries:
            labels.setdefault(surface, []).append(label)
        auto = ahocorasick.Automaton()
        for surface in labels:
            auto.add_word(surface, surface)
        auto.make_automaton()
        for pdf in batches:
            out = [
                (k, s, lab)
                for k, t in zip(pdf[key], pdf["_t"])
                for s in {hit for _, hit in auto.iter(t or "")}
                for lab in labels[s]
            ]
            yield pd.DataFrame(out, columns=[key, "surface", "label"])

    return docs.mapInPandas(scan, f"`{key}` {kind}, surface string, label string")


def set_scores(pred: DataFrame, truth: DataFrame, cols: list[str]) -> DataFrame:
    """Precision, recall and F1 of two sets of rows: one grouping of both, no join."""
    both = pred.select(*cols, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        truth.select(*cols, F.lit(0).alias("p"), F.lit(1).alias("t")))
    cells = both.groupBy(*cols).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    agg = cells.agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum("p").alias("np"), F.sum("t").alias("nt"))
    agg = agg.withColumn("entity_precision", F.col("tp") / F.greatest("np", F.lit(1))).withColumn(
        "entity_recall", F.col("tp") / F.greatest("nt", F.lit(1)))
    f1 = ratio(2 * F.col("entity_precision") * F.col("entity_recall"), F.col("entity_precision") + F.col("entity_recall"))
    return agg.withColumn("entity_f1", f1).select("tp", "entity_precision", "entity_recall", "entity_f1")


def ner_scores(train: DataFrame, test: DataFrame, key: str, text: str, entities: str) -> DataFrame:
    """Surfaces seen in training are looked up in the test texts."""
    lexicon = train.select(F.explode(entities).alias("e")).select("e.surface", "e.label")
    truth = test.select(key, F.explode(entities).alias("e")).select(key, "e.surface", "e.label")
    pred = lexicon_matches(test, key, text, lexicon)
    return set_scores(pred, truth, [key, "surface", "label"])
