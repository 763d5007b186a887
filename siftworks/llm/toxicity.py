"""Toxicity by a learned lexicon, matched with spelling errors and weighed by context.

Training (on at most ``max_rows`` labelled rows, picked by a hash of their id):

1. The lexicon holds word stems far more frequent in toxic rows than in clean ones. Of stems that extend each other only
   the longest one with nearly the full support stays. A stem that mostly stands as a whole word is a whole-word term.
2. Words near a whole-word term that clean rows contain more often than toxic rows are ordinary words, not misspellings.
3. A ridge logistic regression weighs exact hits, near hits, quoted hits and hit density.

Matching walks a word through the lexicon trie and the Levenshtein automata of all terms at once: a state is the set of
(trie node, edits) pairs that can still lead to a term, and the transitions found are kept. Most words die after two or
three characters. Stems may be misspelt as whole words may, in words of five letters or more. Window of a hit: the words
around it. A hit inside quotation marks or beside a verb of reporting counts as quotation, all others as use. Opening marks
stand before a word, closing ones behind it, so apostrophes within words are none; marks pair up in a sentence or window.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 12_000
MIN_SUPPORT = 5
MIN_STEM, MAX_STEM = 4, 12
WINDOW = 6
THRESHOLD = 0.3
#: Words without a hit that a worker remembers.
CLEAN_WORDS = 200_000
QUOTES = "\"'“”„«»‘’"
KINDS = {**dict.fromkeys("\"“”„", "double"), **dict.fromkeys("'‘’", "single"), **dict.fromkeys("«»", "angle")}
EDGE = QUOTES + ".,;:!?()[]{}*#$%&|<>-_…¿¡"
REPORTING = frozenset("said says say wrote writes quoted quote quotes called reported word term dit écrit sagte schrieb dijo escribió".split())


class LexiconAutomaton:
    """Trie of terms times Levenshtein automata, made deterministic state by state as words ask for it."""

    MAX_STATES = 50_000

    def __init__(self, whole: Iterable[str], stems: Iterable[str], edits_from: tuple[int, ...] = (5, 10)):
        self.children: list[dict[str, int]] = [{}]
        self.whole: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        self.allowed = [0]
        self.edits_from = edits_from
        for terms, ends in ((whole, self.whole), (stems, self.stem)):
            for term in sorted(terms):
                node, edits = 0, self._edits(term)
                self.allowed[0] = max(self.allowed[0], edits)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.allowed.append(0)
                    node = self.children[node][c]
                    self.allowed[node] = max(self.allowed[node], edits)
                ends[node] = term
        self._forget()

    def _edits(self, term: str) -> int:
        return sum(len(term) >= n for n in self.edits_from)

    def _forget(self) -> None:
        start = self._closed({(0, 0)})
        self.ids = {start: 0}
        self.sets = [start]
        self.moves: list[dict[str, int]] = [{}]
        self.found = [self._finds(start)]

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With every pair also those reached by leaving out letters of a term."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, edits = todo.pop()
            if edits > self.allowed[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _finds(self, state: frozenset) -> tuple[tuple[str, int] | None, str | None, tuple[int, str] | None]:
        """The whole-word term (with its edits), the stem and the misspelt stem (with its edits) that end in this state."""
        whole = min(((e, self.whole[n]) for n, e in state if n in self.whole and e <= self._edits(self.whole[n])), default=None)
        stem = max((self.stem[n] for n, e in state if n in self.stem and e == 0), key=len, default=None)
        near = min(((e, self.stem[n]) for n, e in state if n in self.stem and 0 < e <= self._edits(self.stem[n])), default=None)
        return (whole[1], whole[0]) if whole else None, stem, near

    def _move(self, at: int, c: str) -> int:
        pairs: set[tuple[int, int]] = set()
        for node, edits in self.sets[at]:
            pairs.add((node, edits + 1))  # a letter too many
            for letter, child in self.children[node].items():
                pairs.add((child, edits + (letter != c)))
        state = self._closed(pairs)
        if state not in self.ids:
            self.ids[state] = len(self.sets)
            self.sets.append(state)
            self.moves.append({})
            self.found.append(self._finds(state))
        self.moves[at][c] = self.ids[state]
        return self.ids[state]

    def match(self, word: str) -> tuple[str, int] | None:
        """The term a word stands for and how many edits away it is."""
        if len(self.sets) > self.MAX_STATES:
            self._forget()
        at, stem, near = 0, None, None
        for c in word:
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            _, exact, misspelt = self.found[at]
            stem = exact or stem
            if misspelt and (near is None or misspelt < near):
                near = misspelt
            if not self.sets[at]:
                break
        whole = self.found[at][0]
        if stem and not (whole and whole[1] == 0):
            return stem, 0
        if near and len(word) >= self.edits_from[0] and (whole is None or near[0] < whole[1]):
            return near[1], near[0]
        return whole


def lower_words(text: str) -> list[str]:
    return text.lower().split()


def bare(word: str) -> str:
    return word.strip(EDGE)


def quoted_words(words: list[str]) -> set[int]:
    """Places of the words between an opening quotation mark and the next closing one of its kind, when both stand in one
    sentence or in the window around a word."""
    out: set[int] = set()
    opened: dict[str, tuple[int, int]] = {}
    sentence = 0
    for i, w in enumerate(words):
        core = w.strip(EDGE)
        cut = w.index(core) if core else 0
        lead, trail = w[:cut], w[cut + len(core) :]
        for c in lead:
            if c in KINDS:
                opened[KINDS[c]] = (i, sentence)
        for c in trail:
            kind = KINDS.get(c)
            if kind is None:
                continue
            if kind in opened:
                start, of = opened.pop(kind)
                if of == sentence or i - start <= 2 * WINDOW:
                    out.update(range(start, i + 1))
            elif not core:  # a mark by itself
                opened[kind] = (i, sentence)
        sentence += any(c in ".!?…" for c in trail)
    return out


@dataclass
class ToxicityModel:
    whole: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    ordinary: frozenset = frozenset()
    weights: list[float] = field(default_factory=lambda: [0.0] * 5)

    def __post_init__(self):
        self.automaton = LexiconAutomaton(self.whole, self.stems)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "clean", "hits")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def found(self, words: list[str]) -> set[str]:
        """Words of a text that hit the lexicon; words are looked up once per worker."""
        seen = set(words)
        for w in seen - self.clean:
            if w in self.hits:
                continue
            core = bare(w)
            hit = self.automaton.match(core) if len(core) >= MIN_STEM - 1 else None
            if hit and (hit[1] == 0 or core not in self.ordinary):
                self.hits[w] = hit
            else:
                self.clean.add(w)
        if len(self.clean) > CLEAN_WORDS:
            self.clean.clear()
        return seen & self.hits.keys()

    def features(self, text: str | None) -> tuple[float, ...]:
        """Logarithms of exact, near and quoted hits and of hits per 100 words."""
        words = lower_words(text or "")
        found = self.found(words)
        if not found:
            return (0.0, 0.0, 0.0, 0.0)
        exact = near = quoted = 0
        in_quotes = quoted_words(words) if any(q in (text or "") for q in QUOTES) else set()
        for i, w in enumerate(words):
            if w not in found:
                continue
            window = words[max(0, i - WINDOW) : i + WINDOW + 1]
            if i in in_quotes or any(bare(x) in REPORTING for x in window):
                quoted += 1
            elif self.hits[w][1]:
                near += 1
            else:
                exact += 1
        total = exact + near + quoted
        return tuple(float(np.log1p(x)) for x in (exact, near, quoted, 100.0 * total / len(words)))

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], self.features(text), strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _stem_counts(rows: DataFrame) -> DataFrame:
    """Rows that hold a stem, and rows that hold it as a whole word, by stem."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, alone = Counter(), Counter()
        for batch in batches:
            for t in batch["text"]:
                words = {bare(w) for w in lower_words(t or "")}
                rows.update({w[:n] for w in words for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1)})
                alone.update(w for w in words if MIN_STEM <= len(w) <= MAX_STEM)
        yield pd.DataFrame({"stem": list(rows), "n": list(rows.values()), "alone": [alone.get(s, 0) for s in rows]}).astype({"stem": object, "n": "int64", "alone": "int64"})

    return rows.select("text").mapInPandas(count, "stem string, n long, alone long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone"))


def _lexicon(toxic: dict[str, tuple[int, int]], clean: dict[str, int], n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    def odds(s: str) -> float:
        a, b = (toxic[s][0] + 0.1) / (n_toxic + 0.2), (clean.get(s, 0) + 0.1) / (n_clean + 0.2)
        return float(np.log(a / b))

    strong = {s for s in toxic if odds(s) >= 3.5}
    children: dict[str, int] = defaultdict(int)
    for s in strong:
        if s[:-1] in strong:
            children[s[:-1]] = max(children[s[:-1]], toxic[s][0])
    closed = [s for s in strong if children[s] < 0.9 * toxic[s][0]]
    chosen: set[str] = set()
    for s in sorted(closed, key=len):
        if not any(s[:n] in chosen for n in range(MIN_STEM, len(s))):
            chosen.add(s)
    whole = sorted(s for s in chosen if toxic[s][1] >= 0.8 * toxic[s][0])
    return whole, sorted(chosen - set(whole))


def _ridge_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> list[float]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        p_w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * p_w[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, min_support: int = MIN_SUPPORT) -> ToxicityModel:
    """Learns from labelled rows whose crc32(doc_id as text) mod 4 is not 2, at most ``max_rows`` of them.

    Rows without a label or text, and ids that both classes claim, teach nothing. Without toxic rows every score is that
    of an empty lexicon.
    """
    kept = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    asked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & kept)
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_high"))
        .filter("toxic = _high").select("doc_id", "toxic")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(asked), "doc_id").select("toxic", "text").persist()  # broadcast: max_rows ids
    try:
        n = {int(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
        n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
        if not n_toxic or not n_clean:
            return ToxicityModel(weights=[-3.0 if n_clean or not n_toxic else 3.0, 0.0, 0.0, 0.0, 0.0])
        support = max(min_support, n_toxic // 200)
        in_toxic = _stem_counts(rows.filter("toxic = 1")).filter(F.col("n") >= support)
        toxic = {r["stem"]: (r["n"], r["alone"]) for r in in_toxic.collect()}
        wanted = frozenset(toxic)

        def in_clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts: Counter = Counter()
            for batch in batches:
                for t in batch["text"]:
                    counts.update({w[:n] for w in {bare(w) for w in lower_words(t)} for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1)} & wanted)
            yield pd.DataFrame({"stem": list(counts), "n": list(counts.values())}).astype({"stem": object, "n": "int64"})

        clean_rows = rows.filter("toxic = 0").select("text").mapInPandas(in_clean, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
        clean = {r["stem"]: r["n"] for r in clean_rows.collect()}
        whole, stems = _lexicon(toxic, clean, n_toxic, n_clean)
        draft = ToxicityModel(whole, stems)

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts: Counter = Counter()
            for batch in batches:
                for label, t in zip(batch["toxic"], batch["text"], strict=True):
                    counts.update((bare(w), int(label)) for w in draft.found(lower_words(t)) if draft.hits[w][1])
            yield pd.DataFrame([(w, y, n) for (w, y), n in counts.items()], columns=["word", "toxic", "n"]).astype({"word": "object", "toxic": "int32", "n": "int64"})

        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for r in rows.mapInPandas(near, "word string, toxic int, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n")).collect():
            seen[r["word"]][r["toxic"]] += r["n"]
        ordinary = frozenset(w for w, (b, a) in seen.items() if b / n_clean >= 0.2 * a / n_toxic)
        model = ToxicityModel(whole, stems, ordinary)

        def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = [model.features(t) for t in batch["text"]]
                yield pd.DataFrame(x, columns=list("abcd")).assign(y=batch["toxic"].astype("float64").array)

        table = rows.mapInPandas(featured, "a double, b double, c double, d double, y double").toPandas()  # max_rows rows
        x, y = table[list("abcd")].to_numpy(), table["y"].to_numpy()
        model.weights = _ridge_logistic(x, y)
        model.weights[1:] = [max(w, 0.0) for w in model.weights[1:]]  # hits of no kind speak against toxicity
        if not x[:, 1].any():  # misspellings not seen in training count half an exact hit
            model.weights[2] = 0.5 * model.weights[1]
        if not x[:, 2].any():  # nor quotations: a tenth
            model.weights[3] = 0.1 * model.weights[1]
        return model
    finally:
        rows.unpersist()


def scores(model: ToxicityModel, spark: SparkSession, text: Column) -> Column:
    """The score of every text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)  # a lexicon learned from a bounded sample

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return scored(text)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to every row; columns of those names are replaced. NULL and empty texts have no hits and get
    the score of that; repeated rows get equal scores. Texts of any length are read whole. An empty table gives an empty
    result."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.select(*kept).withColumn("score", scores(model, docs.sparkSession, F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
