"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

Classes are licence families and ``unknown``. The model is a softmax regression over word one- and two-grams, sparse
because only n-grams of the templates have weights; all other words count through one feature, their share. It learns
from variants of the templates (words left out, swapped or added) and from at most ``MAX_ROWS`` paragraphs of the corpus
as unknown. A temperature fitted on variants and paragraphs held out calibrates the probabilities, so ``unknown`` wins
where no family is likely enough. A prediction is confirmed when the paragraph holds enough of the word pairs of a
template of its family.

Paragraphs of a text are its lines, and lines that belong together: blank lines and bare comment marks separate blocks, and
in a block every shortest run of lines that holds enough of a template is a paragraph, its wrapped lines joined without
their comment marks. A block of several lines without any finding is judged as a whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Short notices of public licences (fixed values).
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "bsd": ("Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "proprietary": ("Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission"),
}
FAMILIES = (*TEMPLATES, "unknown")
MAX_ROWS = 4_000
MAX_CHARS = 1_000
CONFIRM = 0.6
EDGE = ".,;:!?()[]{}\"'<>"
#: Marks around the lines of a comment or quotation.
MARKS = re.compile(r"^\s*(?:(?:/\*+|\*+/|\*+|//+!?|#+|--+|;+|%+|>+|<!--+|\(\*|\{-|\"\"\"|'\'\'|(?:rem|dnl|c)(?=\s))\s*)*|\s*(?:\*+/|--+>|\*\)|-\}|\*+|#+|\"\"\"|'\'\')\s*$", re.I)
#: Word ids kept per worker.
MAX_WORDS = 200_000


def tokens(paragraph: str) -> list[str]:
    return [w for w in (x.strip(EDGE) for x in paragraph.lower().split()) if w]


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def joined(lines: list[list[str]]) -> list[tuple[str, int, int]]:
    """Words of wrapped lines with the lines they begin and end in; a hyphen at the end of a line goes on in the next."""
    out: list[tuple[str, int, int]] = []
    for i, words in enumerate(lines):
        for k, w in enumerate(words):
            if k == 0 and out and out[-1][0][-1] == "-" and out[-1][0] != "-":
                out[-1] = (out[-1][0] + w, out[-1][1], i)
            else:
                out.append((w, i, i))
    return out


def variants(words: list[str], filler: list[str], rng: np.random.Generator, n: int = 40) -> list[list[str]]:
    out = [words]
    for _ in range(n):
        w = [x for x in words if rng.random() > 0.08]
        for _ in range(int(rng.integers(0, 3))):
            w.insert(int(rng.integers(0, len(w) + 1)), filler[int(rng.integers(0, len(filler)))])
        out.append(w or words)
    return out


class LicenceModel:
    def __init__(self, corpus: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        own = {f: [tokens(t) for t in texts] for f, texts in TEMPLATES.items()}
        self.pairs = {f: [set(grams(w)[len(w) :]) for w in texts] for f, texts in own.items()}
        self.counts = [Counter(grams(w)[len(w) :]) for texts in own.values() for w in texts if len(w) > 1]
        names = sorted({g for texts in own.values() for w in texts for g in grams(w)})
        self.index = {g: i for i, g in enumerate(names)}
        paragraphs = [w for w in map(tokens, corpus) if w and not self._like_template(w)]
        filler = sorted({x for w in paragraphs for x in w}) or ["the"]
        rows = [(FAMILIES.index(f), v) for f, texts in own.items() for w in texts for v in variants(w, filler, rng)]
        rows += [(len(TEMPLATES), w) for w in paragraphs]
        template_words = sorted({x for texts in own.values() for w in texts for x in w})
        rows += [(len(TEMPLATES), [str(x) for x in rng.choice(template_words, int(rng.integers(1, 8)))]) for _ in range(400)]  # their words, no licence
        order = rng.permutation(len(rows))
        x = np.zeros((len(rows), len(names) + 2))
        y = np.array([rows[i][0] for i in order])
        for r, i in enumerate(order):
            for k, v in self._features(rows[i][1]).items():
                x[r, k] = v
        held = np.arange(len(rows)) % 5 == 0
        self.weights = self._fit(x[~held], y[~held])
        z = x[held] @ self.weights
        losses = {t: self._loss(z / t, y[held]) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
        self.weights = self.weights / min(losses, key=losses.get)
        self.scores: dict[frozenset, np.ndarray] = {}
        self.word = _Words(self.index)

    def _like_template(self, words: list[str]) -> bool:
        return any(self.similarity(words, f) >= CONFIRM for f in TEMPLATES)

    def _features(self, words: list[str]) -> dict[int, float]:
        known = {self.index[g]: 1.0 for g in grams(words) if g in self.index}
        inside = sum(w in self.index for w in words) / max(1, len(words))
        return known | {len(self.index): 1.0, len(self.index) + 1: 4.0 * (1 - inside)}

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def _loss(self, z: np.ndarray, y: np.ndarray) -> float:
        return float(-np.log(self._softmax(z)[np.arange(len(y)), y] + 1e-12).mean())

    def _fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 1.0, penalty: float = 1e-4) -> np.ndarray:
        w = np.zeros((x.shape[1], len(FAMILIES)))
        speed = np.full_like(w, 1e-8)
        target = np.eye(len(FAMILIES))[y]
        weight = (len(y) / (len(FAMILIES) * np.maximum(np.bincount(y, minlength=len(FAMILIES)), 1)))[y][:, None] ** 0.5
        for _ in range(rounds):
            g = x.T @ (weight * (self._softmax(x @ w) - target)) / len(y) + penalty * w
            speed += g * g
            w -= rate * g / np.sqrt(speed)
        return w

    def similarity(self, words: list[str], family: str) -> float:
        """Share of a template's word pairs that the paragraph holds, of the best template of the family."""
        own = set(grams(words)[len(words) :])
        return max((len(own & p) / len(p) for p in self.pairs[family] if p), default=0.0)

    def judge(self, paragraph: str) -> tuple[str, float, float] | None:
        """Family, probability and template similarity; None for unknown."""
        return self.judge_words(tokens(paragraph))

    def judge_words(self, words: list[str]) -> tuple[str, float, float] | None:
        known = [w for w in words if w in self.index]
        if not known:
            return None
        inside = 4.0 * (1 - len(known) / len(words))
        held = frozenset(self.index[g] for g in grams(words) if g in self.index)
        z = self.scores.get(held)
        if z is None:
            if len(self.scores) >= MAX_WORDS:
                self.scores.clear()
            z = self.scores[held] = self.weights[list(held)].sum(axis=0) + self.weights[-2]
        z = z + inside * self.weights[-1]
        best = int(z.argmax())
        if FAMILIES[best] == "unknown":
            return None
        return FAMILIES[best], float(self._softmax(z)[best]), self.similarity(words, FAMILIES[best])

    def runs(self, lines: list[list[str]]) -> list[tuple[int, int]]:
        """First and last line of every shortest run of lines that holds enough word pairs of a template, with the lines on
        either side into which its word pairs go on. Runs of one line are left out."""
        flat = joined(lines)
        met = [(f"{a} {b}", i, j) for (a, i, _), (b, _, j) in zip(flat, flat[1:], strict=False) if f"{a} {b}" in self.index]
        out = set()
        for counts in self.counts:
            pairs = counts.keys()
            own = [x for x in met if x[0] in pairs]
            if len({x[0] for x in own}) < CONFIRM * len(pairs):
                continue
            at = 0
            while at < len(own):
                held: set[str] = set()
                end = at
                while end < len(own) and len(held) < CONFIRM * len(pairs):
                    held.add(own[end][0])
                    end += 1
                if len(held) < CONFIRM * len(pairs):
                    break
                back, end = self._shortest(own, at, end, CONFIRM * len(pairs), counts.total())
                first, last = own[back][1], own[end - 1][2]
                have = Counter(x[0] for x in own[back:end])
                while back > at and have[own[back - 1][0]] < counts[own[back - 1][0]] and own[back - 1][2] >= first:
                    back -= 1
                    have[own[back][0]] += 1
                    first = min(first, own[back][1])
                while end < len(own) and have[own[end][0]] < counts[own[end][0]] and own[end][1] <= last:
                    have[own[end][0]] += 1
                    last = max(last, own[end][2])
                    end += 1
                run = own[back:end]
                while first < last:  # lines at either end that no word pair ties to the run, if it holds enough without them
                    if not any(x[1] == first < x[2] for x in run) and len({x[0] for x in run if x[1] > first}) >= CONFIRM * len(pairs):
                        run = [x for x in run if x[1] > first]
                    elif not any(x[1] < last == x[2] for x in run) and len({x[0] for x in run if x[2] < last}) >= CONFIRM * len(pairs):
                        run = [x for x in run if x[2] < last]
                    else:
                        break
                    first, last = min(x[1] for x in run), max(x[2] for x in run)
                if last > first:
                    out.add((first, last))
                at = end
        return sorted(out, key=lambda x: (x[1] - x[0], x))

    @staticmethod
    def _shortest(own: list[tuple[str, int, int]], at: int, end: int, least: float, more: int) -> tuple[int, int]:
        """Of the stretches with ``least`` different word pairs that end at ``end`` or up to ``more`` pairs later, the first one
        over the fewest lines."""
        best = None
        for stop in range(end, min(len(own), end + more) + 1):
            back, seen = stop, set()
            while len(seen) < least and back > at:
                back -= 1
                seen.add(own[back][0])
            span = own[stop - 1][2] - own[back][1]
            if len(seen) >= least and (best is None or span < best[0]):
                best = span, back, stop
        return best[1:]

    def paragraphs(self, text: str) -> Iterator[tuple[int, int, str, float, float]]:
        """First line, number of lines and judgement of every licence paragraph of a text."""
        lines = [(i, MARKS.sub("", x).lower().split()) for i, x in enumerate(text.split("\n"))]
        for filled, block in groupby(lines, key=lambda x: bool(x[1])):
            if not filled:
                continue
            block = list(block)
            at, raw = block[0][0], [w for _, w in block]
            if not any(self._known(x) for x in raw):
                continue
            words = [[w for w in (x.strip(EDGE) for x in line) if w] for line in raw]
            found = {(i, i): got for i, line in enumerate(words) if self._known(raw[i]) and (got := self.judge_words(line))}
            if len(words) > 1:
                for first, last in self.runs(words):
                    inner = [k for k in found if first <= k[0] and k[1] <= last]
                    got = self.judge_words([w for w, *_ in joined(words[first : last + 1])])
                    # a line or shorter run of another family that is confirmed by itself stands
                    if got and all(found[k][2] < CONFIRM or found[k][0] == got[0] for k in inner):
                        for k in inner:
                            del found[k]
                        found[first, last] = got
                if not found and (got := self.judge_words([w for w, *_ in joined(words)])):
                    found[0, len(words) - 1] = got
            for (first, last), got in sorted(found.items()):
                yield at + first, last - first + 1, *got

    def _known(self, words: list[str]) -> bool:
        """Whether a line has a word of a template."""
        if len(self.word) >= MAX_WORDS:
            self.word.clear()
        return any(map(self.word.__getitem__, words))


class _Words(dict):
    """Whether words, as they stand in a text, are words of a template; kept for the words seen lately."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word: str) -> bool:
        value = self[word] = word.strip(EDGE) in self.index
        return value

    def __reduce__(self):
        return _Words, (self.index,)


def sample(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, text: str = "text") -> list[str]:
    """The ``max_rows`` distinct paragraphs with the smallest hashes among all of at most ``max_chars`` characters.

    Only paragraphs below a hash that leaves about twice as many are compared; it rises until enough are left. Copies share
    a hash and are merged before they are counted.
    """
    lines = docs.select(F.explode(F.split(text, "\n")).alias("p")).filter(F.length("p").between(1, max_chars)).select(F.xxhash64("p").alias("h"), "p")
    share = min(1.0, 2 * max_rows / max(1, lines.agg(F.approx_count_distinct("h")).first()[0]))
    while True:
        below = lines.filter(F.col("h") <= min(2**63 - 1, int((share - 0.5) * 2**64)))
        found = below.groupBy("h", "p").agg(F.lit(0)).orderBy("h", "p").limit(max_rows).collect()
        if len(found) == max_rows or share == 1.0:
            return [r["p"] for r in found]
        share = min(1.0, 4 * share)


def train(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, text: str = "text") -> LicenceModel:
    """Unknown paragraphs are the ``max_rows`` with the smallest hashes among all different ones of at most ``max_chars`` characters."""
    return LicenceModel(sample(docs, max_rows, max_chars, text))


def scan(docs: DataFrame, model: LicenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per licence paragraph: key, paragraph (its first line), n_lines, family, probability, similarity, confirmed.

    NULL and empty texts have no paragraphs; repeated rows give repeated findings; ties go to the family listed first.
    Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of the templates

    kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            rows = [(i, *x, bool(x[4] >= CONFIRM)) for i, t in enumerate(batch.column(1).to_pylist()) for x in own.paragraphs(t or "")]
            at, *columns = zip(*rows, strict=True) if rows else [()] * 7
            # the key stays an Arrow column: as numbers of numpy, ids beside a NULL would lose their last digits
            made = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(made, names=[key, "paragraph", "n_lines", "family", "probability", "similarity", "confirmed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, paragraph int, n_lines int, family string, probability double, similarity double, confirmed boolean")
