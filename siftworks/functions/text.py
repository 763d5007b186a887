"""Text cleaning as Column expressions. Python is used only for what the JVM functions lack: Unicode
normalisation and emoji names, and there only rows that need it cross the Arrow boundary."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import let

# Character classes and patterns. WORD is the portable form of a Unicode word character.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{2060}\x{feff}\x{ad}]+"
ODD_SPACE = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+"
HTML_TAG = r"<[^>]+>"
URL = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
EMAIL = rf"{NOT_WORD_BEFORE}{WORD}[\p{{L}}\p{{N}}_.\-]*@[\p{{L}}\p{{N}}_.\-]+\.{WORD}+"
MENTION = rf"@{WORD}+"
HASHTAG = rf"#({WORD}+)"
REPEATED_PUNCT = r"([!?.,;:\-])\1{2,}"
EMOJI = r"[\x{2600}-\x{27BF}\x{FE00}-\x{FEFF}\x{10000}-\x{10FFFF}]"
COUNTED_EMOJI = r"[\x{2600}-\x{27BF}\x{1F300}-\x{1F9FF}\x{1FA00}-\x{1FAFF}]"
EMOJI_RUN_LIMIT = 2
EMOJI_RUN = rf"({COUNTED_EMOJI})\1{{{EMOJI_RUN_LIMIT},}}"
EMOJI_NAME_NOISE = ("symbol", "sign", "selector", "variation")
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it",
    "its", "of", "on", "that", "the", "to", "was", "were", "will", "with", "this", "these", "those",
)


@dataclass(frozen=True)
class TextSpec:
    clean_urls_emails_html: bool = True
    emoji: str = "preserve"
    numbers: str = "keep"
    lowercase: bool = True
    punctuation: str = "keep"
    whitespace: bool = True
    stopwords: bool = False
    max_tokens: int = 0


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _emoji_words(s: pd.Series) -> pd.Series:
    """Each character of a text of emoji, followed by its words."""
    import re
    import unicodedata

    def words(c):
        name = unicodedata.name(c, "").lower()
        kept = [w for w in re.findall("[a-z0-9]+", name) if w not in EMOJI_NAME_NOISE]
        return f"{c} {' '.join(kept) or 'emoji'} "

    return s.map(lambda v: v if v is None else [words(c) for c in v])


def _describe_emoji(text: Column) -> Column:
    """Emoji replaced by their words. Python gets the different emoji of a text alone, not the text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({EMOJI})"), F.lit(1)))
    worded = _emoji_words(F.array_join(found, ""))
    return F.aggregate(worded, text, lambda t, w: F.replace(t, F.left(w, F.lit(1)), F.substr(w, F.lit(2))))


def only_where(condition: Column, udf, text: Column) -> Column:
    """Apply a Python function to the rows that need it; the others are sent as NULL."""
    return F.coalesce(udf(F.when(condition, text)), text)


def normalize_base(text: Column, nfc: bool = True) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    if nfc:
        text = only_where(F.rlike(text, F.lit(r"[^\x00-\x{2ff}]")), _nfc, text)
    text = F.regexp_replace(text, ZERO_WIDTH, "")
    text = F.regexp_replace(text, ODD_SPACE, " ")
    return F.regexp_replace(text, CONTROL, " ")


def mask_entities(text: Column) -> Column:
    """Markup removed; links, addresses and mentions replaced by markers; hashtags kept as words."""
    text = F.regexp_replace(text, HTML_TAG, " ")
    text = F.regexp_replace(text, URL, " URL ")
    text = F.regexp_replace(text, EMAIL, " EMAIL ")
    text = F.regexp_replace(text, MENTION, " MENTION ")
    return F.regexp_replace(text, HASHTAG, " $1 ")


def collapse_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, REPEATED_PUNCT, "$1")


def handle_emoji(text: Column, strategy: str) -> Column:
    if strategy == "remove":
        return F.regexp_replace(text, EMOJI, " ")
    if strategy == "limit_then_translate":
        text = F.regexp_replace(text, EMOJI_RUN, "$1" * EMOJI_RUN_LIMIT)
    if strategy in ("describe", "translate_to_text", "limit_then_translate"):
        return _describe_emoji(text)
    return text


def handle_numbers(text: Column, mode: str) -> Column:
    if mode == "keep":
        return text
    return F.regexp_replace(text, r"\p{Nd}+", " NUMBER " if mode == "replace" else " ")


def handle_punctuation(text: Column, mode: str) -> Column:
    if mode == "keep":
        return text
    return F.regexp_replace(text, r"\p{Punct}", " " if mode == "remove" else " $0 ")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def words(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda t: t != "")


def word_tokens(text: Column, min_length: int = 1) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{{min_length},}}"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+"))


def drop_stop_words(text: Column) -> Column:
    return F.array_join(F.filter(words(text), lambda t: ~F.lower(t).isin(*STOP_WORDS)), " ")


def truncate_tokens(text: Column, limit: int) -> Column:
    return let(text, lambda t: let(words(t), lambda tokens: F.when(
        F.size(tokens) > limit, F.array_join(F.slice(tokens, 1, limit), " ")).otherwise(t)))


def clean_text(text: Column, spec: TextSpec = TextSpec(), keep_alignment: bool = False, nfc: bool = True) -> Column:
    """The whole cleaning of one text value as a single expression."""
    text = normalize_base(text, nfc)
    if keep_alignment:
        return F.trim(F.regexp_replace(text, r"[ \t]+", " ")) if spec.whitespace else text
    if spec.clean_urls_emails_html:
        text = mask_entities(text)
    text = handle_emoji(collapse_punctuation(text), spec.emoji)
    text = handle_numbers(text, spec.numbers)
    if spec.lowercase:
        text = F.lower(text)
    text = handle_punctuation(text, spec.punctuation)
    if spec.whitespace:
        text = collapse_whitespace(text)
    if spec.stopwords:
        text = drop_stop_words(text)
    return truncate_tokens(text, spec.max_tokens) if spec.max_tokens > 0 else text


def sentences(text: Column) -> Column:
    parts = F.split(text, rf"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, lambda v: F.trim(v)), lambda s: s != "")


def lead_summary(text: Column) -> Column:
    """First min(75, max(20, a quarter)) words."""
    def first(tokens):
        n = F.least(F.lit(75), F.greatest(F.lit(20), F.floor(F.size(tokens) / 4).cast("int")))
        return F.array_join(F.slice(tokens, F.lit(1), n), " ")

    return let(words(text), first)


def best_sentence(context: Column, question: Column) -> Column:
    """First sentence that shares the most distinct words with the question; the context if it has none."""
    scored = let(F.array_distinct(words(F.lower(question))), lambda q: F.transform(
        sentences(context),
        lambda s, i: F.struct(F.size(F.array_intersect(words(F.lower(s)), q)).alias("hits"), (-i).alias("at"), s.alias("s")),
    ))
    return F.coalesce(F.array_max(scored)["s"], context)


def parse_list(cell: Column) -> Column:
    """A list cell: JSON or quoted list literal, else split at ``|`` or ``,``; blanks are dropped."""
    parsed = F.from_json(cell, "array<string>")
    listed = F.when(F.rlike(cell, F.lit(r"^\s*\[")), parsed)
    split = F.when(F.contains(cell, F.lit("|")), F.split(cell, r"\|")).otherwise(F.split(cell, ","))
    return F.filter(F.transform(F.coalesce(listed, split), lambda v: F.trim(v)), lambda v: v != "")


def char_distance_metrics(pred: Column, truth: Column) -> dict[str, Column]:
    """CER, edit similarity and exact match of two strings, case-insensitive."""
    cer = F.levenshtein(F.lower(pred), F.lower(truth)) / F.greatest(F.length(truth), F.lit(1))
    return {
        "cer": cer,
        "edit_similarity": 1 - F.least(cer, F.lit(1.0)),
        "exact": (F.lower(F.trim(pred)) == F.lower(F.trim(truth))).cast("int"),
    }


@F.pandas_udf(T.IntegerType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance on lower-cased whitespace tokens; one numpy row per token of the shorter side."""
    import numpy as np

    def one(x, y):
        x, y = (x or "").lower().split(), (y or "").lower().split()
        if len(x) > len(y):
            x, y = y, x
        codes: dict[str, int] = {}
        yy = np.array([codes.setdefault(t, len(codes)) for t in y], dtype=np.int64)
        at = np.arange(len(y) + 1)
        row = at.copy()
        for i, t in enumerate(x, 1):
            sub = row[:-1] + (yy != codes.get(t, -1))
            nxt = np.concatenate(([i], np.minimum(sub, row[1:] + 1)))
            row = np.minimum.accumulate(nxt - at) + at
        return int(row[-1])

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def safe_stem(name: Column) -> Column:
    """File-name-safe token: runs of other characters become one underscore, outer dots and underscores go."""
    token = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._\-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(F.coalesce(token, F.lit("")) == "", F.lit("item")).otherwise(token)


def stem_words(path: Column) -> Column:
    """File stem read as words."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.trim(F.regexp_replace(stem, "[_-]", " "))
