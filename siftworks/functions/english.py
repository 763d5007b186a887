"""Heuristic English filter as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import EMAIL, HTML_TAG, SPACE, URL, WORD

# Word list, trigram list, thresholds and patterns of the heuristic.
FUNCTION_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "while", "with", "without",
    "in", "on", "at", "by", "for", "from", "of", "to", "into", "onto", "out",
    "over", "under", "up", "down", "off", "about", "above", "below", "after",
    "before", "between", "through", "during", "against", "than", "then",
    "as", "because", "so", "such", "just", "only", "also",
    "is", "am", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having",
    "do", "does", "did", "doing", "done",
    "will", "would", "shall", "should", "can", "could", "may", "might", "must",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us",
    "them", "my", "your", "his", "hers", "its", "our", "their",
    "this", "that", "these", "those",
    "what", "which", "who", "whom", "whose", "where", "when", "why", "how",
    "not", "no", "yes", "all", "any", "some", "many", "much", "more", "most",
    "each", "every", "either", "neither", "both", "another", "other",
    "here", "there", "now", "today",
)
TRIGRAMS = (
    "the", "and", "ing", "ent", "ion", "tio", "for", "ati", "ter", "her",
    "tha", "ere", "ate", "his", "con", "res", "ver", "all", "ons", "nce",
    "men", "ith", "ted", "ers", "pro", "thi", "wit", "are", "ess", "not",
    "ive", "was", "ect", "rea", "com", "eve", "per", "int", "est", "sta",
    "cti", "ica", "ist", "ear", "ain", "one", "our", "iti", "rat", "ell",
    "you", "ave", "out", "use", "but", "edt", " th", "th ", "he ", " he",
    " an", "an ", " in", "in ", "ou ", " of", "of ", " to", "to ",
)
FUNCTION_WEIGHT, TRIGRAM_WEIGHT = 0.55, 0.45
TWO_HITS_FLOOR, SINGLE_WORD_FLOOR = 0.55, 0.6
THRESHOLD = 0.45
SURE_ABOVE, SURE_BELOW = THRESHOLD + 0.1, THRESHOLD - 0.15
MIN_LATIN = 0.7
LATIN_LETTER = r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
SOME_ALPHA = r"[A-Za-z\x{C0}-\x{24F}]"
LANGUAGE_EMOJI = r"[\x{2600}-\x{27BF}\x{1F000}-\x{1F2FF}\x{1F300}-\x{1F9FF}\x{1FA00}-\x{1FAFF}]"
REASONS = ("removed_empty_or_invalid", "removed_non_english", "removed_language_uncertain", "removed_too_noisy")


def strip_noise(text: Column) -> Column:
    for pattern in (URL, EMAIL, f"[@#]{WORD}+", HTML_TAG, LANGUAGE_EMOJI):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def function_hits(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*FUNCTION_WORDS)))


def _trigram_pattern() -> str:
    """Zero-width match wherever a common trigram starts, grouped by leading letters so that most positions fail on the
    first one."""
    groups: dict[str, dict[str, str]] = {}
    for a, b, c in sorted(TRIGRAMS):
        groups.setdefault(a, {}).setdefault(b, "")
        groups[a][b] += c
    heads = [f"{a}(?:" + "|".join(f"{b}[{c}]" for b, c in tails.items()) + ")" for a, tails in groups.items()]
    return "(?=" + "|".join(heads) + ")"


def likeness(tokens: Column, hits: Column, run: Column) -> Column:
    """Weighted share of function words and of common trigrams. ``run`` is the tokens joined by blanks; a
    zero-width look-ahead counts overlapping trigrams in one scan of it."""
    n = F.size(tokens)
    trigrams = F.when(
        F.length(run) >= 3, F.regexp_count(run, F.lit(_trigram_pattern())) / (F.length(run) - 2)
    ).otherwise(F.lit(0.0))
    score = FUNCTION_WEIGHT * hits / n + TRIGRAM_WEIGHT * trigrams
    score = F.when(hits >= 2, F.greatest(score, F.lit(TWO_HITS_FLOOR))).otherwise(score)
    score = F.when((n == 1) & (hits == 1), F.greatest(score, F.lit(SINGLE_WORD_FLOOR))).otherwise(score)
    return F.when(n == 0, F.lit(0.0)).otherwise(score)


def latin_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters == 0, F.lit(1.0)).otherwise(F.regexp_count(text, F.lit(LATIN_LETTER)) / letters)


def meaningful_alpha_ratio(text: Column) -> Column:
    """Letters left after noise removal over all non-blank characters."""
    raw = F.length(F.regexp_replace(text, SPACE, ""))
    return F.when(raw == 0, F.lit(0.0)).otherwise(F.regexp_count(strip_noise(text), F.lit(r"\p{L}")) / raw)


def with_english_class(df: DataFrame, text: str, out: str = "english_class", score: str | None = None) -> DataFrame:
    """Adds english / non_english / uncertain / noisy. The shared parts are columns of their own so that each is
    computed once per row."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("_s", strip_noise(raw))
    df = df.withColumn("_tok", latin_tokens(F.col("_s")))
    df = df.withColumn("_hits", function_hits(F.col("_tok"))).withColumn("_run", F.array_join("_tok", " "))
    df = df.withColumn("_score", likeness(F.col("_tok"), F.col("_hits"), F.col("_run")))
    n, hits, points = F.size("_tok"), F.col("_hits"), F.col("_score")
    short = (
        F.when(hits > 0, "english")
        .when((n == 1) & (F.length("_run") >= 3), "english")
        .when(points >= THRESHOLD, "english")
        .otherwise("non_english")
    )
    long = F.when(points >= SURE_ABOVE, "english").when(points < SURE_BELOW, "non_english").otherwise("uncertain")
    cls = (
        F.when(F.trim(raw) == "", "noisy")
        .when(~F.rlike(F.col("_s"), F.lit(SOME_ALPHA)), "noisy")
        .when(latin_ratio(F.col("_s")) < MIN_LATIN, "non_english")
        .when(n <= 2, short)
        .otherwise(long)
    )
    df = df.withColumn(out, cls)
    if score:
        df = df.withColumn(score, F.col("_score"))
    return df.drop("_s", "_tok", "_hits", "_run", "_score")


def with_drop_reason(df: DataFrame, text_cols: Sequence[str], out: str = "drop_reason") -> DataFrame:
    """Why a row would be removed, or NULL. Order of precedence over all text columns: empty, non-English,
    uncertain, noisy."""
    for i, c in enumerate(text_cols):
        df = with_english_class(df, c, f"_cls{i}")
    classes = F.array(*[
        F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit("empty")).otherwise(F.col(f"_cls{i}"))
        for i, c in enumerate(text_cols)
    ])
    reason = F.when(F.lit(False), F.lit(""))
    for cls, name in zip(("empty", "non_english", "uncertain", "noisy"), REASONS):
        reason = reason.when(F.array_contains(classes, cls), F.lit(name))
    return df.withColumn(out, reason).drop(*[f"_cls{i}" for i in range(len(text_cols))])


def english_rows(df: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    return with_drop_reason(df, text_cols).filter("drop_reason IS NULL").drop("drop_reason")
