"""Text functions against plain Python on hand-picked values."""

import difflib

import pytest
from pyspark.sql import functions as F

from siftworks.functions import english as en
from siftworks.functions import text as tx
from siftworks.operators import text_eval, text_profile


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def run(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_base_normalisation(spark):
    df = column(spark, ["é​x", "a b　c", "tab\x07bell", None])
    assert run(df, tx.normalize_base(F.col("t"))) == ["éx", "a b c", "tab bell", ""]


def test_masks_and_repeats(spark):
    df = column(spark, ["see <b>me</b> at https://a.b/c?x now", "mail é.x-1@ex.org!!!! @bob #tag_1", "www.x.y....."])
    out = run(df, tx.collapse_whitespace(tx.collapse_punctuation(tx.mask_entities(F.col("t")))))
    assert out == ["see me at URL now", "mail EMAIL ! MENTION tag_1", "URL"]


def test_emoji_strategies(spark):
    df = column(spark, ["hi \U0001F600\U0001F600\U0001F600\U0001F600 there", "plain"])
    assert run(df, tx.collapse_whitespace(tx.handle_emoji(F.col("t"), "remove"))) == ["hi there", "plain"]
    limited = run(df, tx.collapse_whitespace(tx.handle_emoji(F.col("t"), "limit_then_translate")))
    assert limited == ["hi grinning face grinning face there", "plain"]


def test_whole_cleaning_chain(spark):
    spec = tx.TextSpec(numbers="replace", punctuation="remove", stopwords=True, max_tokens=4)
    df = column(spark, ["The 12 CATS, and the dog's 3 bones in a box!"])
    assert run(df, tx.clean_text(F.col("t"), spec)) == ["number cats dog s"]
    assert run(df, tx.clean_text(F.col("t"), keep_alignment=True)) == ["The 12 CATS, and the dog's 3 bones in a box!"]


def test_english_classes(spark):
    values = ["the cat and the dog are in the house with you", "zxq wvut plok jjkk", "", "12345 !!!", "Привет как дела друзья", "the", "cat", "où est la"]
    got = [r["english_class"] for r in en.with_english_class(column(spark, values), "t").orderBy("i").collect()]
    assert got[0] == "english" and got[2] == "noisy" and got[3] == "noisy" and got[4] in ("noisy", "non_english")
    assert got[5] == "english" and got[6] == "english" and got[1] == "non_english"


def test_trigram_pattern_matches_each_listed_trigram(spark):
    df = column(spark, list(en.TRIGRAMS) + ["zzz", "qqq"])
    counts = run(df, F.regexp_count("t", F.lit(en._trigram_pattern())))
    assert counts == [1] * len(en.TRIGRAMS) + [0, 0]


def test_drop_reason_precedence(spark):
    df = spark.createDataFrame([("the cat is here and there", ""), ("1234", "zxq wvut plok jjkk"), ("the cat is here and there", "99")], "a string, b string")
    got = [r["drop_reason"] for r in en.with_drop_reason(df, ["a", "b"]).collect()]
    assert got == ["removed_empty_or_invalid", "removed_non_english", "removed_too_noisy"]


def test_list_cells(spark):
    df = column(spark, ["['a', 'b ']", '["x"]', "p| q |", "m,n", "single"])
    assert run(df, tx.parse_list(F.col("t"))) == [["a", "b"], ["x"], ["p", "q"], ["m", "n"], ["single"]]


def test_token_distance_and_longest_run(spark):
    pairs = [("a b c d", "a x c d e"), ("", "q"), ("the cat sat on the mat", "on the mat the cat sat"), ("k", "k")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, s in enumerate(x, 1):
            new = [i]
            for j, t in enumerate(y, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (s != t)))
            row = new
        return row[-1]

    assert run(df, tx.token_distance("a", "b")) == [lev(a.split(), b.split()) for a, b in pairs]
    want = [difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).find_longest_match().size for a, b in pairs]
    assert run(df, text_eval.longest_common_run("a", "b")) == want


def test_best_sentence_prefers_the_first_maximum(spark):
    df = spark.createDataFrame([("One two now. Three four! A one b two c.", "two one", "x"), ("A one. B one.", "one", "y"), ("", "q", "z")], "c string, q string, k string")
    got = [r[0] for r in df.orderBy("k").select(tx.best_sentence(F.col("c"), F.col("q"))).collect()]
    assert got == ["One two now.", "A one.", ""]


def test_bio_and_span_entities(spark):
    df = spark.createDataFrame([("New York is big", "B-LOC I-LOC O O"), ("Ann met Bob", '[{"start": 0, "end": 3, "label": "P"}, {"start": 8, "end": 11, "label": "P"}]'),
                                ("x y", "I-A B-A")], "t string, e string")
    got = [[tuple(e) for e in r[0]] for r in df.select(text_eval.parse_entities(F.col("t"), F.col("e"))).collect()]
    assert got == [[("new york", "LOC")], [("ann", "P"), ("bob", "P")], [("y", "A")]]


def test_label_helpers(spark):
    df = spark.createDataFrame([("a|b",), ("b",), (None,)], "l string")
    assert {r["label"]: r["n"] for r in text_profile.list_label_counts(df, "l").collect()} == {"a": 1, "b": 2}
    assert text_profile.missing_targets(df, "l").first()[0] == 1


def test_character_terms_of_short_words(spark):
    from siftworks.operators.tfidf import char_terms

    got = run(column(spark, ["ab", "abc", "a"]), char_terms(F.col("t")))
    assert [sorted(g) for g in got] == [sorted([" ab", "ab ", " ab "]), sorted([" ab", "abc", "bc ", " abc", "abc ", " abc "]), [" a "]]


def test_word_errors_ignore_case_and_outer_blanks(spark):
    df = spark.createDataFrame([(0, " The Cat sat ", "the cat SAT"), (1, "a b", "a c d"), (2, None, "x y")], "i int, a string, b string")
    assert run(df, tx.token_distance(F.col("a"), F.col("b"))) == [0, 2, 2]


def test_overlap_counts_repeats_inside_the_row(spark):
    from collections import Counter

    def f1(a, b, n):
        a, b = ([" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] for w in ((a or "").lower().split(), (b or "").lower().split()))
        shared = sum((Counter(a) & Counter(b)).values())
        p, r = shared / max(len(a), 1), shared / max(len(b), 1)
        return 2 * p * r / max(p + r, 1e-12)

    pairs = [("a a b A", "a b b a"), ("", "q"), (None, "q"), (None, None), ("x", "x"), ("a\x011 a", "a a\x011 a"), ("one", "two"), ("w " * 400 + "v", "v " + "w " * 300), (" ".join(str(i % 7) for i in range(900)), " ".join(str(i % 11) for i in range(700)))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for n in (1, 2, 3):
        assert run(df, text_eval.overlap_f1("a", "b", n)) == pytest.approx([f1(a, b, n) for a, b in pairs])


def test_summaries_are_scored_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "a b c", "a b")], "id int, s string, r string")
    for scored in (text_eval.rouge(df, "id", "s", "r"), df.select(text_eval.overlap_f1("s", "r", 1))):
        assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
