"""Text cleaning, corpus profile, English filter, TF-IDF and text task queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import english as en
from ..functions import text as tx
from ..operators import metrics, text_eval, text_profile, tfidf
from ..session import spread, table
from .registry import query, rounded

# RE2 spellings of the patterns that use look-around or back-references on the Spark side.
W = tx.WORD
RE2_EMAIL = r"[\p{L}\p{N}_][\p{L}\p{N}_.\-]*@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+"
RE2_REPEATS = {"!": "!{3,}", "?": r"\?{3,}", ".": r"\.{3,}", ",": ",{3,}", ";": ";{3,}", ":": ":{3,}", "-": "-{3,}"}
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def chain(expr: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return expr


def sql_base(c: str) -> str:
    return chain(f"nfc_normalize({c})", (tx.ZERO_WIDTH, ""), (tx.ODD_SPACE, " "), (tx.CONTROL, " "))


def sql_mask(c: str) -> str:
    return chain(c, (tx.HTML_TAG, " "), (tx.URL, " URL "), (RE2_EMAIL, " EMAIL "), (tx.MENTION, " MENTION "), (tx.HASHTAG, r" \1 "))


def sql_squash(c: str) -> str:
    return f"trim({chain(c, (BLANK + '+', ' '))})"


def sql_words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{BLANK}+'), lambda w: w <> '')"


def sql_strip(c: str) -> str:
    return sql_squash(chain(c, (tx.URL, " "), (RE2_EMAIL, " "), (f"[@#]{W}+", " "), (tx.HTML_TAG, " "), (en.LANGUAGE_EMOJI, " ")))


def docs(spark, d):
    return spread(table(spark, d, "documents"), "doc_id")


def pages(spark, d):
    return spread(table(spark, d, "pages"), "page_id")


@query("str01_08_normalize", f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {sql_squash(sql_base('text'))} AS t FROM documents)")
def str01(spark, d):
    t = docs(spark, d).select("doc_id", tx.collapse_whitespace(tx.normalize_base(F.col("text"))).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("str02_mask_pages", f"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, {sql_squash(sql_mask('html'))} AS t FROM pages)")
def str02(spark, d):
    t = pages(spark, d).select("page_id", tx.collapse_whitespace(tx.mask_entities(F.col("html"))).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


CLEAN_SPEC = tx.TextSpec(emoji="remove", numbers="replace", punctuation="space", stopwords=True, max_tokens=200)
CLEAN_SQL = chain(sql_mask(sql_base("text")), *[(p, c) for c, p in RE2_REPEATS.items()], (tx.EMOJI, " "), (r"\p{Nd}+", " NUMBER "))
CLEAN_SQL = sql_squash(chain(f"lower({CLEAN_SQL})", (r"([[:punct:]])", r" \1 ")))
STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query("str03_11_clean_documents", f"""WITH c AS (SELECT doc_id, list_filter({sql_words(CLEAN_SQL)}, lambda w: NOT list_contains([{STOP_SQL}], w)) AS w FROM documents)
  SELECT doc_id, least(len(w), 200) AS n_tokens, md5(array_to_string(w[1:200], ' ')) AS digest FROM c""")
def str11(spark, d):
    t = docs(spark, d).select("doc_id", tx.clean_text(F.col("text"), CLEAN_SPEC).alias("t"))
    return t.select("doc_id", F.size(tx.words(F.col("t"))).cast("long").alias("n_tokens"), F.md5("t").alias("digest"))


@query("snk02_processed_text", f"""SELECT conv_id, turn, md5({sql_squash('lower(' + chain(sql_mask(sql_base('text')), *[(p, c) for c, p in RE2_REPEATS.items()]) + ')')}) AS text_processed FROM conversations""")
def snk02(spark, d):
    from ..sinks.datasets import processed_columns

    out = processed_columns(table(spark, d, "conversations"), ["text"])
    return out.select("conv_id", "turn", F.md5("text_processed").alias("text_processed"))


@query("str04_describe_emoji")
def str04(spark, d):
    marked = F.concat("text", F.lit(" \U0001F600\U0001F600\U0001F600 "), "source")
    t = docs(spark, d).select("doc_id", tx.handle_emoji(marked, "limit_then_translate").alias("t"))
    return t.select("doc_id", F.regexp_count("t", F.lit("grinning face")).alias("described"), F.length("t").alias("n"))


@query("tpr01_length_stats", rf"""WITH s AS (SELECT length(text) AS c, len(regexp_extract_all(text, '{W}+')) AS t FROM documents)
  SELECT round(avg(c), 6) AS avg_chars, round(stddev_pop(c), 6) AS std_chars, min(c) AS min_chars, max(c) AS max_chars,
  round(avg(t), 6) AS avg_tokens, round(stddev_pop(t), 6) AS std_tokens, min(t) AS min_tokens, max(t) AS max_tokens FROM s""")
def tpr01(spark, d):
    return rounded(text_profile.length_stats(docs(spark, d), "text"))


@query("tpr02_length_buckets", rf"""SELECT CASE WHEN t = 0 THEN 'empty' WHEN t < 10 THEN '<10 words' WHEN t < 100 THEN '10-99 words' WHEN t < 500 THEN '100-499 words' ELSE '500+ words' END AS bucket,
  count(*) AS n FROM (SELECT len(regexp_extract_all(text, '{W}+')) AS t FROM documents) GROUP BY 1""")
def tpr02(spark, d):
    return text_profile.length_distribution(docs(spark, d), "text")


@query("tpr03_vocabulary", rf"""SELECT count(DISTINCT t) AS vocabulary_size, count(*) AS n_tokens, round(count(DISTINCT t) / count(*), 6) AS unique_token_ratio
  FROM (SELECT unnest(regexp_extract_all(lower(text), '{W}+')) AS t FROM documents)""")
def tpr03(spark, d):
    return rounded(text_profile.vocabulary_stats(docs(spark, d), "text"))


@query("tpr04_empty_duplicate", """SELECT count(*) FILTER (trim(text) = '') AS n_empty, count(*) - count(DISTINCT text) AS n_duplicates FROM documents""")
def tpr04(spark, d):
    return text_profile.empty_and_duplicate_texts(docs(spark, d), "text")


NOISE_SQL = {
    **text_profile.NOISE,
    "excessive_punctuation": r"!{3,}|\?{3,}|\.{3,}|,{3,}",
    "all_caps": r"(^|[^\p{L}\p{N}_])[A-Z]{4,}($|[^\p{L}\p{N}_])",
}


@query("tpr05_noise", "WITH t AS (SELECT text AS x FROM documents UNION ALL SELECT html FROM pages) " + " UNION ALL ".join(
    f"SELECT '{k}' AS detector, count(*) FILTER (regexp_matches(x, '{p}')) AS n, round(avg(regexp_matches(x, '{p}')::INT), 6) AS ratio FROM t"
    for k, p in NOISE_SQL.items()) + " UNION ALL SELECT 'any', count(*) FILTER (a), round(avg(a::INT), 6) FROM (SELECT "
    + " OR ".join(f"regexp_matches(x, '{p}')" for p in NOISE_SQL.values()) + " AS a FROM t)")
def tpr05(spark, d):
    both = docs(spark, d).select("text").union(pages(spark, d).select("html"))
    return rounded(text_profile.noise_profile(both, "text"))


@query("tpr06_scripts", rf"""SELECT CASE WHEN regexp_matches(text, '{text_profile.ARABIC}') THEN 'Arabic' WHEN regexp_matches(text, '{text_profile.CHINESE}') THEN 'Chinese'
  WHEN len(regexp_extract_all(text, '\p{{L}}')) > 0 AND len(regexp_extract_all(text, '[A-Za-z]')) / len(regexp_extract_all(text, '\p{{L}}')) > 0.7 THEN 'Latin' ELSE 'Unknown' END AS script,
  count(*) AS n FROM documents GROUP BY 1""")
def tpr06(spark, d):
    return text_profile.script_distribution(docs(spark, d), "text")


@query("tpr07_labels", """WITH c AS (SELECT lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1)
  SELECT count(*) AS n_classes, min(n) AS min_class, round(max(n) / min(n), 6) AS imbalance FROM c""")
def tpr07(spark, d):
    return rounded(text_profile.label_summary(text_profile.label_counts(docs(spark, d), "lang")))


@query("tpr07_str22_list_labels", """SELECT label, count(*) AS n FROM (SELECT unnest([lang, source, 'k' || (doc_id % 3)]) AS label FROM documents) GROUP BY label""")
def tpr07_list(spark, d):
    third = F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string"))
    cell = (
        F.when(F.col("doc_id") % 3 == 0, F.concat_ws("|", "lang", "source", third))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("['"), F.concat_ws("', '", "lang", "source", third), F.lit("']")))
        .otherwise(F.to_json(F.array("lang", "source", third)))
    )
    return text_profile.list_label_counts(docs(spark, d).select(cell.alias("labels")), "labels")


@query("tpr07_binary_labels", "SELECT 'quality' AS label, sum(quality)::BIGINT AS n FROM labels UNION ALL SELECT 'toxic', sum(toxic)::BIGINT FROM labels")
def tpr07_binary(spark, d):
    return text_profile.binary_label_counts(table(spark, d, "labels"), ["quality", "toxic"])


def qa_rows(spark, d):
    """User turn as question, the next turn as context, its first sentence as answer."""
    c = table(spark, d, "conversations")
    users = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    replies = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("context"))
    both = users.join(replies, ["conv_id", "turn"])
    return both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question", "context",
                       F.regexp_extract("context", r"^[^.!?]*[.!?]", 0).alias("answer"))


QA = r"""qa AS (SELECT u.conv_id * 1000 + r.turn AS id, u.text AS question, r.text AS context, regexp_extract(r.text, '^[^.!?]*[.!?]') AS answer
  FROM conversations u JOIN conversations r ON u.conv_id = r.conv_id AND r.turn = u.turn + 1 WHERE u.role = 'user' AND r.role = 'assistant')"""


@query("tpr08_answer_validity", f"""WITH {QA}, v AS (SELECT trim(answer) <> '' AND contains(lower(context), lower(answer)) AS ok FROM qa)
  SELECT count(*) FILTER (ok) AS valid_count, count(*) FILTER (NOT ok) AS invalid_count, round(avg(ok::INT), 6) AS valid_ratio FROM v""")
def tpr08(spark, d):
    t = qa_rows(spark, d)
    return rounded(text_profile.validity(t, text_profile.valid_answer(F.col("context"), F.col("answer"))))


@query("tpr08_entity_validity", """SELECT CASE doc_id % 4 WHEN 0 THEN 'spans' WHEN 1 THEN 'triples' WHEN 2 THEN 'tags' ELSE 'broken' END AS kind,
  count(*) FILTER (doc_id % 4 <> 3) AS valid, sum(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END)::BIGINT AS entities FROM documents GROUP BY 1""")
def tpr08_entities(spark, d):
    m = F.col("doc_id") % 4
    cell = (
        F.when(m == 0, F.lit('[{"start": 0, "end": 3, "label": "A"}, {"start": 4, "end": 6, "label": "B"}]'))
        .when(m == 1, F.lit('[[0, 5, "A"]]')).when(m == 2, F.lit("B-X I-X O")).otherwise(F.lit("B-X maybe"))
    )
    t = docs(spark, d).select(m.alias("m"), cell.alias("cell"))
    ok, count = text_profile.valid_entities(F.col("cell"))
    kind = F.when(F.col("m") == 0, "spans").when(F.col("m") == 1, "triples").when(F.col("m") == 2, "tags").otherwise("broken")
    return t.groupBy(kind.alias("kind")).agg(F.count_if(ok).alias("valid"), F.sum(count).alias("entities"))


@query("tpr09_length_ratio", rf"""WITH {QA} SELECT round(avg(len(regexp_extract_all(question, '{W}+')) / greatest(len(regexp_extract_all(context, '{W}+')), 1)), 6) AS source_target_length_ratio FROM qa""")
def tpr09(spark, d):
    return rounded(text_profile.length_ratio(qa_rows(spark, d), "context", "question"))


@query("tpr10_emoji", rf"""SELECT 0::BIGINT AS emoji_translated_count, sum(len(regexp_extract_all(text, '{tx.COUNTED_EMOJI}')))::BIGINT AS emoji_removed_count, 0::BIGINT AS removed_excessive_emoji_count
  FROM (SELECT text FROM documents UNION ALL SELECT html FROM pages)""")
def tpr10(spark, d):
    both = docs(spark, d).select("text").union(pages(spark, d).select("html"))
    return text_profile.emoji_stats(both, "text", "remove")


@query("tpr11_aux_ratios", """SELECT round((avg((lang = 'en')::INT) + 0) / 2, 6) AS extra_feature_missing_ratio, 0.5::DOUBLE AS text_to_tabular_feature_ratio FROM documents""")
def tpr11(spark, d):
    from ..operators.tabular_profile import missing_ratios

    aux = docs(spark, d).select(F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), "n_chars")
    return rounded(text_profile.auxiliary_ratios(missing_ratios(aux), 1))


@query("tpr12_corpus_buckets", rf"""WITH s AS (SELECT source, lang, len(regexp_extract_all(text, '{W}+')) AS t FROM documents),
  v AS (SELECT source, lang, count(DISTINCT w) AS v FROM (SELECT source, lang, unnest(regexp_extract_all(lower(text), '{W}+')) AS w FROM documents) GROUP BY ALL),
  p AS (SELECT source, lang, count(*) AS n, avg(t) AS a, stddev_pop(t) AS s FROM s GROUP BY ALL)
  SELECT source, lang, CASE WHEN n < 500 THEN 'small' WHEN n < 5000 THEN 'medium' ELSE 'large' END AS sample_count_bucket, round(least(log10(greatest(n, 1)) / 6, 1), 6) AS sample_count_ratio,
  CASE WHEN a < 30 THEN 'short' WHEN a < 300 THEN 'medium' ELSE 'long' END AS average_length_bucket,
  CASE WHEN s / greatest(a, 1e-6) < 0.25 THEN 'low' WHEN s / greatest(a, 1e-6) < 1 THEN 'medium' ELSE 'high' END AS length_variance_bucket,
  CASE WHEN v < 2000 THEN 'small' WHEN v < 50000 THEN 'medium' ELSE 'large' END AS vocabulary_size_bucket FROM p JOIN v USING (source, lang)""")
def tpr12(spark, d):
    t = docs(spark, d)
    sizes = t.groupBy("source", "lang").agg(
        F.count("*").alias("n_samples"), F.avg(tx.token_count(F.col("text"))).alias("avg_tokens"), F.stddev_pop(tx.token_count(F.col("text"))).alias("std_tokens"))
    seen = t.select("source", "lang", F.explode(tx.word_tokens(F.col("text"))).alias("w")).distinct()
    vocab = seen.groupBy("source", "lang").agg(F.count("*").alias("vocabulary_size"))
    out = text_profile.corpus_buckets(sizes.join(vocab, ["source", "lang"]))
    return rounded(out.drop("n_samples", "avg_tokens", "std_tokens", "vocabulary_size"))


SQL_FUNCTION_WORDS = ", ".join(f"'{w}'" for w in en.FUNCTION_WORDS)
SQL_TRIGRAMS = ", ".join(f"'{w}'" for w in en.TRIGRAMS)


def english_cte(source: str, key: str, text: str) -> str:
    latin = en.LATIN_LETTER
    return rf"""e0 AS (SELECT {key}, {text} AS raw, {sql_strip(text)} AS s FROM {source}),
  e1 AS (SELECT *, regexp_extract_all(lower(s), '[a-z]+') AS tok FROM e0),
  e2 AS (SELECT *, len(tok) AS n, len(list_filter(tok, lambda t: list_contains([{SQL_FUNCTION_WORDS}], t))) AS hits, array_to_string(tok, ' ') AS run FROM e1),
  e3 AS (SELECT *, CASE WHEN length(run) >= 3 THEN len(list_filter(list_concat(list_concat(regexp_extract_all(run, '.{{3}}'), regexp_extract_all(run[2:], '.{{3}}')),
    regexp_extract_all(run[3:], '.{{3}}')), lambda g: list_contains([{SQL_TRIGRAMS}], g))) / (length(run) - 2) ELSE 0 END AS tri,
    len(regexp_extract_all(s, '\p{{L}}')) AS letters, len(regexp_extract_all(s, '{latin}')) AS latin FROM e2),
  e4 AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(0.55 * hits / n + 0.45 * tri, CASE WHEN hits >= 2 THEN 0.55 ELSE 0 END, CASE WHEN n = 1 AND hits = 1 THEN 0.6 ELSE 0 END) END AS score FROM e3),
  e5 AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'noisy' WHEN NOT regexp_matches(s, '{en.SOME_ALPHA}') THEN 'noisy'
    WHEN letters > 0 AND latin / letters < 0.7 THEN 'non_english'
    WHEN n <= 2 THEN CASE WHEN hits > 0 OR (n = 1 AND length(run) >= 3) OR score >= 0.45 THEN 'english' ELSE 'non_english' END
    WHEN score >= {en.SURE_ABOVE} THEN 'english' WHEN score < {en.SURE_BELOW} THEN 'non_english' ELSE 'uncertain' END AS english_class FROM e4)"""


@query("str12_14_english_class", f"WITH {english_cte('documents', 'doc_id', 'text')} SELECT doc_id, english_class, round(score, 6) AS score FROM e5")
def str14(spark, d):
    return rounded(en.with_english_class(docs(spark, d), "text", score="score").select("doc_id", "english_class", "score"))


@query("str13_alpha_ratio", rf"""SELECT page_id, round(CASE WHEN length(r) = 0 THEN 0 ELSE len(regexp_extract_all(s, '\p{{L}}')) / length(r) END, 6) AS alpha_ratio
  FROM (SELECT page_id, {sql_strip('html')} AS s, {chain('html', (BLANK, ''))} AS r FROM pages)""")
def str13(spark, d):
    return rounded(pages(spark, d).select("page_id", en.meaningful_alpha_ratio(F.col("html")).alias("alpha_ratio")))


@query("flt06_english_rows", f"""WITH {english_cte("(SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT -1 - page_id, url FROM pages UNION ALL SELECT 1000000000 + doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE text END FROM documents)", 'id', 'text')}
  SELECT coalesce(CASE WHEN trim(raw) = '' THEN 'removed_empty_or_invalid' WHEN english_class = 'non_english' THEN 'removed_non_english' WHEN english_class = 'uncertain' THEN 'removed_language_uncertain'
  WHEN english_class = 'noisy' THEN 'removed_too_noisy' END, 'final') AS reason, count(*) AS n FROM e5 GROUP BY 1""")
def flt06(spark, d):
    t = table(spark, d, "conversations").select("text").union(pages(spark, d).select("url")).union(
        docs(spark, d).select(F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("text"))))
    return en.with_drop_reason(t, ["text"]).groupBy(F.coalesce("drop_reason", F.lit("final")).alias("reason")).agg(F.count("*").alias("n"))


@query("str15_edit_distance", """SELECT l.l_partkey AS id, levenshtein(lower(a.p_name || a.p_type), lower(b.p_name || b.p_type))::BIGINT AS distance
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l JOIN part a ON a.p_partkey = l.l_partkey JOIN part b ON b.p_partkey = l.l_suppkey""")
def str15(spark, d):
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part = table(spark, d, "part").select("p_partkey", F.lower(F.concat("p_name", "p_type")).alias("t"))
    a = part.select(F.col("p_partkey").alias("l_partkey"), F.col("t").alias("ta"))
    b = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("t").alias("tb"))
    return pairs.join(a, "l_partkey").join(b, "l_suppkey").select(F.col("l_partkey").alias("id"), F.levenshtein("ta", "tb").cast("long").alias("distance"))


@query("met12_evl19_text_errors", """SELECT round(avg(levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_type), 1)), 6) AS cer,
  round(avg(1 - least(levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_type), 1), 1)), 6) AS edit_similarity,
  round(avg((lower(trim(p_name)) = lower(trim(p_type)))::INT), 6) AS exact FROM part""")
def met12(spark, d):
    m = tx.char_distance_metrics(F.col("p_name"), F.col("p_type"))
    return rounded(table(spark, d, "part").select(*[c.alias(k) for k, c in m.items()]).agg(*[F.avg(k).alias(k) for k in m]))


@query("str16_evl20_word_errors")
def str16(spark, d):
    wer = tx.token_distance(F.col("question"), F.col("answer")) / F.greatest(F.size(tx.words(F.col("answer"))), F.lit(1))
    return qa_rows(spark, d).select("id", wer.alias("wer"))


@query("str17_sentences", rf"""SELECT doc_id, len(s) AS n_sentences, md5(s[1]) AS first FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){BLANK}+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents)""")
def str17(spark, d):
    s = docs(spark, d).select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.get("s", F.lit(0))).alias("first"))


@query("str24_safe_names", r"""SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS safe,
  trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '[_-]', ' ', 'g')) AS stem FROM pages""")
def str24(spark, d):
    return pages(spark, d).select("page_id", tx.safe_stem(F.col("url")).alias("safe"), tx.stem_words(F.col("url")).alias("stem"))


TERMS = rf"""tk AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}{{2,}}') AS tok FROM documents),
  ex AS (SELECT doc_id, unnest(list_concat(tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) AS term FROM tk),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM ex GROUP BY ALL),
  vc AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 20000),
  w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN vc USING (term)),
  nw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@query("ftr12_tfidf", f"WITH {TERMS} SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS top_weight FROM nw GROUP BY doc_id")
def ftr12(spark, d):
    rows = tfidf.tfidf_rows(docs(spark, d), "doc_id", F.col("text"), min_df=2)
    return rounded(rows.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("weight").alias("weight_sum"), F.max("weight").alias("top_weight")))


@query("ftr12_char_tfidf", r"""WITH wd AS (SELECT item_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '[\s\p{Z}]+'), lambda w: w <> '')) || ' ' AS w FROM benchmark),
  ex AS (SELECT item_id, unnest(list_concat(list_concat(
      CASE WHEN length(w) >= 3 THEN list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) ELSE [] END,
      CASE WHEN length(w) >= 4 THEN list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) ELSE [] END),
      CASE WHEN length(w) >= 5 THEN list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5)) ELSE [] END)) AS term FROM wd),
  tf AS (SELECT item_id, term, count(*) AS tf FROM ex GROUP BY ALL)
  SELECT item_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_grams FROM tf GROUP BY item_id""")
def ftr12_char(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.explode(tfidf.char_terms(F.col("text"))).alias("term"))
    return rows.groupBy("item_id", "term").agg(F.count("*").alias("tf")).groupBy("item_id").agg(
        F.count("*").alias("n_terms"), F.sum("tf").alias("n_grams"))


PAIR_TERMS = rf"""WITH {QA}, sides AS (SELECT id, 'a' AS side, question AS text FROM qa UNION ALL SELECT id, 'b', context FROM qa),
  tk AS (SELECT id, side, regexp_extract_all(lower(text), '{W}{{2,}}') AS tok FROM sides),
  ex AS (SELECT id, side, unnest(list_concat(tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) AS term FROM tk),
  tf AS (SELECT id, side, term, count(*) AS tf FROM ex GROUP BY ALL),
  vc AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 20000),
  w AS (SELECT id, side, term, tf * (ln((1 + (SELECT count(*) FROM sides)) / (1 + df)) + 1) AS w FROM tf JOIN vc USING (term)),
  nw AS (SELECT id, side, term, w / sqrt(sum(w * w) OVER (PARTITION BY id, side)) AS weight FROM w),
  sc AS (SELECT qa.id, coalesce(s, 0) AS score, length(question) / length(context) AS truth FROM qa LEFT JOIN
    (SELECT a.id, sum(a.weight * b.weight) AS s FROM nw a JOIN nw b ON a.id = b.id AND a.term = b.term AND a.side = 'a' AND b.side = 'b' GROUP BY a.id) USING (id))"""


@query("evl10_pair_similarity", PAIR_TERMS + """, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs, rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2.0 AS rt FROM sc)
  SELECT 'pearson' AS metric, round(corr(truth, score), 6) AS value FROM sc UNION ALL SELECT 'spearman', round(corr(rt, rs), 6) FROM r""")
def evl10(spark, d):
    pairs = qa_rows(spark, d)
    scores = tfidf.pair_cosine(pairs, "id", F.col("question"), F.col("context"))
    truth = pairs.select("id", (F.length("question") / F.length("context")).alias("truth"))
    return rounded(metrics.correlation_metrics(truth.join(scores, "id"), "truth", "score"))


def sql_overlap(pred: str, ref: str, n: int, out: str, source: str) -> str:
    gram = "{w}" if n == 1 else "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    return f"""{out}_g AS (SELECT id, g, sum(p) AS p, sum(r) AS r FROM (SELECT id, unnest({gram.replace('{w}', 'pw')}) AS g, 1 AS p, 0 AS r FROM {source} UNION ALL
    SELECT id, unnest({gram.replace('{w}', 'rw')}), 0, 1 FROM {source}) GROUP BY id, g),
  {out}_s AS (SELECT id, sum(least(p, r)) AS o, sum(p) AS np, sum(r) AS nr FROM {out}_g GROUP BY id),
  {out}_f AS (SELECT id, 2 * (o / greatest(np, 1)) * (o / greatest(nr, 1)) / greatest(o / greatest(np, 1) + o / greatest(nr, 1), 1e-12) AS f FROM {out}_s)"""


@query("evl11_str18_20_summarization", f"""WITH {QA}, b AS (SELECT id, {sql_words(sql_squash(sql_base('context')))} AS src, {sql_words('lower(question)')} AS rw FROM qa),
  x AS (SELECT id, list_transform(src[1:least(75, greatest(20, len(src) // 4))], lambda w: lower(w)) AS pw, rw FROM b), {sql_overlap('pw', 'rw', 1, 'r1', 'x')}, {sql_overlap('pw', 'rw', 2, 'r2', 'x')},
  pi AS (SELECT id, unnest(pw) AS w, generate_subscripts(pw, 1) AS i FROM x), ri AS (SELECT id, unnest(rw) AS w, generate_subscripts(rw, 1) AS j FROM x),
  h AS (SELECT pi.id, i, i - j AS dg, row_number() OVER (PARTITION BY pi.id, i - j ORDER BY i) AS k FROM pi JOIN ri ON pi.id = ri.id AND pi.w = ri.w),
  l AS (SELECT id, max(c) AS run FROM (SELECT id, dg, i - k, count(*) AS c FROM h GROUP BY ALL) GROUP BY id),
  rl AS (SELECT x.id, coalesce(run, 0) / greatest(len(pw), 1) AS p, coalesce(run, 0) / greatest(len(rw), 1) AS r FROM x LEFT JOIN l USING (id))
  SELECT round(avg(coalesce(r1_f.f, 0)), 6) AS rouge1, round(avg(coalesce(r2_f.f, 0)), 6) AS rouge2, round(avg(2 * p * r / greatest(p + r, 1e-12)), 6) AS rouge_l
  FROM rl LEFT JOIN r1_f USING (id) LEFT JOIN r2_f USING (id)""")
def evl11(spark, d):
    return rounded(text_eval.summarization_scores(qa_rows(spark, d), "id", "context", "question"))


@query("evl12_str21_qa", rf"""WITH {QA}, s AS (SELECT id, question, answer, unnest(sl) AS s, generate_subscripts(sl, 1) AS i FROM (SELECT *, list_filter(list_transform(
    string_split(regexp_replace(context, '([.!?]){BLANK}+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS sl FROM qa)),
  h AS (SELECT *, len(list_intersect({sql_words('lower(s)')}, {sql_words('lower(question)')})) AS hits FROM s),
  b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, i) = 1),
  x AS (SELECT id, s AS pred, answer, {sql_words('lower(s)')} AS pw, {sql_words('lower(answer)')} AS rw FROM b), {sql_overlap('pw', 'rw', 1, 'r1', 'x')}
  SELECT round(avg((lower(trim(pred)) = lower(trim(answer)))::INT), 6) AS exact_match, round(avg(coalesce(f, 0)), 6) AS token_f1 FROM x LEFT JOIN r1_f USING (id)""")
def evl12(spark, d):
    return rounded(text_eval.qa_scores(qa_rows(spark, d), "id", "context", "question", "answer"))


def tagged_turns(spark, d):
    """Turns with BIO tags: runs of capitalised words are entities."""
    c = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    w = tx.words(F.col("text"))
    capital = F.transform(w, lambda x: F.rlike(x, F.lit("^[A-Z]")))
    tags = F.transform(capital, lambda c, i: F.when(~c, "O").when((i > 0) & F.get(capital, i - 1), "I-CAP").otherwise("B-CAP"))
    return c.withColumn("entities", F.array_join(tags, " "))


@query("evl09_set05_ner_lexicon", rf"""WITH t AS (SELECT conv_id, conv_id * 1000 + turn AS id, text, {sql_words('text')} AS w FROM conversations),
  x AS (SELECT conv_id, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t), c AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM x WHERE regexp_matches(w, '^[A-Z]')),
  e AS (SELECT conv_id, id, lower(string_agg(w, ' ' ORDER BY i)) AS surface FROM c GROUP BY conv_id, id, g),
  lex AS (SELECT DISTINCT surface FROM e WHERE conv_id % 4 <> 0), truth AS (SELECT DISTINCT id, surface FROM e WHERE conv_id % 4 = 0),
  pred AS (SELECT id, surface FROM t, lex WHERE conv_id % 4 = 0 AND contains(lower(text), surface)),
  s AS (SELECT (SELECT count(*) FROM pred JOIN truth USING (id, surface)) AS tp, (SELECT count(*) FROM pred) AS np, (SELECT count(*) FROM truth) AS nt)
  SELECT tp, round(tp / greatest(np, 1), 6) AS entity_precision, round(tp / greatest(nt, 1), 6) AS entity_recall, round(2.0 * tp / (np + nt), 6) AS entity_f1 FROM s""")
def evl09(spark, d):
    t = tagged_turns(spark, d)
    e = text_eval.parse_entities(F.col("text"), F.col("entities"))
    t = t.select("conv_id", "id", "text", e.alias("e"))
    return rounded(text_eval.ner_scores(t.filter("conv_id % 4 <> 0"), t.filter("conv_id % 4 = 0"), "id", "text", F.col("e")))


@query("src19_str23_entities", rf"""WITH t AS (SELECT conv_id * 1000 + turn AS id, text, {sql_words('text')} AS w FROM conversations),
  x AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t), c AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM x WHERE regexp_matches(w, '^[A-Z]')),
  e AS (SELECT id, min(i) AS i, lower(string_agg(w, ' ' ORDER BY i)) AS surface FROM c GROUP BY id, g)
  SELECT id, count(*) AS n, md5(string_agg(surface, '|' ORDER BY i)) AS digest FROM e GROUP BY id UNION ALL
  SELECT -id - 1, 1, md5(lower(substr(text, 3, 8))) FROM t""")
def src19(spark, d):
    t = tagged_turns(spark, d)
    spans = F.lit('[{"start": 2, "end": 10, "label": "S"}]')
    cells = t.select("id", "text", "entities").union(t.select(-F.col("id") - 1, "text", spans))
    e = cells.select("id", text_eval.parse_entities(F.col("text"), F.col("entities")).alias("e")).filter(F.size("e") > 0)
    return e.select("id", F.size("e").cast("long").alias("n"), F.md5(F.array_join(F.transform("e", lambda x: x["surface"]), "|")).alias("digest"))


@query("flt07_08_rows_and_labels", """SELECT count(*) AS n, 'quality,toxic' AS kept FROM documents JOIN labels USING (doc_id) WHERE trim(text) <> ''""")
def flt07(spark, d):
    t = docs(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("always", F.lit(1))
    kept = t.filter((F.trim("text") != "") & F.col("quality").isNotNull())
    cols = ["quality", "toxic", "always"]
    sums = kept.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in cols])
    varied = F.array(*[F.when((F.col(c) > 0) & (F.col(c) < F.col("n")), F.lit(c)) for c in cols])
    return sums.select("n", F.array_join(F.array_compact(varied), ",").alias("kept"))


@query("ftr15_multilabel_binarize", """SELECT doc_id, (lang = 'de')::INT AS label_de, (lang = 'en')::INT AS label_en, (source = 'web')::INT AS label_web FROM documents""")
def ftr15(spark, d):
    t = docs(spark, d).select("doc_id", F.concat_ws("|", "lang", "source").alias("labels"))
    from ..operators.labels import binarize

    return binarize(t, "labels", ["de", "en", "web"]).drop("labels")
