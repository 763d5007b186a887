"""Secret scans: wide candidates, narrowed by a random forest.

Candidates are words that hold a run of at least ``MIN_LENGTH`` key characters with a digit or a change of case, and every
word or value beside a secret name (within two words, or behind its equals sign or colon), whatever its length or
alphabet. Features:
length, shares of character classes, transitions between classes and from vowel to consonant, distinct characters,
dictionary coverage (letter runs that the corpus uses as words), the name before an equals sign or colon, the words around,
and how often the candidate's source has candidates with such a name.

Labelled findings come from rules that decide only the clear cases: a known key format or an assignment to a secret name
is real; addresses, card numbers, runs of words that are not assigned to a secret name and repeated characters are false.
The forest learns from at most ``MAX_ROWS`` different ones of each class and decides all candidates. Expressions and spark.ml only.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import cut_lineage
from .common import counted, words_of

MIN_LENGTH = 12
MAX_ROWS = 20_000
TREES, DEPTH, SEED = 40, 6, 7
BROADCAST_ROWS = 500_000
KEY_RUN = r"[A-Za-z0-9_+/=-]{12,}"
SECRET_NAME = r"(?i)(pass(word|wd)?|secret|token|api[_-]?key|access[_-]?key|auth|credential)"
#: Two words before: a name and a sign or verb that assigns; or one word before: a name with the sign.
ASSIGNS = r"(=|:|:=|=>|->|==|is|was|lautet|est|es)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your|xxxx)"
#: Public key formats (fixed values).
FORMATS = r"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}"
FEATURES = ("n", "digits", "uppers", "lowers", "hexes", "marks", "switches", "vowel_steps", "distinct", "dictionary", "named", "named_near", "placeholder", "address", "quoted", "path")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, word_index, word, near (two words on either side), name, value, wide, assigned (to a secret name)."""
    looks = lambda w: (F.length(w) >= MIN_LENGTH) & w.rlike(KEY_RUN) & (w.rlike("[0-9]") | w.rlike("[a-z][A-Z]"))
    beside = lambda i: F.array(i - 2, i - 1, i + 1, i + 2)

    def found(words: Column) -> Column:
        near = lambda i: F.transform(beside(i), lambda k: F.coalesce(F.get(words, k), F.lit("")))
        cell = lambda w, i: F.struct(i.alias("word_index"), w.alias("word"), near(i).alias("around"), looks(w).alias("wide"))

        def with_names(names: Column) -> Column:  # places of words that hold a secret name
            wanted = F.array_distinct(F.flatten(F.transform(names, lambda i: F.array(i - 2, i - 1, i, i + 1, i + 2))))
            named = F.filter(wanted, lambda i: (i >= 0) & (i < F.size(words)))
            every = F.array_union(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: looks(F.get(words, i))), named)
            return F.transform(every, lambda i: cell(F.get(words, i), i))

        places = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(SECRET_NAME), i)), lambda i: i.isNotNull())
        return F.when(F.size(words) > 0, let(places, with_names))

    rows = docs.select(F.col(key), F.col(source), F.explode(let(words_of(F.col(text)), found)).alias("_c")).select(key, source, "_c.*")
    assigned = F.regexp_extract("word", r"^[\"'({\[]*([A-Za-z][A-Za-z0-9_.-]*)[\"']?[=:]", 1)
    after = F.regexp_replace("word", r"^[\"'({\[]*[A-Za-z][A-Za-z0-9_.-]*[\"']?[=:]+", "")
    own = assigned.rlike(SECRET_NAME) & (after != "")
    bare = F.when((assigned != "") & ((F.length(after) >= 8) | own), after).otherwise(F.col("word"))
    value = F.when(F.col("named_value"), F.regexp_replace(bare, r"^[\"'({\[<]+|[\"')}\]>,;.]+$", "")).otherwise(F.regexp_replace(bare, r"^[^A-Za-z0-9]+|[^A-Za-z0-9=]+$", ""))
    before = F.col("around")[1]
    told = before.rlike(SECRET_NAME + r"\S*[=:]+[\"']?$") | (F.col("around")[0].rlike(SECRET_NAME) & before.rlike(f"(?i)^{ASSIGNS}$"))
    rows = rows.withColumn("name", assigned).withColumn("assigned", own | told).withColumn("named_value", F.col("assigned") & ~F.col("wide")).withColumn("value", value)
    rows = rows.withColumn("near", F.array_join("around", " ")).filter(F.when(F.col("wide"), F.length("value") >= 8).otherwise(F.col("value") != ""))
    return rows.drop("around", "named_value")


def _share(value: str, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{pattern}]", "")) / F.greatest(F.length(value), F.lit(1))


def with_features(found: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Adds the FEATURES."""
    found = cut_lineage(found)
    runs = F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda x: F.length(x) >= 3)
    asked = found.select(F.explode(runs).alias("run")).distinct()
    asked = F.broadcast(asked) if counted(asked, BROADCAST_ROWS) else asked
    spoken = docs.select(F.explode(F.array_distinct(F.transform(words_of(F.lower(text)), lambda w: F.regexp_replace(w, "[.,;:!?]+$", "")))).alias("run"))
    known = cut_lineage(spoken.join(asked, "run", "left_semi").groupBy("run").agg(F.count("*").alias("n")).filter("n >= 3").select("run"))
    covered = (
        found.select("value", F.explode(F.array_distinct(runs)).alias("run")).distinct().join(known, "run")
        .groupBy("value").agg(F.sum(F.length("run")).alias("letters"))
    )
    by_source = found.groupBy(source).agg(F.avg((F.col("name") != "").cast("double")).alias("path")).withColumnRenamed(source, "_source")
    switches = F.length(F.regexp_replace("value", r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])", "\u0001")) - F.length("value")
    vowels = F.length(F.regexp_replace("value", r"(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])", "\u0001")) - F.length("value")
    n = F.greatest(F.length("value"), F.lit(1))
    flag = lambda c: c.cast("double")
    columns = {
        "n": F.length("value").cast("double"),
        "digits": _share("value", "0-9"), "uppers": _share("value", "A-Z"), "lowers": _share("value", "a-z"),
        "hexes": _share("value", "0-9a-f"), "marks": _share("value", "_+/=@.-"),
        "switches": switches / n, "vowel_steps": vowels / n,
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "dictionary": F.least(F.lit(1.0), F.coalesce(F.col("letters"), F.lit(0)) / n),
        "named": flag(F.col("name").rlike(SECRET_NAME)), "named_near": flag(F.col("near").rlike(SECRET_NAME)),
        "placeholder": flag(F.concat_ws(" ", F.col("value"), F.regexp_replace("near", r"\S*[@/]\S*", "")).rlike(PLACEHOLDER)),
        "address": flag(F.col("value").rlike(r"@|://|^[0-9]+([.:-][0-9]+)*$")),
        "quoted": flag(F.col("word").rlike("^[\"']")),
        "path": F.coalesce(F.col("path"), F.lit(0.0)),
    }
    joined = found.join(covered, "value", "left").join(by_source, F.col(source).eqNullSafe(F.col("_source")), "left")
    return joined.withColumns(columns).drop("letters", "_source")


def labelled(found: DataFrame) -> DataFrame:
    """Adds label: 1 real, 0 false, NULL where the rules don't decide."""
    sure = F.col("wide") | F.col("assigned")  # a name nearby is no assignment
    real = F.col("value").rlike(f"^({FORMATS})$") | (sure & (F.col("named") + F.col("named_near") > 0) & (F.col("placeholder") == 0) & (F.col("digits") > 0.15) & (F.col("distinct") > 0.15) & (F.col("address") == 0))
    false = (F.col("address") == 1) | ((F.col("dictionary") > 0.6) & (F.col("wide") | ~F.col("assigned"))) | (F.col("placeholder") == 1) | (F.col("distinct") < 0.12)
    return found.withColumn("label", F.when(real, 1.0).when(false, 0.0))


def scan(docs: DataFrame, max_rows: int = MAX_ROWS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per candidate: key, word_index, value, near, name, label, score (probability of a secret), is_secret.

    NULL and empty texts have no candidates; a NULL source is a source; repeated rows give repeated findings. With labels of
    one class only, or none, the score is the rule's label, 0.5 where it is open. Other columns are not read.
    """
    found = cut_lineage(labelled(with_features(candidates(docs, key, text, source), docs, key, text, source)))
    each = found.filter("label is not null").groupBy("value", "near", "label").agg(F.min(F.struct(*FEATURES)).alias("_f")).select("value", "near", "label", "_f.*")
    each = cut_lineage(each)
    picked = [each.filter(F.col("label") == y).orderBy(F.xxhash64("value", "near"), "value", "near").limit(max_rows) for y in (0.0, 1.0)]
    known = cut_lineage(picked[0].unionByName(picked[1]))
    classes = [r["label"] for r in known.select("label").distinct().collect()]
    keep = [key, "word_index", "value", "near", "name", "label"]
    if len(classes) < 2:
        scored = found.select(*keep, F.coalesce("label", F.lit(0.5)).alias("score"))
    else:
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(known)
        scored = model.transform(found).select(*keep, vector_to_array("probability")[1].alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= 0.5)
