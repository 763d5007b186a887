"""Names of emoji are looked up in Python, texts stay outside."""

import re
import unicodedata

from pyspark.sql import functions as F

from siftworks.functions import text as tx

NOISE = ("symbol", "sign", "selector", "variation")


def described(text):
    def words(m):
        kept = [w for w in re.findall("[a-z0-9]+", unicodedata.name(m.group(0), "").lower()) if w not in NOISE]
        return f" {' '.join(kept) or 'emoji'} "

    return None if text is None else re.sub("[☀-➿︀-﻿\U00010000-\U0010ffff]", words, text)


def test_python_sees_the_emoji_only(spark):
    texts = ["", "plain 1 * [x]", None, "\U0001F600a\U0001F601\U0001F600", "☀️ sun ✔", "\U000F0000 unnamed", "a\U0001F468‍\U0001F469b", "xﷺ﻿￿"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = df.select("id", tx.handle_emoji(F.col("t"), "describe").alias("d"))
    assert {r["id"]: r["d"] for r in out.collect()} == {i: described(t) for i, t in enumerate(texts)}
    calls = re.findall(r"_emoji_words\((.{0,60})", out._jdf.queryExecution().optimizedPlan().toString())
    assert calls and all(c.startswith("array_join(array_distinct(regexp_extract_all(") for c in calls)
