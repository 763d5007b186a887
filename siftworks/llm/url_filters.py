"""URL filters whose lists change over time.

List entries are dated: from that day on a pattern is listed or no longer listed. Sorted by day, the entries of a pattern
become validity intervals that do not overlap, so the as-of join of a capture is an equi-join on the pattern with the
fetch day inside the interval. A capture asks for its host, every parent domain, and its host with every path prefix that
is no longer than the longest path of the entries. Patterns of one host with very many captures are rows of a plain join, which the engine splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
#: Path segments that a pattern of the derived list has after its host at most.
SEGMENTS = 2


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 2))


def patterns_of(url: Column, segments: int = SEGMENTS) -> Column:
    """Host, parent domains of two labels or more, and host with up to ``segments`` path segments. None without a host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(segments))), lambda i: F.when((i > 0) & (i <= F.size(parts)), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.array_compact(paths))))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, valid_from, valid_to (NULL: still valid) of entries pattern, dated, listed. Of several entries of a pattern
    on one day, delisting wins; entries without a pattern or day are void."""
    daily = entries.filter("pattern is not null and dated is not null").groupBy("pattern", "dated").agg(F.min(F.coalesce("listed", F.lit(False))).alias("listed"))
    order = Window.partitionBy("pattern").orderBy("dated")
    spans = daily.withColumn("valid_to", F.lead("dated").over(order))
    return spans.filter("listed").select("pattern", F.col("dated").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """One row per capture: key, url, fetched, n_matches, pattern (the longest that matches), blocked.

    NULL or malformed URLs and captures without a day match nothing and are kept. Captures that repeat in key, URL and day
    are one. Ties of pattern length go to the smaller one. Other columns are not read.
    """
    spans = cut_lineage(intervals(entries)).select(F.col("pattern").alias("_p"), "valid_from", "valid_to")
    longest = spans.agg(F.max(F.length("_p") - F.length(F.replace("_p", F.lit("/"), F.lit(""))))).first()[0] or 0
    asked = captures.select(key, url, fetched, F.explode_outer(patterns_of(F.col(url), longest)).alias("_q"))
    active = (F.col("_q") == F.col("_p")) & (F.col(fetched) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(fetched) < F.col("valid_to")))
    met = asked.join(spans, active, "left")
    best = F.min(F.when(F.col("_p").isNotNull(), F.struct((-F.length("_p")).alias("n"), F.col("_p").alias("p"))))
    out = met.groupBy(key, url, fetched).agg(F.count_distinct("_p").alias("n_matches"), best.alias("_b"))
    return out.select(key, url, fetched, "n_matches", F.col("_b.p").alias("pattern"), (F.col("n_matches") > 0).alias("blocked"))


# The tables have no list and no fetch days, so both are derived from them.
def _digits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def dated_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.coalesce("page_id", F.lit(0)) * 37, F.lit(730))).cast("int")).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Every third pattern of the pages is listed on one day, every second of these delisted 30 to 229 days later and
    every fourth listed again 100 days after that."""
    patterns = pages.select(F.explode(patterns_of(F.col("url"))).alias("pattern")).distinct().withColumn("h", _digits(F.col("pattern")))
    first = F.date_add(F.lit("2024-01-01").cast("date"), F.col("h") % 600)
    gone = F.date_add(first, 30 + F.floor(F.col("h") / 600).cast("int") % 200)
    steps = F.array(
        F.struct(first.alias("dated"), F.lit(True).alias("listed"), F.lit(True).alias("real")),
        F.struct(gone.alias("dated"), F.lit(False).alias("listed"), (F.col("h") % 2 == 0).alias("real")),
        F.struct(F.date_add(gone, 100).alias("dated"), F.lit(True).alias("listed"), (F.col("h") % 4 == 0).alias("real")),
    )
    listed = patterns.filter("h % 3 = 0").select("pattern", F.explode(F.filter(steps, lambda x: x["real"])).alias("_e"))
    return listed.select("pattern", "_e.dated", "_e.listed")


SQL = r"""
WITH hosts AS (
  SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2)) AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts,
         CAST(DATE '2024-01-01' + CAST(((coalesce(page_id, 0) * 37) % 730) AS INTEGER) AS DATE) AS fetched
  FROM pages),
labelled AS (SELECT *, string_split(host, '.') AS labels FROM hosts),
asked AS (
  SELECT DISTINCT page_id, url, fetched, q FROM (
    SELECT page_id, url, fetched, unnest(list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(labels[i:], '.'))) AS q FROM labelled WHERE host <> ''
    UNION ALL
    SELECT page_id, url, fetched, unnest(list_transform(range(1, least(len(parts), 2) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/'))) AS q FROM labelled WHERE host <> '')),
patterns AS (SELECT DISTINCT q AS pattern, CAST('0x' || substr(md5(q), 1, 6) AS INTEGER) AS h FROM asked),
firsts AS (SELECT pattern, h, CAST(DATE '2024-01-01' + CAST(h % 600 AS INTEGER) AS DATE) AS d1 FROM patterns WHERE h % 3 = 0),
seconds AS (SELECT *, CAST(d1 + CAST(30 + (h // 600) % 200 AS INTEGER) AS DATE) AS d2 FROM firsts),
entries AS (
  SELECT pattern, d1 AS dated, TRUE AS listed FROM seconds
  UNION ALL SELECT pattern, d2, FALSE FROM seconds WHERE h % 2 = 0
  UNION ALL SELECT pattern, CAST(d2 + 100 AS DATE), TRUE FROM seconds WHERE h % 4 = 0),
spans AS (SELECT pattern, listed, dated AS valid_from, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS valid_to FROM entries),
met AS (
  SELECT a.page_id, a.url, a.fetched, s.pattern FROM asked a JOIN spans s
  ON a.q = s.pattern AND s.listed AND a.fetched >= s.valid_from AND (s.valid_to IS NULL OR a.fetched < s.valid_to))
SELECT h.page_id, h.url, h.fetched, count(DISTINCT m.pattern) AS n_matches,
       (list(m.pattern ORDER BY length(m.pattern) DESC, m.pattern) FILTER (WHERE m.pattern IS NOT NULL))[1] AS pattern,
       count(DISTINCT m.pattern) > 0 AS blocked
FROM (SELECT DISTINCT page_id, url, fetched FROM hosts) h
LEFT JOIN met m ON h.page_id IS NOT DISTINCT FROM m.page_id AND h.url IS NOT DISTINCT FROM m.url AND h.fetched = m.fetched
GROUP BY 1, 2, 3
"""
