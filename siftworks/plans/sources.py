"""Record, corpus, annotation and manifest queries. Inputs are documents and files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import columns
from ..session import shared_folder, spread, table
from ..sources import annotations as an
from ..sources import corpora, manifests, records, splits
from .registry import query, rounded


@query("src01_csv", """SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, count(DISTINCT c_mktsegment) AS segments, 'bigint,string,int,double,string' AS types FROM customer""")
def src01(spark, d):
    path = shared_folder(spark, "customers")
    table(spark, d, "customer").write.option("header", True).csv(path)
    df = records.read_csv(spark, path)
    kinds = ",".join(dict(table(spark, d, "customer").dtypes)[c] for c in df.columns)
    return rounded(df.agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"), F.count_distinct("c_mktsegment").alias("segments")), digits=2).withColumn("types", F.lit(kinds))


@query("src01_split_csv", "SELECT doc_id, md5(text) AS digest, length(text) AS chars, source FROM documents")
def src01_split(spark, d):
    """Whole texts with their line breaks through CSV and back."""
    t, path = table(spark, d, "documents").select("doc_id", "text", "source"), shared_folder(spark, "split-csv")
    t.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = splits.read_split_csv(spark, path, schema=t.schema)
    return df.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"), "source")


#: Rows of one list in the files of ``src02_split_json``.
LIST_ROWS = 1000


@query("src02_split_json", "SELECT doc_id, md5(text) AS digest, source FROM documents")
def src02_split(spark, d):
    """Whole texts as lists of objects, each file one line, cut into objects again."""
    t, path = table(spark, d, "documents").select("doc_id", "text", "source"), shared_folder(spark, "split-json")
    lists = t.withColumn("list", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, t.count() // LIST_ROWS))))
    lists = lists.groupBy("list").agg(F.to_json(F.collect_list(F.struct("doc_id", "text", "source"))).alias("value"))
    lists.write.partitionBy("list").text(path)
    field = {c: F.variant_get("rec", f"$.{c}", k).alias(c) for c, k in t.dtypes}
    return splits.read_split_json(spark, path).select(field["doc_id"], F.md5(F.variant_get("rec", "$.text", "string")).alias("digest"), field["source"])


def line_documents(spark, d):
    """One JSON document per line item: a header and a list of two records."""
    li = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_orderkey")

    def record(no, qty):
        return F.struct(no.alias("no"), qty.alias("qty"), F.struct(F.col("l_returnflag").alias("flag")).alias("state"))

    lines = F.array(record(F.col("l_linenumber"), F.col("l_quantity")), record(F.col("l_linenumber") + 100, F.col("l_quantity") * 2))
    return li.select(F.to_json(F.struct(F.struct("l_orderkey").alias("head"), F.struct(lines.alias("lines")).alias("body"))).alias("doc"))


@query("src02_07_json_records", """SELECT l_returnflag AS flag, count(*) * 2 AS n, round(sum(l_quantity) * 3, 4) AS qty FROM lineitem GROUP BY 1""")
def src02(spark, d):
    rec = records.json_records(line_documents(spark, d), "doc", "body.lines")
    out = rec.select(F.variant_get("rec", "$.state.flag", "string").alias("flag"), F.variant_get("rec", "$.qty", "double").alias("qty"))
    return rounded(out.groupBy("flag").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")), digits=4)


@query("src02_json_detected_records", """SELECT l_linenumber::BIGINT AS no, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_linenumber::BIGINT + 100, count(*) FROM lineitem GROUP BY 1""")
def src02_detected(spark, d):
    rec = records.structured(records.json_records(line_documents(spark, d), "doc"))
    return rec.groupBy("no").agg(F.count("*").alias("n"))


@query("src03_json_lines", """SELECT count(*) AS total, count(*) FILTER (event_id % 10 = 0) AS invalid, count(*) FILTER (event_id % 10 <> 0) AS records,
  sum(json_extract(props, '$.k')::BIGINT) FILTER (event_id % 10 <> 0)::BIGINT AS k FROM events""")
def src03(spark, d):
    e = table(spark, d, "events")
    lines = e.select(F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit(" oops"))).otherwise(F.col("props")).alias("value"))
    rec, report = records.json_lines(lines.union(e.select(F.lit("  "))))
    return rec.agg(F.lit(report.total).alias("total"), F.lit(report.invalid).alias("invalid"), F.count("*").alias("records"),
                   F.sum(F.variant_get("rec", "$.k", "bigint")).alias("k"))


def nested_orders(spark, d):
    """Nested rows: struct, scalar array longer than the join limit for some orders, object array."""
    o = table(spark, d, "orders")
    tags = F.sequence(F.lit(1), (F.col("o_orderkey") % 20 + 1).cast("int"))
    return o.select("o_orderkey", F.struct(
        F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("name")).alias("prio"), tags.alias("tags"),
        F.array(F.struct(F.col("o_custkey").alias("cust"))).alias("parties")).alias("o"))


@query("src09_flatten", """SELECT o_orderkey, o_orderstatus AS "o.status", o_orderpriority AS "o.prio.name",
  array_to_string(range(1, least(k, 16) + 1), '|') || CASE WHEN k > 16 THEN '|...(+' || (k - 16) || ')' ELSE '' END AS "o.tags", k::INT AS "o.tags.count",
  '[{"cust":' || o_custkey || '}]' AS "o.parties", 1 AS "o.parties.count" FROM (SELECT *, o_orderkey % 20 + 1 AS k FROM orders)""")
def src09(spark, d):
    return records.flatten(nested_orders(spark, d))


@query("src10_flatten_text", """SELECT o_orderkey, o_orderstatus AS "o.status", o_orderpriority AS "o.prio.name",
  '[' || array_to_string(range(1, k + 1), ',') || ']' AS "o.tags", '[{"cust":' || o_custkey || '}]' AS "o.parties" FROM (SELECT *, o_orderkey % 20 + 1 AS k FROM orders)""")
def src10(spark, d):
    return records.flatten(nested_orders(spark, d), arrays="json")


@query("src11_flatten_manifest", """SELECT o_orderkey, o_orderstatus AS "o.status", o_orderstatus AS status, o_orderpriority AS name, '{"name":"' || o_orderpriority || '"}' AS "o.prio" FROM orders""")
def src11(spark, d):
    out = records.flatten(nested_orders(spark, d), arrays="json", keep_parents=True, leaf_alias=True)
    return out.select("o_orderkey", "`o.status`", "status", "name", "`o.prio`")


@query("src12_coerce_types", """SELECT 'boolean' AS flag, 'double' AS amount, 'string' AS mixed, sum(l_quantity) AS total, count(*) FILTER (l_linenumber = 1) AS n_true FROM lineitem""")
def src12(spark, d):
    t = table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, " Yes").otherwise("n").alias("flag"), F.col("l_quantity").cast("string").alias("amount"),
        F.when(F.col("l_linenumber") == 1, "x").otherwise("1").alias("mixed"))
    out = columns.coerce_types(t)
    kinds = dict(out.dtypes)
    return out.agg(F.sum("amount").alias("total"), F.count_if("flag").alias("n_true")).select(
        *[F.lit(kinds[c]).alias(c) for c in ("flag", "amount", "mixed")], "total", "n_true")


@query("src13_structure_profile", """SELECT count(*) AS record_count, 4::INT AS max_nesting_depth, round((count(*) FILTER (doc_id % 5 = 0) * 2 + count(*) FILTER (doc_id % 5 <> 0) * 4) / count(*), 6) AS average_nesting_depth,
  2 AS schema_variant_count, 4 AS unique_field_paths, 1 AS array_field_count, 2 AS object_field_count, 3 AS scalar_field_count, 1 AS type_inconsistency_count FROM documents""")
def src13(spark, d):
    t = table(spark, d, "documents")
    plain = F.to_json(F.struct(F.col("doc_id").alias("id")))
    rich = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(
        F.struct(F.col("lang").alias("code")).alias("lang"), F.array("source", "lang").alias("tags")).alias("meta")))
    return rounded(records.structure_profile(t.select(F.when(F.col("doc_id") % 5 == 0, plain).otherwise(rich).alias("j")), "j"))


def document_files(spark, d):
    """Documents as encoded files: BOM and carriage returns for every other one, a folder per source."""
    t = table(spark, d, "documents")
    marked = F.concat(F.lit("﻿"), F.regexp_replace("text", "\n", "\r\n"))
    body = F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.col("text"))
    name = F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 3 == 0, "Doc").otherwise("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return t.select("doc_id", "lang", name.alias("path"), F.encode(body, "UTF-8").alias("content"))


@query("src15_plain_corpus", """SELECT source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'Doc' ELSE 'doc' END || doc_id || '.txt' AS document_id, md5(text) AS digest FROM documents WHERE trim(text) <> ''""")
def src15(spark, d):
    return corpora.plain_corpus(document_files(spark, d)).select("document_id", F.md5("text").alias("digest"))


@query("src16_class_folders", "SELECT source AS label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE trim(text) <> '' GROUP BY 1")
def src16(spark, d):
    return corpora.class_folder_corpus(document_files(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src17_join01_metadata_join", """SELECT doc_id AS id, lang, source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'Doc' ELSE 'doc' END || doc_id || '.txt' AS document_path, md5(text) AS digest
  FROM documents WHERE doc_id % 7 <> 3 AND NOT (doc_id % 7 = 4 AND doc_id % 3 = 0)""")
def src17(spark, d):
    files = document_files(spark, d)
    k = F.col("doc_id") % 7
    name = F.substring_index("path", "/", -1)
    asked = (
        F.when(k == 0, F.col("path")).when(k == 1, F.concat(F.lit("./"), F.col("path"))).when(k == 2, name)
        .when(k == 3, F.concat(F.lit("../"), F.col("path"))).when(k == 4, F.upper(name)).otherwise(F.concat(F.lit("elsewhere/"), name)))
    asked = F.when(k == 4, F.regexp_replace(name, "^doc", "DOC")).otherwise(asked)
    meta = files.select(F.col("doc_id").alias("id"), "lang", asked.alias("file"))
    meta = meta.filter("NOT (id % 7 = 4 AND id % 3 = 0)")
    out = corpora.corpus_with_metadata(meta, "id", files.select("path", "content"))
    return out.select("id", "lang", "document_path", F.md5("text").alias("digest"))


@query("src18_conll", r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda w: w <> '' AND w[1] <> '#') AS w FROM conversations)
  SELECT 'c' || id || '.conll#s0' AS document_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest, CASE WHEN len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) > 0 OR true THEN 'ner' END AS kind FROM t WHERE len(w) > 0""")
def src18(spark, d):
    c = table(spark, d, "conversations")
    w = F.filter(tx.words(F.col("text")), lambda x: ~x.startswith("#"))
    lines = F.transform(w, lambda x: F.concat(x, F.lit("\tX\t"), F.when(F.rlike(x, F.lit("^[A-Z]")), "B-CAP").otherwise("O")))
    body = F.concat(F.lit("# turn\n"), F.array_join(lines, "\n"), F.lit("\n\n"))
    files = c.select(F.concat(F.lit("c"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string"), F.lit(".conll")).alias("path"), body.alias("value"))
    s = corpora.conll_sentences(files)
    return s.select("document_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5("text").alias("digest"), "kind")


@query("src19_bio_spans", r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda w: w <> '') AS w FROM conversations),
  x AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t), p AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY id ORDER BY i) - length(w) - 1 AS s FROM x),
  c AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM p WHERE regexp_matches(w, '^[A-Z]')),
  e AS (SELECT id, min(s) AS s, max(s + length(w)) AS e FROM c GROUP BY id, g)
  SELECT id, count(*) AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM e GROUP BY id""")
def src19(spark, d):
    from .text import tagged_turns

    t = tagged_turns(spark, d).select("id", corpora.bio_spans(tx.words(F.col("text")), tx.words(F.col("entities"))).alias("e"))
    return t.select("id", F.explode("e").alias("e")).groupBy("id").agg(
        F.count("*").alias("n"), F.sum("e.start").alias("starts"), F.sum("e.end").alias("ends"))


@query("src27_transcripts", r"""SELECT 'a/c' || conv_id || '_' || turn || '.wav' AS path, md5(trim(regexp_replace(text, '\s*\n\s*', ' ', 'g'))) AS digest FROM conversations""")
def src27(spark, d):
    c = table(spark, d, "conversations")
    name = F.concat(F.lit("a/c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    body = F.concat(F.lit("WEBVTT\n\n1\n00:00:00.000 --> 00:00:04.000\n"), F.col("text"), F.lit("\n\n2\n00:00:05.000 --> 00:00:06.000\n"))
    side = c.select(F.concat(name, F.lit("_transcript.vtt")).alias("path"), body.alias("value"))
    media = c.select(F.concat(name, F.lit(".wav")).alias("path"))
    return corpora.transcripts_by_media(media, side).select("path", F.md5("transcript").alias("digest"))


@query("flt09_safe_paths", r"""SELECT CASE WHEN page_id % 4 = 1 THEN NULL WHEN page_id % 4 = 3 THEN NULL ELSE 'x/' || page_id || '.html' END AS safe, count(*) AS n FROM pages GROUP BY 1""")
def flt09(spark, d):
    k, name = F.col("page_id") % 4, F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    raw = F.when(k == 0, F.concat(F.lit(" ./x//"), name)).when(k == 1, F.concat(F.lit("/x/"), name)).when(
        k == 2, F.concat(F.lit("x\\"), name)).otherwise(F.concat(F.lit("x/../"), name))
    return table(spark, d, "pages").select(corpora.safe_relative_path(raw).alias("safe")).groupBy("safe").agg(F.count("*").alias("n"))


def coco_tables(spark, d):
    """Orders as images, lines as annotations (some boxes empty or past the border, some classes unknown)."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    images = o.select(F.col("o_orderkey").alias("id"), (F.lit(200) + F.col("o_custkey") % 100).cast("int").alias("width"), F.lit(150).alias("height"),
                      F.when(F.col("o_orderstatus") == "F", "train").otherwise("").alias("split"))
    ann = li.select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id"), (F.col("l_partkey") % 6).alias("category_id"),
        F.array(F.col("l_quantity") * 5, F.col("l_discount") * 1000, F.col("l_tax") * 1000, F.col("l_quantity")).alias("bbox"))
    cats = spark.range(5).select("id", F.concat(F.lit("class"), F.col("id").cast("string")).alias("name"))
    return images, ann, cats


COCO = """im AS (SELECT o_orderkey AS image_id, 200 + o_custkey % 100 AS w, 150 AS h, o_orderstatus FROM orders),
  bx AS (SELECT l_orderkey AS image_id, l_linenumber * 1000000 + l_partkey AS box_index, l_partkey % 6 AS cat, w, h, l_quantity * 5 AS x, l_discount * 1000 AS y, l_tax * 1000 AS bw, l_quantity AS bh FROM lineitem JOIN im ON l_orderkey = image_id),
  cl AS (SELECT *, greatest(0, least(w, x)) AS x1, greatest(0, least(h, y)) AS y1, greatest(0, least(w, x + bw)) AS x2, greatest(0, least(h, y + bh)) AS y2 FROM bx),
  st AS (SELECT *, CASE WHEN cat > 4 THEN NULL ELSE 'class' || cat END AS class_name, CASE WHEN cat > 4 THEN 'unmapped_class' WHEN x2 <= x1 OR y2 <= y1 THEN 'invalid_box' ELSE 'ok' END AS status FROM cl)"""


@query("src21_join02_flt10_coco", f"WITH {COCO} SELECT image_id, box_index, class_name, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2, status FROM st")
def src21(spark, d):
    return rounded(an.coco_boxes(*coco_tables(spark, d)), "x1", "y1", "x2", "y2", digits=4)


@query("ipr02_annotation_profile", f"""WITH {COCO}, per AS (SELECT im.image_id, w, h, count(st.image_id) FILTER (status = 'ok') AS n FROM im LEFT JOIN st USING (image_id) GROUP BY ALL)
  SELECT count(*) AS image_count, sum(n)::BIGINT AS bbox_count, count(*) FILTER (n = 0) AS images_without_annotations, min(w)::INT AS min_width, max(w)::INT AS max_width, min(h)::INT AS min_height, max(h)::INT AS max_height,
  round(min(w / h), 6) AS min_aspect, round(max(w / h), 6) AS max_aspect, round(avg(w / h), 6) AS mean_aspect, (SELECT count(*) FROM st WHERE status = 'invalid_box') AS invalid_bbox_count,
  (SELECT count(*) FROM st WHERE status = 'unmapped_class') AS unmapped_class_count, round(sum(n) / count(*), 6) AS average_boxes_per_image
  FROM (SELECT image_id, any_value(im.w) AS w, any_value(im.h) AS h, count(*) FILTER (status = 'ok') AS n FROM im LEFT JOIN st USING (image_id) GROUP BY image_id)""".replace(
    ", per AS (SELECT im.image_id, w, h, count(st.image_id) FILTER (status = 'ok') AS n FROM im LEFT JOIN st USING (image_id) GROUP BY ALL)", ""))
def ipr02(spark, d):
    images, ann, cats = coco_tables(spark, d)
    return rounded(an.annotation_profile(images.withColumnRenamed("id", "image_id"), an.coco_boxes(images, ann, cats)))


@query("ipr02_class_distribution", f"WITH {COCO} SELECT class_name, count(*) AS n FROM st WHERE status = 'ok' GROUP BY 1")
def ipr02_classes(spark, d):
    return an.class_distribution(an.coco_boxes(*coco_tables(spark, d)))


@query("ipr02_split_summary", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'default' END AS split, count(*) AS n FROM orders GROUP BY 1")
def ipr02_splits(spark, d):
    return an.split_summary(coco_tables(spark, d)[0])


@query("ipr03_majority_class", f"""WITH {COCO}, c AS (SELECT image_id, class_name, count(*) AS n, min(box_index) AS f FROM st WHERE status = 'ok' GROUP BY ALL),
  m AS (SELECT image_id, sum(n)::BIGINT AS n_boxes, first(class_name ORDER BY n DESC, f) AS label FROM c GROUP BY image_id)
  SELECT im.image_id, coalesce(n_boxes, 0) AS n_boxes, label FROM im LEFT JOIN m USING (image_id)""")
def ipr03(spark, d):
    images, ann, cats = coco_tables(spark, d)
    return an.image_summary(images.select(F.col("id").alias("image_id")), an.coco_boxes(images, ann, cats))


@query("src24_join03_yolo", """WITH im AS (SELECT o_orderkey AS k, 100 + o_custkey % 50 AS w, 80 AS h FROM orders WHERE o_orderstatus <> 'P'),
  b AS (SELECT 'img' || l_orderkey AS image_id, l_linenumber * 100000 + l_partkey AS box_index, l_partkey % 4 AS cls, l_discount * 10 AS cx, l_tax * 10 AS cy, l_quantity / 45 AS bw, 0.25 AS bh, w, h FROM lineitem JOIN im ON k = l_orderkey),
  s AS (SELECT *, CASE WHEN bw > 1 OR cx > 1 OR cy > 1 THEN 'invalid_box' WHEN cls > 2 THEN 'unmapped_class' ELSE 'ok' END AS status FROM b)
  SELECT status, CASE WHEN cls > 2 THEN NULL ELSE 'c' || cls END AS class_name, count(*) AS n, round(sum((cx - bw / 2) * w), 3) AS x1, round(sum((cy + bh / 2) * h), 3) AS y2 FROM s GROUP BY ALL""")
def src24(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    line = F.concat_ws(" ", (F.col("l_partkey") % 4).cast("string"), (F.col("l_discount") * 10).cast("string"), (F.col("l_tax") * 10).cast("string"), (F.col("l_quantity") / 45).cast("string"), F.lit("0.25"))
    lines = li.select(F.concat(F.lit("labels/IMG"), F.col("l_orderkey").cast("string"), F.lit(".txt")).alias("path"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("line_index"), line.alias("value"))
    images = o.select(F.concat(F.lit("images/img"), F.col("o_orderkey").cast("string"), F.lit(".PNG")).alias("path"), (F.lit(100) + F.col("o_custkey") % 50).alias("width"), F.lit(80).alias("height"))
    classes = spark.range(3).select("id", F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"))
    b = an.yolo_boxes(lines, images, classes)
    return rounded(b.groupBy("status", "class_name").agg(F.count("*").alias("n"), F.sum("x1").alias("x1"), F.sum("y2").alias("y2")), digits=3)


@query("join03_unmatched_stems", """SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)) AS missing,
  (SELECT count(*) FROM customer WHERE c_nationkey < 5 AND c_custkey NOT IN (SELECT l_suppkey FROM lineitem)) AS unused""")
def join03(spark, d):
    images = table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("image_id"))
    labels = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image_id"))
    return an.matched(images, labels)


@query("join04_sidecars", """SELECT 'd' || (o_custkey % 10) || '/i' || o_orderkey || '.png' AS path, o_orderkey % 2 = 0 AS has_keypoints, o_orderkey % 3 = 0 AS has_masks, o_orderkey % 5 = 0 AS has_depth, o_orderkey % 7 = 0 AS has_boxes FROM orders""")
def join04(spark, d):
    o = table(spark, d, "orders")
    base = F.concat(F.lit("d"), (F.col("o_custkey") % 10).cast("string"), F.lit("/i"), F.col("o_orderkey").cast("string"))
    k = F.col("o_orderkey")
    names = F.array_compact(F.array(
        F.concat(base, F.lit(".png")), F.when(k % 2 == 0, F.concat(base, F.lit("_pose.json"))), F.when(k % 3 == 0, F.concat(base, F.lit("_mask1.npy"))),
        F.when(k % 5 == 0, F.concat(base, F.lit("_depth.npy"))), F.when(k % 7 == 0, F.concat(base, F.lit(".xml")))))
    return an.sidecar_flags(o.select(F.explode(names).alias("path")))


def audio_manifest(spark, d):
    """Events as manifest rows of three kinds, with broken segments, duplicates and files that do not exist."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    f = F.concat(F.lit("clips/"), (k % 4000).cast("string"), F.lit(".wav"))
    single = k % 4 < 2
    rows = e.select(
        k.alias("row_id"), F.when(single, f).otherwise("").alias("Audio_File"), F.col("event_type").alias("class"),
        F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("spk"), F.when(k % 5 == 0, F.col("props")).alias("text"),
        F.when(k % 4 == 2, f).otherwise("").alias("noisy"), F.when(k % 4 == 2, F.concat(F.lit("CLIPS/"), (k % 3999).cast("string"), F.lit(".WAV"))).otherwise("").alias("clean"),
        F.when(k % 4 == 3, f).alias("file_a"), F.when(k % 4 == 3, F.concat((k % 100).cast("string"), F.lit(".wav"))).alias("file_b"),
        F.when(k % 8 == 3, "Same").when(k % 8 == 7, "0").alias("same"),
        F.when(k % 3 == 0, (k % 10 - 1).cast("string")).alias("onset"), F.when(k % 3 == 0, "6.5").alias("offset"), F.lit("8").alias("length"), F.lit("").alias("subset"))
    rows = rows.withColumn("offset", F.when(k_of() % 6 == 0, F.lit("9.25")).otherwise(F.col("offset")))
    files = e.select((F.col("event_id") % 3600).alias("n")).distinct().select(F.concat(F.lit("clips/"), F.col("n").cast("string"), F.lit(".wav")).alias("path"))
    return manifests.canonical(rows, ["row_id"]), files


def k_of():
    return F.col("row_id")


MANIFEST = """e AS (SELECT event_id AS k, event_id % 4000 AS f, event_id % 3999 AS c, event_id % 100 AS b, event_type, user_id FROM events), fl AS (SELECT DISTINCT event_id % 3600 AS n FROM events),
  r AS (SELECT *, CASE WHEN k % 4 < 2 THEN 'single' WHEN k % 4 = 2 THEN 'noise_pair' ELSE 'speaker_pair' END AS kd, f IN (SELECT n FROM fl) AS hf, c IN (SELECT n FROM fl) AS hc, b IN (SELECT n FROM fl) AS hb FROM e),
  u AS (SELECT *, CASE kd WHEN 'single' THEN hf WHEN 'noise_pair' THEN hf AND hc ELSE hf AND hb END AS ok FROM r),
  s AS (SELECT * FROM u WHERE ok QUALIFY row_number() OVER (PARTITION BY kd, f, CASE kd WHEN 'noise_pair' THEN c WHEN 'speaker_pair' THEN b END ORDER BY k) = 1),
  g AS (SELECT *, CASE WHEN k % 3 = 0 THEN (k % 10 - 1)::DOUBLE END AS st, CASE WHEN k % 6 = 0 THEN 9.25 WHEN k % 3 = 0 THEN 6.5 END AS en FROM s),
  q AS (SELECT *, st IS NOT NULL AND en IS NOT NULL AND (st < 0 OR en <= st) AS wrong, st IS NOT NULL AND en > 8.001 AND st >= 0 AND en > st AS over FROM g),
  z AS (SELECT *, CASE WHEN wrong OR (over AND st >= 8) THEN NULL ELSE st END AS s2, CASE WHEN wrong OR (over AND st >= 8) THEN NULL WHEN over THEN 8 ELSE en END AS e2 FROM q)"""


@query("src28_join05_set03_manifest", f"""WITH {MANIFEST} SELECT (SELECT count(*) FROM u) AS record_count, (SELECT sum(CASE WHEN ok THEN 0 WHEN kd = 'single' THEN 1 WHEN kd = 'noise_pair' THEN (NOT hf)::INT + (NOT hc)::INT ELSE (NOT hf)::INT + (NOT hb)::INT END)::BIGINT FROM u) AS missing_count,
  (SELECT count(*) FROM u WHERE kd <> 'single' AND NOT ok) AS invalid_pair_count, (SELECT count(*) FROM s) AS sample_count, (SELECT count(*) FROM q WHERE wrong OR over) AS invalid_segment_count,
  (SELECT count(*) FROM fl WHERE n NOT IN (SELECT f FROM s UNION SELECT c FROM s WHERE kd = 'noise_pair' UNION SELECT b FROM s WHERE kd = 'speaker_pair')) AS unused_count,
  (SELECT count(*) FROM u WHERE ok) - (SELECT count(*) FROM s) AS duplicate_count""")
def src28(spark, d):
    m, files = audio_manifest(spark, d)
    return manifests.manifest_report(*manifests.settled(m, "row_id", files), files)


@query("flt11_segments", f"WITH {MANIFEST} SELECT k AS row_id, s2::DOUBLE AS start, e2::DOUBLE AS \"end\", coalesce(wrong OR over, false) AS invalid_segment FROM z")
def flt11(spark, d):
    m, files = audio_manifest(spark, d)
    return manifests.samples(manifests.resolved_records(m, "row_id", files), "row_id").select("row_id", "start", "end", "invalid_segment")


@query("apr03_reference_profile", f"""WITH {MANIFEST} SELECT 'label' AS section, event_type AS name, count(*) AS n FROM z GROUP BY ALL UNION ALL SELECT 'speaker', 's' || (user_id % 7), count(*) FROM z GROUP BY ALL
  UNION ALL SELECT 'split', 'default', count(*) FROM z UNION ALL SELECT 'count', 'transcripts', count(*) FROM z WHERE k % 5 = 0 UNION ALL SELECT 'count', 'segments', count(*) FROM z WHERE s2 IS NOT NULL
  UNION ALL SELECT 'count', 'noise_pairs', count(*) FROM z WHERE kd = 'noise_pair' UNION ALL SELECT 'count', 'speaker_pairs', count(*) FROM z WHERE kd = 'speaker_pair'""")
def apr03(spark, d):
    m, files = audio_manifest(spark, d)
    return manifests.reference_profile(manifests.samples(manifests.resolved_records(m, "row_id", files), "row_id"))


@query("flt17_presence_flags", f"""WITH {MANIFEST} SELECT true AS has_labels, true AS has_speakers, bool_or(k % 5 = 0) AS has_transcripts, false AS has_events, false AS has_anomaly_labels, bool_or(s2 IS NOT NULL) AS has_segments,
  bool_or(kd = 'noise_pair') AS has_noise_pairs, bool_or(kd = 'speaker_pair') AS has_speaker_pairs FROM z""")
def flt17(spark, d):
    m, files = audio_manifest(spark, d)
    return manifests.presence_flags(manifests.samples(manifests.resolved_records(m, "row_id", files), "row_id"))


@query("snk07_output_manifests", f"""WITH {MANIFEST} SELECT 'metadata' AS manifest, count(*) AS n FROM z WHERE kd = 'single' UNION ALL SELECT 'transcripts', count(*) FROM z WHERE kd = 'single' AND k % 5 = 0
  UNION ALL SELECT 'pairs_noise', count(*) FROM z WHERE kd = 'noise_pair' UNION ALL SELECT 'pairs_speaker', count(*) FROM z WHERE kd = 'speaker_pair' UNION ALL SELECT 'events', 0 UNION ALL SELECT 'anomaly', 0""")
def snk07(spark, d):
    m, files = audio_manifest(spark, d)
    _, kept = manifests.settled(m, "row_id", files)
    parts = [df.agg(F.lit(name).alias("manifest"), F.count("*").alias("n")) for name, df in manifests.output_manifests(kept).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("apr02_duration_buckets", """SELECT CASE WHEN value < 1 THEN '<1s' WHEN value < 5 THEN '1-5s' WHEN value < 15 THEN '5-15s' WHEN value < 60 THEN '15-60s' ELSE '60s+' END AS bucket, count(*) AS n FROM events WHERE value > 0 GROUP BY 1""")
def apr02(spark, d):
    return manifests.duration_distribution(table(spark, d, "events"), "value")


@query("apr04_sidecar_counts", """SELECT 'transcripts' AS kind, count(*) FILTER (event_id % 5 = 0) AS n FROM events UNION ALL SELECT 'speakers', count(*) FILTER (event_id % 5 = 1) FROM events
  UNION ALL SELECT 'segments', count(*) FILTER (event_id % 5 = 2) FROM events UNION ALL SELECT 'events', count(*) FILTER (event_id % 5 = 3) FROM events UNION ALL SELECT 'noise_pairs', 0 FROM events WHERE event_id = 0""")
def apr04(spark, d):
    word = F.element_at(F.array(F.lit("Transcript"), F.lit("speaker"), F.lit("vad"), F.lit("event"), F.lit("clip")), (F.col("event_id") % 5 + 1).cast("int"))
    return manifests.sidecar_counts(table(spark, d, "events").select(F.concat(F.lit("x/"), word, F.col("event_id").cast("string"), F.lit(".csv")).alias("path")))


@query("flt12_truth_values", """SELECT o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority = '2-HIGH' THEN 0 END AS same, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority = '2-HIGH' THEN 0 END AS anomaly,
  (o_orderpriority = '1-URGENT')::INT AS positive, count(*) AS n FROM orders GROUP BY ALL""")
def flt12(spark, d):
    p = F.col("o_orderpriority")
    t = table(spark, d, "orders").select(
        p, manifests.same_speaker(F.when(p == "1-URGENT", " TRUE ").when(p == "2-HIGH", "diff").otherwise("maybe")).alias("same"),
        manifests.anomaly_flag(F.when(p == "1-URGENT", "Abnormal part").when(p == "2-HIGH", "normal part").otherwise("part")).alias("anomaly"),
        manifests.positive_target(F.when(p == "1-URGENT", " Fraud").otherwise("no")).alias("positive"))
    return t.groupBy(*t.columns).agg(F.count("*").alias("n"))


@query("join06_noisy_clean_pairs", """SELECT 'Noisy/u' || (c_custkey % 10) || '/n' || c_custkey || '.wav' AS noisy_path, 'clean/u' || (c_custkey % 10) || '/N' || c_custkey || '.flac' AS clean_path FROM customer WHERE c_custkey % 3 = 0""")
def join06(spark, d):
    k = F.col("c_custkey")
    sub = F.concat(F.lit("/u"), (k % 10).cast("string"), F.lit("/"))
    noisy = F.concat(F.lit("Noisy"), sub, F.lit("n"), k.cast("string"), F.lit(".wav"))
    clean = F.when(k % 3 == 0, F.concat(F.lit("clean"), sub, F.lit("N"), k.cast("string"), F.lit(".flac")))
    return manifests.noisy_clean_pairs(table(spark, d, "customer").select(F.explode(F.array_compact(F.array(noisy, clean))).alias("path")))


@query("win05_unique_names", """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, 'part_' || l_partkey || CASE WHEN rn > 1 THEN '_' || (rn - 1) ELSE '' END AS file_name FROM
  (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 100000000 + l_linenumber * 10000000 + l_suppkey * 100 + l_quantity) AS rn FROM lineitem)""")
def win05(spark, d):
    from ..sinks.datasets import unique_names

    li = table(spark, d, "lineitem").withColumn("_k", F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_suppkey") * 100 + F.col("l_quantity"))
    t = li.select("_k", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", F.concat(F.lit(" part #"), F.col("l_partkey").cast("string")).alias("name"))
    return unique_names(t, "name", "_k").drop("_k", "name")


@query("src05_xml_records", """SELECT count(*) AS n, round(sum(s_acctbal), 2) AS total, count(DISTINCT s_nationkey) AS nations FROM supplier""")
def src05(spark, d):
    path = shared_folder(spark, "xml")
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("@id"), "s_acctbal", F.struct("s_nationkey").alias("home"))
    t.write.format("xml").option("rowTag", "supplier").option("attributePrefix", "@").save(path)
    df = records.flatten(records.read_xml_records(spark, path, "supplier"))
    return rounded(df.agg(F.count("`@id`").alias("n"), F.sum("s_acctbal").alias("total"), F.count_distinct("`home.s_nationkey`").alias("nations")), digits=2)


@query("src06_yaml_records", "SELECT c_nationkey AS nation, count(*) * 2 AS n, round(sum(c_acctbal) * 3, 2) AS balance FROM customer GROUP BY 1")
def src06(spark, d):
    c = table(spark, d, "customer")
    def item(factor):
        return F.concat(F.lit("  - {nation: "), F.col("c_nationkey").cast("string"), F.lit(", balance: "), F.round(F.col("c_acctbal") * factor, 2).cast("decimal(12,2)").cast("string"), F.lit("}\n"))

    docs = c.select(F.concat(F.lit("head: x\nitems:\n"), item(1), item(2)).alias("value"))
    rec = records.json_records(records.yaml_as_json(docs), "value", "items")
    out = rec.select(F.variant_get("rec", "$.nation", "int").alias("nation"), F.variant_get("rec", "$.balance", "double").alias("balance"))
    return rounded(out.groupBy("nation").agg(F.count("*").alias("n"), F.sum("balance").alias("balance")), digits=2)


@query("src23_voc", """WITH b AS (SELECT l_partkey % 3 AS c, l_discount * 1000 AS x1, l_tax * 1000 AS y1, l_discount * 1000 + l_quantity - 5 AS x2, l_tax * 1000 + 30 AS y2 FROM lineitem WHERE l_linenumber = 1
    UNION ALL SELECT 3, 1, 1, l_quantity + 1, 99 FROM lineitem WHERE l_linenumber = 1)
  SELECT 'c' || c AS class_name, CASE WHEN x2 > x1 THEN 'ok' ELSE 'invalid_box' END AS status, count(*) AS n, round(sum(greatest(least(x1, 90), least(x2, 90))), 3) AS right_edges, round(sum(least(y2, 70)), 3)::DOUBLE AS bottoms FROM b GROUP BY ALL""")
def src23(spark, d):
    path = shared_folder(spark, "voc")
    li = table(spark, d, "lineitem").filter("l_linenumber = 1")
    name = F.concat(F.lit("IMG"), F.col("l_orderkey").cast("string"))
    x, y = F.col("l_discount") * 1000, F.col("l_tax") * 1000

    def obj(label, *corners):
        box = F.struct(*[v.cast("string").alias(k) for k, v in zip(("xmin", "ymin", "xmax", "ymax"), corners)])
        return F.struct(label.alias("name"), box.alias("bndbox"))

    both = F.array(obj(F.concat(F.lit("c"), (F.col("l_partkey") % 3).cast("string")), x, y, x + F.col("l_quantity") - 5, y + 30),
                   obj(F.lit("c3"), F.lit(1.0), F.lit(1.0), F.col("l_quantity") + 1, F.lit(99.0)))
    docs = li.select(F.concat(name, F.lit(".jpg")).alias("filename"), F.struct(F.lit("90").alias("width"), F.lit("70").alias("height")).alias("size"), both.alias("object"))
    docs.write.format("xml").option("rowTag", "annotation").save(path)
    read = spark.read.format("xml").option("rowTag", "annotation").schema(an.VOC_SCHEMA).load(path).withColumn("path", F.lit("x.xml"))
    images = table(spark, d, "orders").select(F.concat(F.lit("img"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"), F.lit(90).alias("width"), F.lit(70).alias("height"))
    b = an.voc_boxes(read, images)
    return rounded(b.groupBy("class_name", "status").agg(F.count("*").alias("n"), F.sum("x2").alias("right_edges"), F.sum("y2").alias("bottoms")), digits=3)
