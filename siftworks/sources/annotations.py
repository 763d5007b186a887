"""Image annotations (COCO, Pascal VOC, YOLO) as one long table of boxes.

A box is one row (image_id, box_index, class_name, x1, y1, x2, y2, status); statuses other than ``ok`` say why a box is
not usable. Boxes stay rows on purpose: an image with very many of them is never gathered in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..operators.rows import side_by_side
from .corpora import stem

BOX = ("x1", "y1", "x2", "y2")


def clamped(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Corners inside the image (a size of 0 is unknown and does not limit), in ascending order."""
    def inside(c, size):
        return F.when(size > 0, F.greatest(F.lit(0.0), F.least(size.cast("double"), c))).otherwise(c)

    xs = [inside(box[k], width) for k in ("x1", "x2")]
    ys = [inside(box[k], height) for k in ("y1", "y2")]
    return {"x1": F.least(*xs), "y1": F.least(*ys), "x2": F.greatest(*xs), "y2": F.greatest(*ys)}


def area_positive() -> Column:
    return (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of COCO documents."""
    doc = spark.read.option("multiLine", True).json(path)
    for part in ("images", "annotations", "categories"):
        if part not in doc.columns:
            raise ValueError(f"COCO document lacks '{part}'")
    return tuple(doc.select(F.explode(p).alias("r")).select("r.*") for p in ("images", "annotations", "categories"))


def coco_boxes(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Boxes of images (id, width, height), annotations (image_id, id, category_id, bbox xywh) and categories (id, name)."""
    names = categories.select(F.col("id").cast("long").alias("category_id"), F.coalesce(
        F.col("name"), F.concat(F.lit("cat_"), F.col("id").cast("string"))).alias("class_name"))
    sizes = images.select(F.col("id").cast("long").alias("image_id"), "width", "height")
    ann = annotations.select(
        F.col("image_id").cast("long").alias("image_id"), F.col("id").alias("box_index"),
        F.expr("try_cast(category_id AS bigint)").alias("category_id"), F.col("bbox").cast("array<double>").alias("bbox"))
    both = ann.join(sizes, "image_id").join(names, "category_id", "left")
    b = F.col("bbox")
    raw = {"x1": b[0], "y1": b[1], "x2": b[0] + b[2], "y2": b[1] + b[3]}
    out = both.withColumns(clamped(raw, F.col("width"), F.col("height")))
    whole = (F.size(b) == 4) & ~F.exists(b, lambda v: v.isNull())
    status = (
        F.when(F.col("class_name").isNull(), "unmapped_class")
        .when(b.isNull() | (F.size(b) != 4), "no_box")
        .when(~whole | ~area_positive(), "invalid_box").otherwise("ok"))
    return out.select("image_id", "box_index", "class_name", *BOX, status.alias("status"))


def coco_extras(annotations: DataFrame) -> DataFrame:
    """(image_id, masks, invalid masks, keypoint sets) from segmentation and keypoint fields given as JSON text."""
    seg, kp = F.col("segmentation"), F.from_json("keypoints", "array<double>")
    polygons = F.rlike(seg, F.lit(r"^\s*(\[\s*\[|\{)"))
    present = seg.isNotNull() & ~seg.isin("", "[]", "{}")
    return annotations.groupBy("image_id").agg(
        F.count_if(present & polygons).alias("mask_count"),
        F.count_if(present & ~polygons).alias("invalid_mask_count"),
        F.count_if((F.size(kp) > 0) & (F.size(kp) % 3 == 0) & ~F.exists(kp, lambda v: v.isNull())).alias("keypoint_count"))


def yolo_boxes(lines: DataFrame, images: DataFrame, classes: DataFrame) -> DataFrame:
    """Boxes of label lines (path, line_index, value), joined to images (path, width, height) on the lower-cased stem and to
    classes (id, name). Lines are ``class cx cy w h`` with shares of the image size."""
    parts = F.filter(F.split(F.trim("value"), f"{SPACE}+"), lambda p: p != "")
    rows = lines.select(F.lower(stem(F.col("path"))).alias("image_id"), F.col("line_index").alias("box_index"), parts.alias("p"))
    rows = rows.filter(F.size("p") >= 5)
    nums = rows.select("image_id", "box_index", *[
        F.expr(f"try_cast(p[{i}] AS double)").alias(n) for i, n in enumerate(("cls", "cx", "cy", "bw", "bh"))])
    nums = nums.withColumn("class_id", F.col("cls").cast("int"))
    sized = images.select(F.lower(stem(F.col("path"))).alias("image_id"), "width", "height")
    sized = sized.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    names = classes.select(F.col("id").cast("int").alias("class_id"), F.col("name").alias("class_name"))
    both = nums.join(sized, "image_id").join(names, "class_id", "left")
    known = (F.col("width") > 0) & (F.col("height") > 0)
    w, h = (F.when(known, F.col(c)).otherwise(F.lit(1)) for c in ("width", "height"))
    share = F.col("cx").between(0, 1) & F.col("cy").between(0, 1) & (F.col("bw") > 0) & (F.col("bw") <= 1) & (F.col("bh") > 0) & (F.col("bh") <= 1)
    status = (
        F.when(F.col("cls").isNull() | ~F.coalesce(share, F.lit(False)), "invalid_box")
        .when(F.col("class_name").isNull(), "unmapped_class").otherwise("ok"))
    return both.select(
        "image_id", "box_index", "class_name",
        ((F.col("cx") - F.col("bw") / 2) * w).alias("x1"), ((F.col("cy") - F.col("bh") / 2) * h).alias("y1"),
        ((F.col("cx") + F.col("bw") / 2) * w).alias("x2"), ((F.col("cy") + F.col("bh") / 2) * h).alias("y2"), status.alias("status"))


def read_yolo_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_index, value) of label files; class name files are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(
        F.col("_metadata.file_path").alias("path"), "value")
    files = files.filter(~F.lower(F.substring_index("path", "/", -1)).isin("classes.txt", "names.txt"))
    return files.select("path", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_index", "value"))


VOC_SCHEMA = (
    "filename string, size struct<width:string,height:string>, "
    "object array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"
)


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """Annotation documents with their own path."""
    reader = spark.read.format("xml").option("rowTag", "annotation").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml")
    return reader.schema(VOC_SCHEMA).load(path).select("*", F.col("_metadata.file_path").alias("path"))


def voc_boxes(documents: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes of VOC documents joined to images (path, width, height) on the lower-cased stem of the named file."""
    named = F.when(F.coalesce(F.trim("filename"), F.lit("")) != "", F.col("filename")).otherwise(F.col("path"))
    docs = documents.select(
        F.lower(stem(named)).alias("image_id"),
        *[F.coalesce(F.expr(f"try_cast(size.{s} AS int)"), F.lit(0)).alias(f"_{s}") for s in ("width", "height")],
        F.posexplode("object").alias("box_index", "o"))
    sized = images.groupBy(F.lower(stem(F.col("path"))).alias("image_id")).agg(F.max("width").alias("iw"), F.max("height").alias("ih"))
    both = docs.join(sized, "image_id")
    lost = (F.col("_width") == 0) | (F.col("_height") == 0)
    both = both.withColumns({
        "width": F.when(lost, F.col("iw")).otherwise(F.col("_width")), "height": F.when(lost, F.col("ih")).otherwise(F.col("_height")),
        "class_name": F.trim("o.name"),
        **{k: F.expr(f"try_cast(o.bndbox.{v} AS double)") for k, v in zip(BOX, ("xmin", "ymin", "xmax", "ymax"))}})
    both = both.filter((F.col("class_name") != "") & F.col("o.bndbox").isNotNull())
    status = F.when(F.coalesce(area_positive(), F.lit(False)), "ok").otherwise("invalid_box")
    both = both.withColumn("status", status)
    return both.withColumns(clamped({k: F.col(k) for k in BOX}, F.col("width"), F.col("height"))).select(
        "image_id", "box_index", "class_name", *BOX, "status")


def image_summary(images: DataFrame, boxes: DataFrame, image_id: str = "image_id") -> DataFrame:
    """Per image: usable boxes and the majority class (ties: the class seen first). Counting per (image, class) combines
    map-side, so one crowded image is no bottleneck."""
    ok = boxes.filter("status = 'ok'").groupBy("image_id", "class_name").agg(
        F.count("*").alias("n"), F.min("box_index").alias("first"))
    per = ok.groupBy("image_id").agg(
        F.sum("n").alias("n_boxes"), F.max_by("class_name", F.struct("n", -F.col("first"))).alias("label"))
    out = images.withColumnRenamed(image_id, "image_id").join(per, "image_id", "left")
    return out.withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)).cast("long"))


def annotation_profile(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row: image and box counts, invalid and unmapped boxes, boxes per image, sizes and aspect ratios."""
    per = image_summary(images.select("image_id", "width", "height"), boxes)
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    one = per.agg(
        F.count("*").alias("image_count"), F.sum("n_boxes").alias("bbox_count"), F.count_if(F.col("n_boxes") == 0).alias("images_without_annotations"),
        *[g(F.when(sized, F.col(c))).alias(f"{n}_{c}") for c in ("width", "height") for n, g in (("min", F.min), ("max", F.max))],
        *[g(F.when(sized, F.col("width") / F.col("height"))).alias(f"{n}_aspect") for n, g in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    bad = boxes.agg(
        F.count_if(F.col("status") == "invalid_box").alias("invalid_bbox_count"),
        F.count_if(F.col("status") == "unmapped_class").alias("unmapped_class_count"))
    both = side_by_side(one, bad)
    return both.withColumn("average_boxes_per_image", F.when(F.col("image_count") > 0, F.col("bbox_count") / F.col("image_count")).otherwise(F.lit(0.0)))


def class_distribution(boxes: DataFrame) -> DataFrame:
    return boxes.filter("status = 'ok'").groupBy("class_name").agg(F.count("*").alias("n"))


def split_summary(samples: DataFrame, split: str = "split") -> DataFrame:
    name = F.when(F.coalesce(F.trim(F.col(split)), F.lit("")) == "", "default").otherwise(F.col(split))
    return samples.groupBy(name.alias("split")).agg(F.count("*").alias("n"))


def matched(images: DataFrame, labels: DataFrame, key: str = "image_id") -> DataFrame:
    """(missing, unused): label files without an image and images without a label file."""
    a, b = images.select(key).distinct(), labels.select(key).distinct()
    both = a.withColumn("i", F.lit(1)).unionByName(b.withColumn("l", F.lit(1)), allowMissingColumns=True).groupBy(key).agg(
        F.max("i").alias("i"), F.max("l").alias("l"))
    return both.agg(F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("unused"))


# File name endings that mark a sidecar of an image.
SIDECARS = {
    "keypoints": (("_keypoints", "_kp", "_pose"), ("json", "xml", "txt", "csv")),
    "masks": (("_mask", "_seg", "_segmentation"), ("png", "jpg", "jpeg", "bmp", "npy")),
    "depth": (("_depth", "_depthmap", "_depth_map"), ("png", "jpg", "jpeg", "bmp", "npy")),
}
ANNOTATION_EXTENSIONS = ("json", "xml", "txt", "csv")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp")


def sidecar_flags(files: DataFrame, path: str = "path") -> DataFrame:
    """Which sidecars each image has: same folder, stem of the image followed by a marker. Each sidecar names the one stem
    it can belong to, so this is an equi-join on (folder, stem)."""
    from .corpora import extension, folder

    p = F.col(path)
    base = files.select(p.alias(path), folder(p).alias("_dir"), stem(p).alias("_stem"), extension(p).alias("_ext"))
    parts = []
    for kind, (marks, exts) in SIDECARS.items():
        for m in marks:
            at = F.instr("_stem", m)
            hit = base.filter((at > 0) & F.col("_ext").isin(*exts))
            parts.append(hit.select("_dir", F.substring_index("_stem", m, 1).alias("_stem"), F.lit(kind).alias("kind")))
    parts.append(base.filter(F.col("_ext").isin(*ANNOTATION_EXTENSIONS)).select("_dir", "_stem", F.lit("boxes").alias("kind")))
    side = parts[0]
    for q in parts[1:]:
        side = side.unionByName(q)
    flags = side.groupBy("_dir", "_stem").agg(*[F.bool_or(F.col("kind") == k).alias(f"has_{k}") for k in (*SIDECARS, "boxes")])
    images = base.filter(F.col("_ext").isin(*IMAGE_EXTENSIONS))
    out = images.join(flags, ["_dir", "_stem"], "left").drop("_dir", "_stem", "_ext")
    return out.fillna(False, [f"has_{k}" for k in (*SIDECARS, "boxes")])
