"""Document corpora: decoded text files, class folders, metadata joined to files, CoNLL, transcripts, zip members."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE

# Column names read as document paths; transcript stem suffixes.
PATH_COLUMNS = ("document_path", "file_path", "filepath", "filename", "file", "path", "document")
TRANSCRIPT_SUFFIXES = ("_text", "_transcript", "_transcription", "_asr")


@F.pandas_udf(T.StringType())
def _legacy_decode(content: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        try:
            return raw.decode("cp1252")
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    return content.map(one)


def decode_bytes(content: Column) -> Column:
    """UTF-8 when valid, else Windows-1252, else Latin-1; byte order mark dropped, line ends unified."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    text = F.when(utf8, content.cast("string")).otherwise(_legacy_decode(F.when(~utf8, content)))
    text = F.regexp_replace(text, r"^\x{feff}", "")
    return F.regexp_replace(text, r"\r\n?", "\n")


def relative_path(path: Column, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "^" + literal_pattern(root.rstrip("/") + "/"), "")


def literal_pattern(text: str) -> str:
    return "\\Q" + text + "\\E"


def is_hidden(rel: Column) -> Column:
    return F.exists(F.split(rel, "/"), lambda p: p.startswith(".") | (p == "__MACOSX"))


def safe_relative_path(path: Column) -> Column:
    """Cleaned relative path, or NULL for absolute paths, drives and parent references."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    bad = p.startswith("/") | F.contains(F.substring_index(p, "/", 1), F.lit(":")) | F.array_contains(parts, "..")
    return F.when(~bad & (F.size(parts) > 0), F.array_join(parts, "/"))


def single_root(files: DataFrame, rel: str = "path") -> DataFrame:
    """Drops the first folder when every file lies in the same one."""
    first = F.when(F.contains(F.col(rel), F.lit("/")), F.substring_index(rel, "/", 1)).otherwise(F.lit(""))
    row = files.agg(F.min(first).alias("a"), F.max(first).alias("b")).first()
    if not row["a"] or row["a"] != row["b"]:
        return files
    return files.withColumn(rel, F.expr(f"substr(`{rel}`, {len(row['a']) + 2})"))


def zip_members(archives: DataFrame, max_bytes: int = 512 << 20) -> DataFrame:
    """(archive, path, content, status) of every visible zip entry; one archive is one task's input."""
    def unpack(batches):
        import io
        import zipfile

        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                try:
                    bundle = zipfile.ZipFile(io.BytesIO(raw))
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(name, None, None, "not a zip archive")], columns=["archive", "path", "content", "status"])
                    continue
                for info in bundle.infolist():
                    parts = info.filename.split("/")
                    if info.is_dir() or any(p.startswith(".") or p == "__MACOSX" for p in parts) or parts[0] == "":
                        continue
                    try:
                        body, status = bundle.read(info), "ok"
                    except Exception as exc:
                        body, status = None, f"corrupt: {exc}"
                    yield pd.DataFrame([(name, info.filename, body, status)], columns=["archive", "path", "content", "status"])

    return archives.select("path", "content").mapInPandas(unpack, "archive string, path string, content binary, status string")


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path relative to root, content) of all visible files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    files = raw.select(relative_path(F.col("path"), root).alias("path"), "content", "length")
    return files.filter(~is_hidden(F.col("path")))


def plain_corpus(files: DataFrame) -> DataFrame:
    """(document_id, document_path, text) of files (path, content); blank documents are dropped."""
    docs = files.select(F.col("path").alias("document_id"), F.col("path").alias("document_path"), decode_bytes(F.col("content")).alias("text"))
    return docs.filter(F.rlike("text", F.lit(f"[^\\s\\p{{Z}}]")))


def class_folder_corpus(files: DataFrame) -> DataFrame:
    """Plain corpus with the first folder as label; files at the top level have none and are left out."""
    docs = plain_corpus(files).filter(F.contains("document_path", F.lit("/")))
    return docs.withColumn("label", F.substring_index("document_path", "/", 1))


def path_column(columns: Sequence[str]) -> str | None:
    norm = {c.strip().lower(): c for c in columns}
    return next((norm[p] for p in PATH_COLUMNS if p in norm), None)


def leaf(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_forms(p: Column) -> Column:
    """The spellings under which a path is looked up, best first."""
    return F.array(p, F.lower(p), leaf(p), F.lower(leaf(p)))


def file_index(files: DataFrame, file_path: str = "path") -> DataFrame:
    """(_form, _file): one file for every spelling of a path."""
    forms = files.select(F.col(file_path).alias("_file"), F.explode(F.array_distinct(path_forms(F.col(file_path)))).alias("_form"))
    return forms.groupBy("_form").agg(F.min("_file").alias("_file"))


def resolve_paths(rows: DataFrame, key: str, path: str, files: DataFrame, file_path: str = "path") -> DataFrame:
    """(key, file_path or NULL), one row per key: exact path, lower-cased path, file name, lower-cased file name, in that
    order. Lookup keys of the files are reduced to one file each before the join; rows and files are read once."""
    named = safe_relative_path(F.col(path))
    nowhere = F.array(F.concat(F.lit("\x00"), F.xxhash64(key).cast("string")))  # no file has this name; keeps rows without a path apart
    asked = rows.select(F.col(key).alias("_key"), F.posexplode(F.when(named.isNotNull(), path_forms(named)).otherwise(nowhere)).alias("_rank", "_form"))
    hits = asked.join(file_index(files, file_path), "_form", "left")
    return hits.groupBy("_key").agg(best_file().alias("resolved_path")).withColumnRenamed("_key", key)


def best_file() -> Column:
    """The file found under the best spelling of a group of joined lookups."""
    return F.min_by("_file", F.when(F.col("_file").isNotNull(), F.col("_rank")))


def corpus_with_metadata(meta: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """Metadata rows with the text of the file they point to (their own text wins), or their inline text when no path
    column exists; without either, the plain corpus."""
    col = path_column([c for c in meta.columns if c != key])
    if col is None:
        if "text" in [c.strip().lower() for c in meta.columns]:
            return meta
        return plain_corpus(files)
    found = resolve_paths(meta, key, col, files).filter("resolved_path IS NOT NULL")
    texts = files.select(F.col("path").alias("resolved_path"), decode_bytes(F.col("content")).alias("_text"))
    out = meta.drop(col).join(found.join(texts, "resolved_path"), key)
    own = F.when(F.col("text") != "", F.col("text")) if "text" in meta.columns else F.lit(None).cast("string")
    return out.withColumn("text", F.coalesce(own, "_text")).withColumnRenamed("resolved_path", "document_path").drop("_text")


def conll_sentences(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(document_id, document_path, text, tokens, tags, kind) per sentence of CoNLL files. A blank or ``#`` line ends a
    sentence; the first column is the token, the last the tag; kind is ner or pos, decided per file."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"(?m)^[ \t]*#.*$", "")
    chunks = F.split(body, r"\n[ \t]*(?:\n[ \t]*)+")

    def rows(chunk):
        lines = F.transform(F.split(chunk, "\n"), lambda ln: F.filter(F.split(ln, f"{SPACE}+"), lambda p: p != ""))
        return F.transform(F.filter(lines, lambda p: F.size(p) >= 2), lambda p: F.struct(
            F.element_at(p, 1).alias("token"), F.element_at(p, -1).alias("tag")))

    sents = F.filter(F.transform(chunks, rows), lambda s: F.size(s) > 0)
    per_file = files.select(F.col(path).alias("document_path"), sents.alias("_s"))
    tags = F.flatten(F.transform("_s", lambda s: F.transform(s, lambda r: r["tag"])))
    bio = F.exists(tags, lambda t: F.rlike(t, F.lit("^(B-|I-|O)")))
    pos = F.exists(tags, lambda t: (t == F.upper(t)) & (F.length(t) <= 5) & F.rlike(t, F.lit("[A-Z]")) & ~F.rlike(t, F.lit("[-_]")))
    per_file = per_file.withColumn("kind", F.when(bio, "ner").when(pos, "pos").otherwise("ner"))
    out = per_file.select("document_path", "kind", F.posexplode("_s").alias("_i", "_r"))
    tokens = F.transform("_r", lambda r: r["token"])
    return out.select(
        F.concat("document_path", F.lit("#s"), F.col("_i").cast("string")).alias("document_id"), "document_path",
        F.array_join(tokens, " ").alias("text"), tokens.alias("tokens"),
        F.transform("_r", lambda r: r["tag"]).alias("tags"), "kind")


def bio_spans(tokens: Column, tags: Column) -> Column:
    """Character spans (start, end, label) of B-/I- runs in the blank-joined tokens."""
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")
    none = F.lit(None).cast("struct<start:int,end:int,label:string>")
    start = F.struct(empty.alias("done"), none.alias("open"), F.lit(0).alias("at"))

    def close(acc):
        return F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    def step(acc, x):
        label, at, end = F.substr(x["t"], F.lit(3)), acc["at"], acc["at"] + F.length(x["w"])
        fresh = F.struct(at.alias("start"), end.alias("end"), label.alias("label"))
        longer = F.struct(acc["open"]["start"].alias("start"), end.alias("end"), label.alias("label"))
        more = acc["open"].isNotNull() & (x["t"] == F.concat(F.lit("I-"), acc["open"]["label"]))
        nxt = end + 1
        return (
            F.when(x["t"].startswith("B-"), F.struct(close(acc).alias("done"), fresh.alias("open"), nxt.alias("at")))
            .when(more, F.struct(acc["done"].alias("done"), longer.alias("open"), nxt.alias("at")))
            .otherwise(F.struct(close(acc).alias("done"), none.alias("open"), nxt.alias("at")))
        )

    pairs = F.zip_with(tokens, tags, lambda w, t: F.struct(w.alias("w"), t.alias("t")))
    return F.aggregate(pairs, start, step, close)


def transcript_text(text: Column, extension: Column) -> Column:
    """Spoken words of a transcript file; cue numbers, timings and headers of subtitle formats are dropped."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.trim(s))
    spoken = F.filter(lines, lambda s: (s != "") & ~F.rlike(s, F.lit(r"^\p{Nd}+$")) & ~F.contains(s, F.lit("-->")) & ~F.upper(s).startswith("WEBVTT"))
    return F.when(F.lower(extension).isin("srt", "vtt"), F.array_join(spoken, " ")).otherwise(F.trim(text))


def transcript_stem(stem: Column) -> Column:
    return F.regexp_replace(stem, "(?:" + "|".join(TRANSCRIPT_SUFFIXES) + ")$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(leaf(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(leaf(path), r".\.([^.]*)$", 1))


def transcripts_by_media(media: DataFrame, sidecars: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """Media rows with the transcript that shares their folder and stem."""
    side = sidecars.select(
        folder(F.col(path)).alias("_dir"), transcript_stem(stem(F.col(path))).alias("_stem"), F.col(path).alias("_p"),
        transcript_text(F.col(text), extension(F.col(path))).alias("transcript")).filter("transcript <> ''")
    first = side.groupBy("_dir", "_stem").agg(F.min_by("transcript", "_p").alias("transcript"))
    keyed = media.withColumns({"_dir": folder(F.col(path)), "_stem": stem(F.col(path))})
    return keyed.join(first, ["_dir", "_stem"], "left").drop("_dir", "_stem")
