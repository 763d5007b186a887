"""Audio manifests: alias columns, file resolution, segment checks, pairs, and the canonical output manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rows import side_by_side
from ..session import cut_lineage
from .corpora import best_file, file_index, folder, path_forms, safe_relative_path, stem

# Column names accepted for each role, first one present wins; words read as truth values.
ALIASES = {
    "path": ("audio_path", "file_path", "filepath", "path", "file", "filename", "audio", "audio_file", "wav_path"),
    "label": ("label", "class", "target", "category", "labels"),
    "speaker": ("speaker_id", "speaker", "spk_id", "spk"),
    "transcript": ("transcript", "text", "transcription", "reference", "reference_text", "sentence"),
    "event": ("event_label", "event", "event_class"),
    "anomaly": ("anomaly_label", "anomaly", "is_anomaly"),
    "noisy": ("noisy_path", "noisy", "noisy_audio", "noisy_file"),
    "clean": ("clean_path", "clean", "clean_audio", "clean_file", "reference_path"),
    "pair_a": ("audio_path_a", "audio_a", "path_a", "file_a", "wav_a"),
    "pair_b": ("audio_path_b", "audio_b", "path_b", "file_b", "wav_b"),
    "same_speaker": ("same_speaker", "is_same_speaker", "same", "label_pair"),
    "start": ("start_time", "start", "begin", "onset"),
    "end": ("end_time", "end", "stop", "offset"),
    "split": ("split", "subset", "partition"),
    "duration": ("duration", "length"),
    "sample_rate": ("sample_rate", "sampling_rate", "sr"),
}
SAME_WORDS = ("1", "true", "yes", "same", "y", "t")
DIFFERENT_WORDS = ("0", "false", "no", "different", "diff", "n", "f")
ANOMALY_WORDS = ("anomaly", "defect", "fraud", "outlier", "abnormal", "positive")
NORMAL_WORDS = ("normal", "good", "ok", "negative", "clean")
POSITIVE_TARGETS = ("1", "true", "yes", "anomaly", "outlier", "fraud")
END_TOLERANCE = 1e-3
TIMES = ("start", "end", "duration", "sample_rate")
FILE_ROLES = ("path", "noisy", "clean", "pair_a", "pair_b")


def roles(columns: Sequence[str]) -> dict[str, str]:
    lower = {c.strip().lower(): c for c in reversed(columns)}
    found = {}
    for role, names in ALIASES.items():
        hit = next((lower[n] for n in names if n in lower), None)
        if hit:
            found[role] = hit
    return found


def canonical(manifest: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Role columns of a manifest: trimmed text, numbers for times; absent roles are empty."""
    found = roles([c for c in manifest.columns if c not in keep])
    out = []
    for role in ALIASES:
        if role in TIMES:
            out.append((F.expr(f"try_cast(`{found[role]}` AS double)") if role in found else F.lit(None).cast("double")).alias(role))
        else:
            out.append((F.trim(F.coalesce(F.col(f"`{found[role]}`").cast("string"), F.lit(""))) if role in found else F.lit("")).alias(role))
    return manifest.select(*keep, *out)


def same_speaker(c: Column) -> Column:
    w = F.lower(F.trim(c))
    return F.when(w.isin(*SAME_WORDS), 1).when(w.isin(*DIFFERENT_WORDS), 0)


def anomaly_flag(label: Column) -> Column:
    """1 for labels naming an anomaly, 0 for labels naming a normal state, else NULL."""
    low = F.lower(label)
    return F.when(F.rlike(low, F.lit("|".join(ANOMALY_WORDS))), 1).when(F.rlike(low, F.lit("|".join(NORMAL_WORDS))), 0)


def positive_target(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin(*POSITIVE_TARGETS).cast("int")


def checked_segment(start: Column, end: Column, duration: Column) -> tuple[Column, Column, Column]:
    """(start, end, invalid): negative or empty segments are dropped, an end past the duration is cut to it."""
    both = start.isNotNull() & end.isNotNull()
    wrong = both & ((start < 0) | (end <= start))
    over = both & ~wrong & (duration > 0) & (end > duration + END_TOLERANCE)
    lost = wrong | (over & (start >= duration))
    return (
        F.when(~F.coalesce(lost, F.lit(False)), start),
        F.when(~F.coalesce(lost, F.lit(False)), F.when(F.coalesce(over, F.lit(False)), duration).otherwise(end)),
        F.coalesce(wrong | over, F.lit(False)),
    )


def record_status(m: DataFrame) -> Column:
    """Kind of a canonical record: noisy/clean pair, speaker pair, single file, or missing."""
    return (
        F.when((F.col("noisy") != "") & (F.col("clean") != ""), "noise_pair")
        .when((F.col("pair_a") != "") & (F.col("pair_b") != ""), "speaker_pair")
        .when(F.col("path") != "", "single").otherwise("missing"))


def resolved_records(m: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """Canonical records with every named file resolved; ``kind`` is NULL when a needed file is missing. The lookups of all
    file roles meet the files in one join and fold back to one row per record."""
    named = m.select(key, F.inline(F.array(*[F.struct(F.lit(r).alias("role"), safe_relative_path(F.col(r)).alias("named")) for r in FILE_ROLES]))).filter("named IS NOT NULL")
    asked = named.select(key, "role", F.posexplode(path_forms(F.col("named"))).alias("_rank", "_form"))
    hits = asked.join(file_index(files), "_form").groupBy(key, "role").agg(best_file().alias("file"))
    found = hits.groupBy(key).agg(*[F.max(F.when(F.col("role") == r, F.col("file"))).alias(f"{r}_file") for r in FILE_ROLES])
    out = m.join(found, key, "left").withColumn("_kind", record_status(m))
    needs = {"noise_pair": ("noisy", "clean"), "speaker_pair": ("pair_a", "pair_b"), "single": ("path",)}
    complete, absent = F.lit(False), F.lit(1)
    for kind, parts in needs.items():
        here = F.col("_kind") == kind
        gone = sum(F.col(f"{p}_file").isNull().cast("int") for p in parts)
        complete = F.when(here, gone == 0).otherwise(complete)
        absent = F.when(here, gone).otherwise(absent)
    primary = F.when(F.col("_kind") == "noise_pair", F.col("noisy_file")).when(F.col("_kind") == "speaker_pair", F.col("pair_a_file")).otherwise(F.col("path_file"))
    return out.withColumns({
        "kind": F.when(complete, F.col("_kind")), "files_missing": absent,
        "invalid_pair": (F.col("_kind").isin("noise_pair", "speaker_pair") & ~complete), "primary_file": primary}).drop("_kind")


def samples(records: DataFrame, key: str) -> DataFrame:
    """Usable records, the first of each combination of files, with checked segments."""
    dup = ["primary_file", *FILE_ROLES]
    usable = records.filter("kind IS NOT NULL")
    others = [c for c in usable.columns if c not in dup]
    kept = usable.groupBy(*dup).agg(F.min_by(F.struct(*others), key).alias("_first")).select(*dup, "_first.*").select(*usable.columns)
    start, end, bad = checked_segment(F.col("start"), F.col("end"), F.col("duration"))
    return kept.withColumns({"start": start, "end": end, "invalid_segment": bad, "same": same_speaker(F.col("same_speaker"))})


def settled(m: DataFrame, key: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved records and samples, each written once below the checkpoint folder, for all the reports and manifests that
    are read off them."""
    records = cut_lineage(resolved_records(m, key, files))
    return records, cut_lineage(samples(records, key))


def manifest_report(records: DataFrame, kept: DataFrame, files: DataFrame) -> DataFrame:
    """One row: records read, kept, duplicate; missing and unused files; invalid pairs and segments."""
    used = kept.select(F.explode(F.array_compact(F.array(*[F.col(f"{r}_file") for r in FILE_ROLES]))).alias("path")).distinct()
    a = records.agg(
        F.count("*").alias("record_count"), F.sum("files_missing").alias("missing_count"), F.count_if("invalid_pair").alias("invalid_pair_count"),
        F.count_if(F.col("kind").isNotNull()).alias("_usable"))
    b = kept.agg(F.count("*").alias("sample_count"), F.count_if("invalid_segment").alias("invalid_segment_count"))
    c = files.join(used, "path", "left_anti").agg(F.count("*").alias("unused_count"))
    out = side_by_side(a, b, c)
    return out.withColumn("duplicate_count", F.col("_usable") - F.col("sample_count")).drop("_usable")


def noisy_clean_pairs(files: DataFrame, path: str = "path") -> DataFrame:
    """(noisy_path, clean_path): files under ``noisy/`` and ``clean/`` with the same sub-folder and stem."""
    p = F.col(path)
    rest = F.regexp_replace(p, "^[^/]+/", "")
    parts = files.filter(F.contains(p, F.lit("/"))).select(
        p.alias("_p"), F.lower(F.substring_index(p, "/", 1)).alias("_top"), folder(rest).alias("_dir"), F.lower(stem(rest)).alias("_stem"))
    sides = parts.filter(F.col("_top").isin("noisy", "clean"))
    clean = sides.filter("_top = 'clean'").groupBy("_dir", "_stem").agg(F.max("_p").alias("clean_path"))
    noisy = sides.filter("_top = 'noisy'").select("_dir", "_stem", F.col("_p").alias("noisy_path"))
    return noisy.join(clean, ["_dir", "_stem"]).select("noisy_path", "clean_path")


DURATION_BUCKETS = ((1, "<1s"), (5, "1-5s"), (15, "5-15s"), (60, "15-60s"))


def duration_bucket(seconds: Column) -> Column:
    out = F.when(F.lit(False), "")
    for limit, name in DURATION_BUCKETS:
        out = out.when(seconds < limit, name)
    return out.otherwise("60s+")


def duration_distribution(samples: DataFrame, duration: str = "duration") -> DataFrame:
    kept = samples.filter(F.col(duration) > 0)
    return kept.groupBy(duration_bucket(F.col(duration)).alias("bucket")).agg(F.count("*").alias("n"))


def reference_profile(samples: DataFrame) -> DataFrame:
    """(section, name, n): label, event, anomaly and split distributions and the pair, segment and transcript counts."""
    def present(c):
        return F.col(c) != ""

    fixed = {
        "transcripts": present("transcript"), "segments": F.col("start").isNotNull() & F.col("end").isNotNull(),
        "noise_pairs": present("noisy") & present("clean"), "speaker_pairs": present("pair_a") & present("pair_b")}
    cells = F.array_compact(F.array(
        *[F.when(present(c), F.struct(F.lit(c).alias("section"), F.col(c).alias("name"))) for c in ("label", "speaker", "event", "anomaly")],
        F.struct(F.lit("split").alias("section"), F.when(present("split"), F.col("split")).otherwise("default").alias("name")),
        *[F.when(cond, F.struct(F.lit("count").alias("section"), F.lit(k).alias("name"))) for k, cond in fixed.items()]))
    return samples.select(F.inline(cells)).groupBy("section", "name").agg(F.count("*").alias("n"))


def presence_flags(samples: DataFrame) -> DataFrame:
    """One row of booleans: which kinds of annotation the samples carry."""
    any_of = {
        "has_labels": F.col("label") != "", "has_speakers": F.col("speaker") != "", "has_transcripts": F.col("transcript") != "",
        "has_events": F.col("event") != "", "has_anomaly_labels": F.col("anomaly") != "",
        "has_segments": F.col("start").isNotNull() & F.col("end").isNotNull(),
        "has_noise_pairs": (F.col("noisy") != "") & (F.col("clean") != ""),
        "has_speaker_pairs": (F.col("pair_a") != "") & (F.col("pair_b") != "")}
    return samples.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in any_of.items()])


# File name words that mark the kind of a sidecar.
SIDECAR_WORDS = {
    "transcripts": ("transcript", "transcription", "asr"), "speakers": ("speaker", "pair"),
    "segments": ("segment", "diar", "rttm", "vad"), "events": ("event", "sed"), "noise_pairs": ("clean", "noisy"),
}


def sidecar_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """How many file names carry each marker word: one pass over the listing."""
    low = F.lower(F.substring_index(path, "/", -1))
    one = files.agg(*[F.count_if(F.rlike(low, F.lit("|".join(w)))).alias(k) for k, w in SIDECAR_WORDS.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in SIDECAR_WORDS])))


def output_manifests(kept: DataFrame) -> dict[str, DataFrame]:
    """The canonical manifests as projections of the samples; write each with ``write_manifests``."""
    label = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("label", "speaker", "event", "anomaly")], F.lit("unlabeled"))

    def time(c):
        return F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("")

    single = kept.filter("kind = 'single'").withColumn("folder", label)
    return {
        "metadata": single.select(
            F.col("primary_file").alias("file"), "folder", "label", F.col("speaker").alias("speaker_id"), "transcript",
            F.col("event").alias("event_label"), F.col("anomaly").alias("anomaly_label"), "split",
            time("duration").alias("duration"), time("start").alias("start_time"), time("end").alias("end_time")),
        "transcripts": single.filter("transcript <> ''").select(F.col("primary_file").alias("file"), "transcript"),
        "pairs_noise": kept.filter("kind = 'noise_pair'").select(F.col("noisy_file").alias("noisy_path"), F.col("clean_file").alias("clean_path")),
        "pairs_speaker": kept.filter("kind = 'speaker_pair'").select(
            F.col("pair_a_file").alias("audio_path_a"), F.col("pair_b_file").alias("audio_path_b"),
            F.coalesce(F.col("same").cast("string"), F.lit("")).alias("same_speaker")),
        "events": single.filter("start IS NOT NULL AND end IS NOT NULL AND event <> ''").select(
            F.col("primary_file").alias("file"), F.col("event").alias("event_label"), time("start").alias("start_time"), time("end").alias("end_time")),
        "anomaly": single.filter("anomaly <> ''").select(F.col("primary_file").alias("file"), F.col("anomaly").alias("anomaly_label")),
    }


def write_manifests(kept: DataFrame, path: str) -> None:
    for name, df in output_manifests(kept).items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
