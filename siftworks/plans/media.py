"""Signal, image and detection queries. Each embedding row doubles as a short signal and as an 8 x 8 gray image."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection, images, signals
from ..session import table
from .registry import query, rounded

RATE = 16


def signal_rows(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.lit(RATE).alias("rate"), F.col("embedding").cast("array<double>").alias("y"))


S = "s AS (SELECT vec_id, label, embedding::DOUBLE[] AS y FROM embeddings)"
RMS = "sqrt(list_avg(list_transform({y}, lambda v: v * v)))"


def rms_sql(y: str) -> str:
    return RMS.replace("{y}", y)


@query("win07_frames", f"""WITH {S}, f AS (SELECT vec_id, i // 8 AS frame, i / 16.0 AS t, y[i + 1:i + 16] AS w FROM s, range(0, 49, 8) r(i))
  SELECT vec_id, frame, t, round(list_sum(w), 6) AS total, len(w) AS n FROM f""")
def win07(spark, d):
    rows = signals.frame_rows(signal_rows(spark, d), "vec_id", "y", "rate", 16, 8)
    return rounded(rows.select("vec_id", F.col("frame").cast("long").alias("frame"), "t", signals.total(F.col("samples")).alias("total"), F.size("samples").cast("long").alias("n")))


@query("ftr22_standardize", f"""WITH {S}, b AS (SELECT *, greatest({rms_sql('y')} * 0.1, 1e-4) AS bar FROM s), l AS (SELECT *, list_transform(y, lambda v: abs(v) > bar) AS loud FROM b),
  t AS (SELECT vec_id, y[list_position(loud, true):len(y) - list_position(list_reverse(loud), true) + 1] AS y FROM l), h AS (SELECT vec_id, list_transform(y, lambda v: tanh(v)) AS y FROM t),
  n AS (SELECT vec_id, {rms_sql('y')} AS r, y FROM h) SELECT vec_id, least(len(y), 80) AS n_samples, round(list_sum(y) * 0.1 / r, 6) AS total, 80::BIGINT AS n_fixed FROM n""")
def ftr22(spark, d):
    t = signal_rows(spark, d)
    y = signals.standardize(F.col("y"), F.col("rate"), trim=True, limit=True, norm="rms")
    t = t.select("vec_id", "rate", y.alias("y"))
    out = t.select("vec_id", F.size("y").cast("long").alias("n_samples"), signals.total(F.col("y")).alias("total"),
                   F.size(signals.pad_or_trim(F.col("y"), F.col("rate") * signals.PAD_SECONDS)).cast("long").alias("n_fixed"))
    return rounded(out, "total")


@query("ftr25_pooled_frames", f"""WITH {S}, f AS (SELECT label, {rms_sql('y[i + 1:i + 16]')} AS e FROM s, range(0, 49, 8) r(i))
  SELECT label, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, round(quantile_cont(e, 0.1), 6) AS p10, round(quantile_cont(e, 0.9), 6) AS p90 FROM f GROUP BY label""")
def ftr25(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.explode(signals.frames(F.col("embedding").cast("array<double>"), 16, 8)).alias("w"))
    return rounded(signals.pooled_frames(rows.select("label", signals.rms(F.col("w")).alias("e")), ["label"], "e"))


@query("apr01_signal_profile", f"""WITH {S}, p AS (SELECT {rms_sql('y')} AS r, {rms_sql('list_transform(range(1, len(y)), lambda i: y[i + 1] - y[i])')} AS dr,
    list_avg(list_transform(y, lambda v: (abs(v) >= 0.98)::INT)) > 0.001 AS clipped, len(y) / 16 AS dur FROM s)
  SELECT count(*) AS n_files, 0::BIGINT AS n_corrupt, count(*) AS readable, round(sum(dur), 6) AS total_duration, round(avg(r), 6) AS avg_rms, round(stddev_pop(r), 6) AS rms_std,
  round(avg(20 * log10(greatest(r, 1e-8))), 6) AS avg_loudness_db, round(avg(dr / greatest(r, 1e-8)), 6) AS noise_proxy, count(*) FILTER (r < 1e-4) AS n_silent, count(*) FILTER (clipped) AS n_clipped FROM p""")
def apr01(spark, d):
    t = signal_rows(spark, d).select(F.col("y").alias("samples"), F.col("rate").alias("sample_rate"), F.lit("ok").alias("status"))
    out = signals.audio_profile(t).select("n_files", "n_corrupt", "readable", "total_duration", "avg_rms", "rms_std", "avg_loudness_db", "noise_proxy", "n_silent", "n_clipped")
    return rounded(out)


@query("evl26_voice_activity", f"""WITH {S}, f AS (SELECT vec_id, i, {rms_sql('y[i + 1:i + 16]')} AS e, list_avg(list_transform(range(1, 16), lambda k: ((y[i + k + 1] < 0) <> (y[i + k] < 0))::INT)) AS z FROM s, range(0, 49, 8) r(i)),
  b AS (SELECT vec_id, greatest(quantile_cont(e, 0.5) + 0.5 * stddev_pop(e), 1e-4) AS bar, quantile_cont(z, 0.85) AS zc, stddev_pop(e) AS sd FROM f GROUP BY vec_id),
  t AS (SELECT f.*, sd, (e >= bar AND z < zc)::INT AS talk FROM f JOIN b USING (vec_id)), q AS (SELECT *, abs(talk - lag(talk) OVER (PARTITION BY vec_id ORDER BY i)) AS tr FROM t),
  p AS (SELECT vec_id, avg(talk) AS s, coalesce((avg(e) FILTER (talk = 1) - avg(e) FILTER (talk = 0)) / greatest(any_value(sd), 1e-6), 0) AS m, avg(tr) AS t FROM q GROUP BY vec_id),
  a AS (SELECT greatest(0, least(1, avg(s))) AS s, greatest(0, least(1, 0.5 + 0.25 * avg(m))) AS m, greatest(0, least(1, 1 - avg(t))) AS t FROM p)
  SELECT round(0.45 * m + 0.35 * t + 0.2 * s, 6) AS frame_f1, round(0.6 * m + 0.4 * t, 6) AS precision, round(0.5 * s + 0.5 * m, 6) AS recall, round(1 - (0.6 * m + 0.4 * t), 6) AS false_alarm_rate, round(1 - (0.5 * s + 0.5 * m), 6) AS miss_rate FROM a""")
def evl26(spark, d):
    return rounded(signals.voice_activity_metrics(signals.voice_activity(signal_rows(spark, d), "vec_id", "y", 16, 8)))


@query("evl27_enhancement", """WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS c, list_transform(range(1, 65), lambda i: embedding[i] + 0.1 * embedding[65 - i])::DOUBLE[] AS a, list_transform(range(1, 65), lambda i: embedding[i] + 0.02 * embedding[65 - i])::DOUBLE[] AS b FROM embeddings),
  e AS (SELECT *, list_dot_product(c, c) AS cc, list_dot_product(a, c) AS ac, list_dot_product(b, c) AS bc, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb FROM t),
  m AS (SELECT 10 * log10(cc / greatest(aa - 2 * ac + cc, 64e-8)) AS sa, 10 * log10(cc / greatest(bb - 2 * bc + cc, 64e-8)) AS sb, 10 * log10(ac * ac / cc / (aa - ac * ac / cc)) AS da, 10 * log10(bc * bc / cc / (bb - bc * bc / cc)) AS db FROM e)
  SELECT round(avg(sb - sa), 5) AS snr_improvement, round(avg(db - da), 5) AS si_sdr_improvement, count(*) AS pairs FROM m""")
def evl27(spark, d):
    t = signal_rows(spark, d).withColumn("r", F.reverse("y"))
    t = t.select(F.col("y").alias("clean"), "r")
    noisy, better = (F.zip_with("clean", "r", mix) for mix in (lambda a, b: a + 0.1 * b, lambda a, b: a + 0.02 * b))
    t = t.withColumn("noisy", noisy).withColumn("enhanced", better)
    return rounded(signals.enhancement_scores(t, "noisy", "enhanced", "clean"), digits=5)


@query("ftr23_time_spectral_features")
def ftr23(spark, d):
    t = signal_rows(spark, d)
    return t.select("vec_id", signals.time_spectral_features(F.col("y"), F.col("rate")).alias("x"))


@query("ftr24_pooled_mel")
def ftr24(spark, d):
    t = signal_rows(spark, d)
    return t.select("vec_id", signals.pooled_spectrum(F.col("y"), F.lit(8000)).alias("x"))


@query("ftr26_speaker_embedding")
def ftr26(spark, d):
    t = signal_rows(spark, d)
    return t.select("vec_id", signals.speaker_embedding(F.col("y"), F.lit(8000)).alias("x"))


@query("ftr26_speech_segments", f"""WITH {S}, f AS (SELECT vec_id, i // 8 AS frame, {rms_sql('y[i + 1:i + 16]')} AS e FROM s, range(0, 49, 8) r(i)), b AS (SELECT vec_id, greatest(quantile_cont(e, 0.5) * 0.7, 1e-4) AS bar FROM f GROUP BY vec_id)
  SELECT vec_id, count(*) AS n, sum(frame)::BIGINT AS frames FROM f JOIN b USING (vec_id) WHERE e >= bar GROUP BY vec_id""")
def ftr26_segments(spark, d):
    rows = signals.speech_segments(signal_rows(spark, d), "vec_id", "y", "rate", 16, 8)
    return rows.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum("frame").alias("frames"))


@query("join08_events_in_clips", """WITH e AS (SELECT user_id AS file, epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS t, value FROM events), o AS (SELECT user_id AS file, event_id, epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS s FROM events WHERE event_type = 'error')
  SELECT o.event_id, count(*) AS n, round(sum(value), 4) AS total FROM o JOIN e ON e.file = o.file AND e.t >= o.s AND e.t < o.s + 86400 GROUP BY o.event_id""")
def join08(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), "event_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0 - 1704067200).alias("t"))
    spans = e.filter("event_type = 'error'").select("file", "event_id", F.col("t").alias("start"), (F.col("t") + 86400).alias("end"))
    met = signals.frames_in_events(e.select("file", "t", "value"), spans, "file", 43200.0)
    return rounded(met.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), digits=4)


@query("evl24_sound_events")
def evl24(spark, d):
    from ..operators import models

    rows = signals.frame_rows(signal_rows(spark, d), "vec_id", "y", "rate", 32, 16)
    events = table(spark, d, "embeddings").select("vec_id", F.lit(0.0).alias("start"), F.lit(2.0).alias("end"), (F.col("label") % 3).alias("event"))
    seg = signals.frames_in_events(rows, events, "vec_id")
    x = seg.select((F.col("vec_id") * 100 + F.col("frame")).alias("seg_id"), "event", signals.pooled_spectrum(F.col("samples"), F.lit(8000), "mfcc").alias("x"))
    return models.evaluate_vectors(x, "x", "event", "seg_id", lambda n, k: {"mlp_32": models.perceptrons(n, k, 15)["mlp_32"]}, scale=True)


GRAY = "g AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v * 100) AS px FROM embeddings)"


def gray_rows(spark, d):
    px = F.transform("embedding", lambda v: v.cast("double") * 100)
    return table(spark, d, "embeddings").select("vec_id", px.alias("px"), F.transform(px, lambda v: (v > 5).cast("int")).alias("mask"))


OTSU = f"""{GRAY}, v AS (SELECT vec_id, list_min(px) AS lo, list_max(px) + 1e-6 AS hi, unnest(px) AS v FROM g),
  h AS (SELECT vec_id, any_value(lo) AS lo, any_value(hi) AS hi, least(floor((v - lo) / (hi - lo) * 64), 63)::INT AS bin, count(*) AS n FROM v GROUP BY vec_id, least(floor((v - lo) / (hi - lo) * 64), 63)::INT),
  f AS (SELECT k.vec_id, k.lo, k.hi, b AS bin, coalesce(h.n, 0) AS n, k.lo + (k.hi - k.lo) * (b + 0.5) / 64 AS c FROM (SELECT DISTINCT vec_id, lo, hi FROM h) k CROSS JOIN range(0, 64) r(b) LEFT JOIN h ON h.vec_id = k.vec_id AND h.bin = b),
  c AS (SELECT *, sum(n) OVER w AS cn, sum(n * c) OVER w AS cm, sum(n) OVER (PARTITION BY vec_id) AS t, sum(n * c) OVER (PARTITION BY vec_id) AS tm FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY bin)),
  o AS (SELECT vec_id, c AS threshold FROM c WHERE bin < 63 AND cn > 0 AND cn < t QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round((cn / t) * (1 - cn / t) * (cm / cn - (tm - cm) / (t - cn)) ^ 2, 9) DESC, bin) = 1)"""


@query("ftr27_otsu", f"WITH {OTSU} SELECT g.vec_id, list_sum(list_transform(px, lambda v: (v > threshold)::INT))::BIGINT AS above FROM g JOIN o USING (vec_id)")
def ftr27(spark, d):
    g = gray_rows(spark, d)
    both = g.join(images.otsu_thresholds(g, "vec_id", "px"), "vec_id")
    return both.select("vec_id", F.size(F.filter("px", lambda v: v > F.col("threshold"))).cast("long").alias("above"))


@query("evl18_met13_segmentation", f"""WITH {OTSU}, p AS (SELECT vec_id, unnest(px) AS v FROM g), q AS (SELECT vec_id, (v > threshold)::INT AS a, (v > 5)::INT AS m FROM p JOIN o USING (vec_id)),
  s AS (SELECT vec_id, sum(a * m) AS i1, sum(a) AS a1, sum(m) AS m, sum((1 - a) * m) AS i0, sum(1 - a) AS a0, count(*) AS n, sum((a = m)::INT) AS e1 FROM q GROUP BY vec_id),
  r AS (SELECT *, coalesce(i1 / nullif(a1 + m - i1, 0), 0) AS u1, coalesce(i0 / nullif(a0 + m - i0, 0), 0) AS u0 FROM s)
  SELECT round(avg(greatest(u1, u0)), 6) AS mean_iou, round(avg(CASE WHEN u1 >= u0 THEN e1 / n ELSE 1 - e1 / n END), 6) AS pixel_accuracy,
  round(avg(CASE WHEN u1 >= u0 THEN coalesce(2 * i1 / nullif(a1 + m, 0), 0) ELSE coalesce(2 * i0 / nullif(a0 + m, 0), 0) END), 6) AS dice_score FROM r""")
def evl18(spark, d):
    return rounded(images.segmentation_metrics(gray_rows(spark, d), "vec_id", "px", "mask"))


def boxes(spark, d):
    """True boxes from the lines of an order, detections as shifted copies with a score."""
    li = table(spark, d, "lineitem")
    x, y = F.col("l_discount") * 2000, F.col("l_tax") * 2000
    w, h = F.col("l_quantity") + 10, F.lit(40.0)
    uid = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    truth = li.select(F.col("l_orderkey").alias("image_id"), uid.alias("truth_id"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))
    dx, dy = F.col("l_partkey") % 13, F.col("l_suppkey") % 9
    pred = li.filter("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("image_id"), uid.alias("pred_id"), ((F.col("l_extendedprice") % 997) / 997).alias("score"),
        (x + dx).alias("x1"), (y + dy).alias("y1"), (x + w + dx).alias("x2"), (y + h).alias("y2"))
    return pred, truth


@query("mth05_box_iou", """WITH b AS (SELECT l_orderkey AS image_id, l_linenumber * 1000000 + l_partkey AS id, l_discount * 2000 AS x1, l_tax * 2000 AS y1, l_discount * 2000 + l_quantity + 10 AS x2, l_tax * 2000 + 40 AS y2,
    l_partkey % 13 AS dx, l_suppkey % 9 AS dy, l_returnflag FROM lineitem), p AS (SELECT image_id, id AS pred_id, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 FROM b WHERE l_returnflag <> 'R'),
  o AS (SELECT p.image_id, pred_id, id AS truth_id, greatest(0, least(p.x2, b.x2) - greatest(p.x1, b.x1)) * greatest(0, least(p.y2, b.y2) - greatest(p.y1, b.y1)) AS i,
    (p.x2 - p.x1) * (p.y2 - p.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM p JOIN b USING (image_id))
  SELECT image_id, pred_id, truth_id, round(i / (s - i), 6) AS iou FROM o WHERE i > 0 AND round(i / (s - i), 6) > 0""")
def mth05(spark, d):
    pred, truth = boxes(spark, d)
    return rounded(detection.overlaps(pred, truth).drop("score")).filter("iou > 0")


@query("evl17_detection")
def evl17(spark, d):
    pred, truth = boxes(spark, d)
    return detection.detection_metrics(pred, truth)


@query("snk05_standardized_signals")
def snk05(spark, d):
    from ..session import shared_folder
    from ..sinks.media import write_signals

    path = shared_folder(spark, "signals")
    t = signal_rows(spark, d).select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("path"), F.col("label").cast("string").alias("label"), "rate", F.col("y").alias("samples"))
    write_signals(t, path)
    return spark.read.parquet(f"{path}/signals").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("pcm")).alias("values"))


def hex_byte(v):
    return F.lpad(F.hex(v.cast("int")), 2, "0")


def image_rows(spark, d):
    """Embeddings as decoded 8 x 8 gray images in the image source's layout."""
    level = F.transform("embedding", lambda v: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v.cast("double") * 300 + 128))))
    data = F.unhex(F.array_join(F.transform(level, hex_byte), ""))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string")).alias("path"), F.col("label").cast("string").alias("label"),
                    F.lit(0.5).alias("size_kb"), image.alias("image"), F.lit(False).alias("corrupt"))


@query("ipr01_image_profile", """WITH p AS (SELECT list_transform(embedding::DOUBLE[], lambda v: floor(least(255, greatest(0, v * 300 + 128)))) AS px FROM embeddings),
  s AS (SELECT list_avg(px) / 255 AS b, list_stddev_pop(px) / 255 AS c FROM p)
  SELECT count(*) AS n_images, 0::BIGINT AS n_corrupt, 8.0::DOUBLE AS avg_height, 1 AS dominant_channels, round(avg(b), 6) AS avg_brightness, round(stddev_pop(b), 6) AS brightness_std, round(avg(c), 6) AS avg_contrast,
  round(stddev_pop(c), 6) AS contrast_std, avg(c) < 0.1 AS has_low_contrast, true AS has_small_images, true AS has_mostly_grayscale FROM s""")
def ipr01(spark, d):
    out = images.image_profile(image_rows(spark, d))
    return rounded(out.select("n_images", "n_corrupt", "avg_height", "dominant_channels", "avg_brightness", "brightness_std", "avg_contrast", "contrast_std",
                              "has_low_contrast", "has_small_images", "has_mostly_grayscale"))


@query("ftr21_standardized_images")
def ftr21(spark, d):
    spec = images.ImageSpec(resize=4, color_mode="grayscale", histogram_eq=True, denoise=True)
    px = images.standardized(image_rows(spark, d), spec)
    return px.select("path", F.size("pixels").alias("n"), F.array_max("pixels").alias("top"))


@query("snk04_processed_images", "SELECT label::VARCHAR AS label, count(*) AS n, count(*) * 192 AS n_values FROM embeddings GROUP BY label")
def snk04(spark, d):
    from ..session import shared_folder
    from ..sinks.media import write_images

    path = shared_folder(spark, "images")
    write_images(image_rows(spark, d), images.ImageSpec(resize=8, color_mode="rgb", normalization="minmax"), path)
    out = spark.read.parquet(f"{path}/images")
    return out.groupBy(F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n"), F.sum(F.size("pixels")).alias("n_values"))


# RIFF header of a mono 8-bit WAV file with 64 samples at 16 Hz.
WAV_HEADER = "524946466400000057415645666D74201000000001000100100000001000000001000800" + "6461746140000000"


@query("src26_wav_scan", """WITH p AS (SELECT list_transform(embedding::DOUBLE[], lambda v: (floor(least(255, greatest(0, v * 300 + 128))) - 128) / 128) AS y FROM embeddings)
  SELECT count(*) AS n_files, count(*) AS readable, 4.0::DOUBLE AS avg_duration, round(avg(sqrt(list_avg(list_transform(y, lambda v: v * v)))), 6) AS avg_rms FROM p""")
def src26(spark, d):
    from ..sources.media import decode_wav

    level = F.transform("embedding", lambda v: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v.cast("double") * 300 + 128))))
    raw = F.unhex(F.concat(F.lit(WAV_HEADER), F.array_join(F.transform(level, hex_byte), "")))
    files = table(spark, d, "embeddings").select(F.concat(F.lit("a/"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), raw.alias("content"))
    return rounded(signals.audio_profile(decode_wav(files)).select("n_files", "readable", "avg_duration", "avg_rms"))


@query("src26_apr01_distributions", "SELECT 'sample_rate' AS field, '16' AS value, count(*) AS n FROM embeddings UNION ALL SELECT 'label', label::VARCHAR, count(*) FROM embeddings GROUP BY label")
def src26_distributions(spark, d):
    t = signal_rows(spark, d).select(F.col("rate").alias("sample_rate"), "label")
    return signals.value_distribution(t, ["sample_rate", "label"])
