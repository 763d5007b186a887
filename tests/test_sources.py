"""Readers and writers on small files."""

import io
import struct
import wave
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftworks.operators import images, signals
from siftworks.sinks import datasets
from siftworks.sinks import media as media_sinks
from siftworks.sources import annotations as an
from siftworks.sources import corpora, media, records


def write(path, text, mode="w", **kw):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode, **kw) as fh:
        fh.write(text)
    return str(path)


def test_csv_and_empty_csv(spark, tmp_path):
    df = records.read_csv(spark, write(tmp_path / "a.csv", 'id,name\n1,"x, y"\n2,z\n'))
    assert dict(df.dtypes) == {"id": "int", "name": "string"} and df.count() == 2
    with pytest.raises(records.RecordError):
        records.read_csv(spark, write(tmp_path / "b.csv", "id,name\n"))


def test_json_lines_limits(spark, tmp_path):
    rec, report = records.read_json_lines(spark, write(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2, "b": {"c": [1, 2]}}\nnope\n'))
    assert (report.total, report.invalid, report.first_invalid) == (3, 1, ["nope"])
    assert records.structured(rec).count() == 2
    for bad in ('{"a": 1}\nx\ny\n', "[1]\n[2]\n", "x\n"):
        with pytest.raises(records.RecordError):
            records.read_json_lines(spark, write(tmp_path / "b.jsonl", bad))


def test_json_record_lists(spark, tmp_path):
    one = write(tmp_path / "one.json", '{"meta": 1, "data": {"rows": [{"x": 1}, {"x": 2}]}}')
    assert records.structured(records.read_json_records(spark, one)).agg(F.sum("x")).first()[0] == 3
    assert records.read_json_records(spark, one, "data.rows").count() == 2
    root = write(tmp_path / "root.json", '[{"x": 1}]')
    assert records.read_json_records(spark, root).count() == 1
    single = write(tmp_path / "single.json", '{"x": 1, "y": {"z": [1]}}')
    assert records.read_json_records(spark, single).count() == 1
    two = write(tmp_path / "two.json", '{"a": [{"x": 1}, {"x": 2}], "b": [{"x": 1}, {"x": 2}]}')
    for path, at in ((two, ""), (one, "data.none"), (one, "meta"), (single, "y.z")):
        with pytest.raises(records.RecordError):
            records.read_json_records(spark, path, at)


def test_xml_and_yaml_records(spark, tmp_path):
    xml = write(tmp_path / "r.xml", '<all><rec id="1"><n>5</n><t>a</t><t>b</t></rec><rec id="2"><n>6</n></rec></all>')
    df = records.read_xml_records(spark, xml, "rec")
    assert {"@id", "n", "t"} <= set(df.columns) and df.agg(F.sum("n")).first()[0] == 11
    yml = write(tmp_path / "r.yaml", "items:\n  - {k: 1, tags: [a, b]}\n  - {k: 2}\n")
    flat = records.flatten(records.structured(records.read_yaml_records(spark, yml)))
    assert sorted((r["k"], r["tags"], r["tags.count"]) for r in flat.collect()) == [(1, "a|b", 2), (2, None, None)]


def test_structure_profile(spark):
    docs = ['{"a": 1, "b": {"c": [1, 2], "d": null}}', '{"a": "x", "b": {"c": [], "d": 2}}', '{"a": 3}']
    p = records.structure_profile(spark.createDataFrame([(d,) for d in docs], "j string"), "j").first()
    assert (p["record_count"], p["max_nesting_depth"], p["schema_variant_count"]) == (3, 3, 3)
    assert (p["array_field_count"], p["object_field_count"], p["type_inconsistency_count"]) == (1, 1, 1)


def test_encodings_folders_and_hidden_files(spark, tmp_path):
    for name, raw in {"pos/a.txt": "café\r\nx".encode(), "pos/b.txt": "“q”".encode("cp1252"), "neg/c.txt": b"\xef\xbb\xbfbom", "neg/.hidden.txt": b"no", "top.txt": b"   "}.items():
        write(tmp_path / "d" / name, raw, "wb")
    files = corpora.read_files(spark, str(tmp_path / "d"), "*.txt")
    assert {r["document_path"]: r["text"] for r in corpora.plain_corpus(files).collect()} == {"pos/a.txt": "café\nx", "pos/b.txt": "“q”", "neg/c.txt": "bom"}
    assert {(r["document_id"], r["label"]) for r in corpora.class_folder_corpus(files).collect()} == {("pos/a.txt", "pos"), ("pos/b.txt", "pos"), ("neg/c.txt", "neg")}


def test_zip_members(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n in ("root/a.txt", "root/sub/b.txt", "__MACOSX/x", "root/.ds"):
            z.writestr(n, n)
    files = corpora.zip_members(spark.createDataFrame([("z.zip", bytearray(raw.getvalue())), ("bad.zip", bytearray(b"oops"))], "path string, content binary"))
    assert files.filter("status <> 'ok'").count() == 1
    ok = corpora.single_root(files.filter("status = 'ok'"))
    assert sorted(r["path"] for r in ok.collect()) == ["a.txt", "sub/b.txt"]


def test_conll_kinds(spark):
    files = spark.createDataFrame([("n.conll", "# c\nNew B-LOC\nYork I-LOC\n\nis O\n"), ("p.conll", "dogs x NNS\nrun x VB\n\n\n\nfast x RB")], "path string, value string")
    got = {r["document_id"]: (r["text"], r["kind"]) for r in corpora.conll_sentences(files).collect()}
    assert got == {"n.conll#s0": ("New York", "ner"), "n.conll#s1": ("is", "ner"), "p.conll#s0": ("dogs run", "pos"), "p.conll#s1": ("fast", "pos")}


def test_coco_voc_yolo_give_the_same_boxes(spark, tmp_path):
    coco = write(tmp_path / "coco.json", '{"images": [{"id": 1, "file_name": "a.png", "width": 100, "height": 80}], "categories": [{"id": 3, "name": "cat"}], "annotations": ['
                 '{"id": 1, "image_id": 1, "category_id": 3, "bbox": [10, 10, 20, 30]}, {"id": 2, "image_id": 1, "category_id": 9, "bbox": [0, 0, 5, 5]}, {"id": 3, "image_id": 1, "category_id": 3, "bbox": [200, 0, 5, 5]}]}')
    b = {r["box_index"]: r for r in an.coco_boxes(*an.read_coco(spark, coco)).collect()}
    assert (b[1]["x1"], b[1]["y1"], b[1]["x2"], b[1]["y2"], b[1]["status"]) == (10, 10, 30, 40, "ok")
    assert (b[2]["status"], b[3]["status"]) == ("unmapped_class", "invalid_box")
    images_ = spark.createDataFrame([("img/A.png", 100, 80)], "path string, width int, height int")
    write(tmp_path / "voc" / "a.xml", "<annotation><filename>a.png</filename><size><width>0</width><height>0</height></size><object><name>cat</name><bndbox><xmin>10</xmin><ymin>10</ymin><xmax>30</xmax><ymax>400</ymax></bndbox></object>"
          "<object><name>cat</name><bndbox><xmin>9</xmin><ymin>1</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    v = {r["box_index"]: r for r in an.voc_boxes(an.read_voc(spark, str(tmp_path / "voc")), images_).collect()}
    assert (v[0]["y2"], v[0]["status"], v[1]["status"]) == (80, "ok", "invalid_box")
    write(tmp_path / "yolo" / "a.txt", "0 0.2 0.3125 0.2 0.375\n7 0.5 0.5 0.1 0.1\n0 2 0.5 0.1 0.1\nx y\n")
    write(tmp_path / "yolo" / "classes.txt", "cat\n")
    classes = spark.createDataFrame([(0, "cat")], "id int, name string")
    y = {r["box_index"]: r for r in an.yolo_boxes(an.read_yolo_lines(spark, str(tmp_path / "yolo")), images_, classes).collect()}
    assert np.allclose([y[0][c] for c in an.BOX], [10, 10, 30, 40])
    assert (y[1]["status"], y[2]["status"], len(y)) == ("unmapped_class", "invalid_box", 3)


def png(path, rows):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\x00" + bytes(r) for r in rows)
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    write(path, b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""), "wb")


def test_images_profile_and_standardise(spark, tmp_path):
    root = tmp_path / "img"
    png(root / "a" / "x.png", [[10 * (i + j) for j in range(8)] for i in range(6)])
    png(root / "b" / "y.png", [[200] * 4 for _ in range(4)])
    write(root / "b" / "broken.png", b"not an image", "wb")
    df = media.read_images(spark, str(root))
    p = images.image_profile(df).first()
    assert (p["n_images"], p["n_corrupt"], p["n_valid"], p["max_width"], p["has_small_images"]) == (3, 1, 2, 8, True)
    want = np.mean([np.mean([10 * (i + j) for i in range(6) for j in range(8)]) / 255, 200 / 255])
    assert abs(p["avg_brightness"] - want) < 1e-9
    spec = images.ImageSpec(resize=4, color_mode="grayscale", histogram_eq=True, denoise=True, sharpen=True)
    px = {r["path"]: np.array(r["pixels"]) for r in images.standardized(df, spec).collect()}
    assert px["a/x.png"].shape == (16,) and abs(px["a/x.png"].mean()) < 1e-9 and np.allclose(px["b/y.png"], 0)
    media_sinks.write_images(df, images.ImageSpec(resize=4, color_mode="rgb", normalization="minmax"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "images")).select(F.max(F.size("pixels"))).first()[0] == 48


def wav(path, samples, rate=8000, channels=1):
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    write(path, buf.getvalue(), "wb")


def test_audio_profile_and_features(spark, tmp_path):
    t = np.arange(8000) / 8000
    root = tmp_path / "aud"
    wav(root / "tone" / "a.wav", 0.5 * np.sin(2 * np.pi * 440 * t))
    wav(root / "quiet" / "b.wav", np.zeros(4000))
    wav(root / "loud" / "c.wav", np.clip(3 * np.sin(2 * np.pi * 100 * t), -1, 1))
    write(root / "loud" / "d.wav", b"broken", "wb")
    df = media.read_audio(spark, str(root)).persist()
    p = signals.audio_profile(df).first()
    assert (p["n_files"], p["n_corrupt"], p["n_silent"], p["n_clipped"]) == (4, 1, 1, 1) and abs(p["total_duration"] - 2.5) < 1e-9
    ok = df.filter("status = 'ok'")
    f = {r["label"]: np.array(r["x"]) for r in ok.select("label", signals.time_spectral_features(F.col("samples"), F.col("sample_rate")).alias("x")).collect()}
    assert f["tone"].shape == (18,) and abs(f["tone"][0] - 1.0) < 1e-9 and abs(f["tone"][8] * 8000 - 440) < 60
    assert signals.log_mel(0.5 * np.sin(2 * np.pi * 440 * t), 8000, 48).shape[1] == 48
    for col, size in ((signals.pooled_spectrum(F.col("samples"), F.col("sample_rate"), "mfcc"), 80), (signals.speaker_embedding(F.col("samples"), F.col("sample_rate")), 192)):
        assert {r[0] for r in ok.select(F.size(col)).collect()} == {size}
    trimmed = spark.createDataFrame([([0.0, 0.0, 0.9, -0.8, 0.0, 0.7, 0.0],)], "y array<double>").select(signals.trim_silence(F.col("y"))).first()[0]
    assert trimmed == [0.9, -0.8, 0.0, 0.7]


def test_dct_is_orthonormal():
    x = np.eye(12)
    d = signals.cosine_transform(x, 12)
    assert np.allclose(d @ d.T, np.eye(12))


def test_text_writers_and_unique_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "My Doc", "Hello   WORLD", "a"), (2, "My Doc", "x", "a"), (3, "My Doc", "y", "b")], "id int, name string, text string, label string")
    names = datasets.unique_names(df, "name", "id", "label")
    assert sorted((r["id"], r["file_name"]) for r in names.collect()) == [(1, "My_Doc"), (2, "My_Doc_1"), (3, "My_Doc")]
    datasets.write_processed_text(df, ["text"], str(tmp_path / "t"), "csv")
    assert sorted(r["text_processed"] for r in spark.read.option("header", True).csv(str(tmp_path / "t")).collect()) == ["hello world", "x", "y"]
    datasets.write_corpus(df, "id", "name", "text", "label", str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c" / "documents")).filter("label = 'a'").count() == 2
