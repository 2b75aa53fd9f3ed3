from __future__ import annotations

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from labelkit.functions.arrays import fix_length, zscore_array
from labelkit.operators import audio, images
from labelkit.operators.bounded import local_table
from labelkit.sinks import writers
from labelkit.sources import columns, datasets, files


def png(width, height, rgb=(10, 20, 30)):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    line = b"\0" + bytes(rgb) * width
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(line * height)) + chunk(b"IEND", b"")


def webp(*chunks, size=None):
    body = b"WEBP" + b"".join(kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2) for kind, data in chunks)
    return b"RIFF" + struct.pack("<I", len(body) if size is None else size) + body


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("img")
    for name, body in {
        "gore/a.PNG": png(4, 3),
        "safe/b.png": png(2, 2, (255, 0, 0)),
        "safe/deep/d.png": png(6, 6),
        "zzz/c.gif": png(2, 2),
        "safe/bad.jpg": b"notanimage",
        "safe/n.txt": b"text",
        "safe/w.webp": webp((b"VP8 ", b"abc")),
        "safe/fake.webp": b"nothing here",
        "top.png": png(1, 1),
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return str(root)


def _names(df):
    return {r.path.rsplit("/", 1)[-1] for r in df.select("path").collect()}


def test_flat_scan(spark, tree):
    got = {(r.path.rsplit("/", 1)[-1], r.folder) for r in files.scan_folder(spark, tree).collect()}
    assert got == {("a.PNG", "gore"), ("b.png", "safe"), ("bad.jpg", "safe")}


def test_recursive_scan_labels_by_the_top_folder(spark, tree):
    got = {(r.path.rsplit("/", 1)[-1], r.folder) for r in files.scan_folder(spark, tree, files.MAPPED_IMAGES, True).collect()}
    assert got == {
        ("a.PNG", "gore"), ("b.png", "safe"), ("d.png", "safe"), ("c.gif", "zzz"), ("bad.jpg", "safe"),
        ("w.webp", "safe"), ("fake.webp", "safe"),
    }


def test_scans_list_folders_and_open_no_file(spark, tree, tmp_path, monkeypatch):
    from pathlib import Path
    from shutil import copytree

    tree = copytree(tree, str(tmp_path / "tree"))
    for name in ("gore/_hidden.png", "gore/.x.png", "_odd/e.png", "_odd/.deep/f.png", "gore/in/_ner/g.png", "gore/in/h.png"):
        (Path(tree) / name).parent.mkdir(parents=True, exist_ok=True)
        (Path(tree) / name).write_bytes(b"x")
    (Path(tree) / "gore/empty.png").write_bytes(b"")
    for recursive in (False, True):
        scan = files.scan_folder(spark, f"file://{tree}/", recursive=recursive)
        assert "binaryFile" not in scan._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, scan.collect()))
        monkeypatch.setattr(files, "_listed", None)
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
        plain = reader.load(tree if recursive else f"{tree}/*/*").select("path")
        monkeypatch.setattr(files, "_files", lambda *_: plain)
        assert got == sorted(map(tuple, files.scan_folder(spark, tree, recursive=recursive).collect()))
        monkeypatch.undo()


def test_unlabelled_scan_does_not_read_contents(spark, tree):
    found = files.scan_files(spark, tree)
    assert _names(found) == {"a.PNG", "b.png", "d.png", "bad.jpg", "w.webp", "fake.webp", "top.png"}
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_resolve_inputs(spark, tree, tmp_path):
    listing = tmp_path / "in.json"
    listing.write_text(json.dumps([{"image_path": "x.png", "labels": "A"}, {"image_path": "y.png"}]))
    assert _names(files.resolve_inputs(spark, f"{tree}/safe/b.png")) == {"b.png"}
    assert _names(files.resolve_inputs(spark, str(listing))) == {"x.png", "y.png"}
    assert files.resolve_inputs(spark, tree).count() == 7
    for bad in (f"{tree}/safe/n.txt", f"{tree}/none"):
        with pytest.raises(ValueError):
            files.resolve_inputs(spark, bad)


def test_valid_images(spark, tree):
    assert _names(images.valid_images(spark, tree)) == {"a.PNG", "b.png", "d.png", "c.gif", "w.webp", "top.png"}


def test_webp_chunks(spark):
    pixels, extra = (b"VP8L", b"odd"), (b"EXIF", b"even")
    cases = {
        "one": (webp(pixels), True),
        "several": (webp((b"VP8X", b"0123456789"), (b"ANMF", b"ab"), extra), True),
        "bytes after it": (webp(pixels) + b"tail", True),
        "last pad missing": (webp(pixels, size=4 + 8 + 3)[:-1], True),
        "no pixels": (webp(extra), False),
        "cut": (webp(extra, pixels)[:-3], False),
        "chunk beyond the end": (webp(pixels)[:16] + struct.pack("<I", 999) + b"odd\0", False),
        "head only": (b"RIFF\0\0\0\0WEBPVP8 ", False),
        "other kind": (webp(pixels).replace(b"WEBP", b"WAVE"), False),
        "empty": (b"", False),
        "null": (None, False),
    }
    rows = spark.createDataFrame([(n, body) for n, (body, _) in cases.items()], "name string, content binary")
    got = {r.name: r.ok for r in rows.select("name", images.is_webp("content").alias("ok")).collect()}
    assert got == {n: ok for n, (_, ok) in cases.items()}


def test_written_png_files_decode_to_their_pixels(spark, tmp_path):
    pixels = [[(i * 37 + k) % 256 for i in range(3 * 4 * 5)] for k in range(3)]
    rows = [("a/0.png", 4, 5, pixels[0]), ("a/b/1.png", 5, 4, pixels[1]), ("2.png", 1, 20, pixels[2]), ("3.png", 2, 2, [1, 2, 3]),
            ("4.png", 1, 1, None), (None, 1, 1, [1, 2, 3])]
    made = spark.createDataFrame(rows, "path string, w int, h int, p array<int>")
    made = made.select("path", images.encode_png("w", "h", "p").alias("content"))
    root = str(tmp_path / "out")
    assert writers.write_files(made, root) == 3 == writers.write_files(made, f"file://{root}/")  # a second run replaces
    read = {r.path.rsplit("/", 1)[-1]: r.image for r in images.read_images(spark, root).collect()}
    assert sorted(read) == ["0.png", "1.png", "2.png"]
    for name, w, h, k in (("0.png", 4, 5, 0), ("1.png", 5, 4, 1), ("2.png", 1, 20, 2)):
        image = read[name]
        rgb = [v for i in range(0, len(image.data), 3) for v in reversed(image.data[i:i + 3])]
        assert (image.width, image.height, rgb) == (w, h, pixels[k])


def test_image_profile_and_features(spark, tree):
    read = images.read_images(spark, tree).withColumn("folder", F.element_at(F.split(files.path_below("path", tree), "/"), 1))
    rows = {r.folder: r for r in images.image_profile(read, "folder").collect()}
    assert (rows["safe"].n, rows["safe"].min_width, rows["safe"].max_height, rows["safe"].channels) == (2, 2, 6, [3])
    made = {r.path.rsplit("/", 1)[-1]: r.features for r in images.image_features(read, 2).collect()}
    assert all(len(v) == 12 for v in made.values())
    red = [(v / 255 - m) / s for v, m, s in zip((255, 0, 0), images.CHANNEL_MEAN, images.CHANNEL_STD)]
    assert made["b.png"] == pytest.approx([c for c in red for _ in range(4)], abs=1e-5)
    small = made["top.png"]
    assert sum(abs(v - (0 - images.CHANNEL_MEAN[0]) / images.CHANNEL_STD[0]) > 1e-5 for v in small[:4]) == 1


def test_uri_folder(one):
    for uri, want in {"http://a.b/en/1?x": "en", "http://a.b/?q": "", "http://a.b": ""}.items():
        assert one(files.uri_folder("u"), u=(uri, "string")) == want


CSV = 'question,prompt,response,extra\n"q, 1","line one\nline two","[3, 7]@ confidence 80%",z\nq2,"say ""hi""",,z\n'


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    rows = files.read_examples_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [
        ("line one\nline two", "q, 1", "[3, 7]@ confidence 80%"), ('say "hi"', "q2", None),
    ]
    assert files.drop_incomplete(files.read_examples_csv(spark, str(path)), ["response"]).count() == 1
    with pytest.raises(columns.MissingColumns, match="label"):
        files.read_examples_csv(spark, str(path), files.INTENT_COLUMNS)
    landed = files.land(files.read_examples_csv(spark, str(path)), str(tmp_path / "landed"), 2)
    assert landed.count() == 2 and landed.columns == ["prompt", "question", "response"]


def test_columns(spark):
    df = spark.createDataFrame([("", "b", 1)], "transcript string, sentence string, speech int")
    assert columns.first_existing(df) == "speech"
    assert df.select(columns.reference_text(df).alias("r")).first().r == "b"
    assert df.select(columns.reference_text(df, ["text"]).alias("r")).first().r is None
    with pytest.raises(columns.MissingColumns):
        columns.first_existing(df, ["audio"])
    assert columns.tag_source(df, lang="en").first().lang == "en"


def test_named_splits(spark, tmp_path):
    rows = [(i, "cv", c, s) for i in range(20) for c in ("en", "fr") for s in ("train", "test")]
    table = spark.createDataFrame(rows, "id int, dataset string, config string, split string")
    table.write.partitionBy("dataset", "config", "split").parquet(str(tmp_path / "t"))
    part = datasets.read_split(spark, str(tmp_path / "t"), "cv", "test[:10]", "en", "id")
    assert [r.id for r in part.orderBy("id").collect()] == list(range(10))
    assert "PartitionFilters" in part._jdf.queryExecution().toString()
    assert datasets.read_split(spark, str(tmp_path / "t"), "cv", "test").count() == 40
    assert datasets.parse_slice("test.other[:10]") == ("test.other", 10)
    with pytest.raises(ValueError):
        datasets.parse_slice("test[5:]")
    with pytest.raises(ValueError):
        datasets.read_split(spark, str(tmp_path / "t"), "cv", "test[:10]", "en")


def test_many_sources(spark):
    def broken():
        raise OSError("gone")

    readers = {
        "en": lambda: spark.range(3),
        "xx": broken,
        "fr": lambda: spark.range(2),
        "empty": lambda: spark.range(0),
        "odd": lambda: spark.range(1).withColumnRenamed("id", "other"),
    }
    df, status = datasets.read_many(spark, readers, ["id"])
    assert {r.source_name: r["count"] for r in df.groupBy("source_name").count().collect()} == {"en": 3, "fr": 2}
    states = {r.name: (r.status, r.error) for r in status.collect()}
    assert states["en"] == ("loaded", None) and states["xx"] == ("failed", "gone")
    assert states["empty"][0] == states["odd"][0] == "failed"
    with pytest.raises(OSError):
        datasets.read_many(spark, readers, ["id"], on_error="raise")
    nothing, status = datasets.read_many(spark, {"xx": broken})
    assert nothing is None and status.count() == 1
    first = datasets.read_with_fallback([broken, lambda: spark.range(0), lambda: audio.synthetic_noise(spark, 2, 8)])
    assert first.count() == 2
    with pytest.raises(OSError):
        datasets.read_with_fallback([broken])


def test_noise_is_the_same_after_a_retry(spark):
    read = lambda n: {r.id: r.audio.array for r in audio.noise_rows(spark.range(20).repartition(n), "id", 50).collect()}
    a, b = read(2), read(7)
    assert a == b and len(a[0]) == 50 and a[0] != a[1]
    flat = [v for w in a.values() for v in w]
    assert abs(sum(flat) / len(flat)) < 0.02 and 0.08 < (sum(v * v for v in flat) / len(flat)) ** 0.5 < 0.12


def test_augment(spark):
    df = spark.range(200).select("id", F.array_repeat(F.lit(0.5), 20).alias("w"), F.when(F.col("id") < 150, "train").otherwise("val").alias("split"))
    made = audio.augment(df, "w", "id", where=F.col("split") == "train").collect()
    assert {r.augmentation for r in made if r.split == "val"} == {"none"}
    kinds = [r.augmentation for r in made if r.split == "train"]
    assert set(kinds) == {"none", *audio.AUGMENTATIONS} and 0.3 < kinds.count("none") / 150 < 0.7
    for r in made:
        assert len(r.augmented) == 20 and max(abs(v) for v in r.augmented) <= 1.0
        if r.augmentation in ("none", "speed"):
            assert r.augmented == [0.5] * 20
        if r.augmentation == "time_shift":
            assert r.augmented.count(0.0) == abs(r["shift"]) <= 4
        assert (r.speed is not None) == (r.augmentation in ("speed", "all"))


def test_standardised_waves_equal_the_column_form(spark):
    rows = [(1, [1.0, 2.0, 4.0]), (2, []), (3, None), (4, [5.0])]
    df = spark.createDataFrame(rows, "id int, w array<float>").repartition(1)
    made = audio.standardise_waves(df, "w", 5, dtype="double").select("id", "w", "input_values", zscore_array(fix_length("w", 5)).alias("want"))
    got = {r.id: r for r in made.collect()}
    assert got[3].input_values is None and got[3].w is None
    for i in (1, 2, 4):
        assert got[i].input_values == pytest.approx(got[i].want)
    free = {r.id: r.input_values for r in audio.standardise_waves(df, "w").collect()}
    assert [len(free[i]) for i in (1, 2, 4)] == [3, 0, 1] and free[3] is None


def test_rate_check(spark):
    df = spark.createDataFrame([(16000,), (8000,), (8000,)], "sampling_rate int")
    assert [tuple(r) for r in audio.rate_check(df, "sampling_rate").collect()] == [(8000, 2)]


# -- sinks -------------------------------------------------------------------------------------


def test_label_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a.png", ["A", "B"], "train"), ("b.png", [], "val")], "image_path string, labels array<string>, split string")
    writers.write_label_json(df, str(tmp_path / "ds"))
    back = spark.read.json(str(tmp_path / "ds"))
    assert {(r.image_path, r.labels, r.split) for r in back.collect()} == {("a.png", "A, B", "train"), ("b.png", "", "val")}
    array = tmp_path / "array.json"
    array.write_text(json.dumps([{"image_path": "a.png", "labels": "A, B"}], indent=2))
    assert tuple(files.read_label_json(spark, str(array)).first()) == ("a.png", "A, B")


def test_run_report(spark, tmp_path):
    one = spark.range(1).select(*writers.run_report(F.lit("base"), F.lit("compiled"), F.lit(0.5), F.lit("text")))
    writers.write_run_report(one, str(tmp_path / "report"))
    got = spark.read.json(str(tmp_path / "report")).first()
    assert (got.base_prompt, got.compiled_prompt, got.accuracy, got.performance.report) == ("base", "compiled", 0.5, "text")
    assert got.date_generated.startswith("20")


def test_prompt_file(spark, tmp_path):
    target = writers.write_prompt(spark, "line one\nline two", str(tmp_path / "new" / "folder"))
    assert "optimized_prompt_" in target
    assert [r.value for r in spark.read.text(target, wholetext=True).collect()] == ["line one\nline two\n"]


def test_metric_rules_and_prediction_sinks(spark, tmp_path):
    per_class = spark.createDataFrame([("en", 0.5, 4)], "label string, accuracy double, count bigint")
    rows = writers.class_metric_rows(per_class, ["accuracy", "count"], "test")
    writers.write_metrics(rows, str(tmp_path / "m"))
    writers.write_metrics(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    writers.write_rules(local_table(spark, {"rule_id": ["a"]}, "rule_id string"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    preds = spark.createDataFrame([("a", "OK"), ("b", "ERROR")], "image_path string, status string")
    writers.write_predictions(preds, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("status = 'ERROR'").first().image_path == "b"
