"""CSV and JSON files read in splits of any size, against readers that take a file whole."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest

from labelkit.sources import files, pieces


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def set_to(size: int) -> None:
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)

    yield set_to
    for n, v in before.items():
        spark.conf.set(n, v)


def odd_text(rng: random.Random) -> str:
    parts = ["a", "é", " ", ",", '"', '""', "\n", "\n\n", "}", "{", "[", "]", "\\", '\\"', "word", "5\" disk", ",\n\""]
    return "".join(rng.choice(parts) for _ in range(rng.choice((0, 1, 3, 10, 40))))


@pytest.mark.parametrize(("size", "quoting"), [(700, csv.QUOTE_ALL), (700, csv.QUOTE_MINIMAL), (1 << 27, csv.QUOTE_MINIMAL)])
def test_csv_in_splits(spark, tmp_path, small_splits, size, quoting):
    rng = random.Random(size)
    want = []
    for name in ("a", "b"):
        out = io.StringIO(newline="")
        writer = csv.writer(out, quoting=quoting, lineterminator="\r\n" if name == "b" and quoting == csv.QUOTE_ALL else "\n")
        writer.writerow(["question", "extra", "prompt", "response"])
        for k in range(120):
            row = [f"{name}{k}", odd_text(rng).strip() or "x", odd_text(rng).strip() or "y", f"r{odd_text(rng)}r"]
            writer.writerow(row)
            want.append((row[2], row[0], row[3]))
        (tmp_path / f"{name}.csv").write_text(out.getvalue(), newline="")
    small_splits(size)
    got = files.read_examples_csv(spark, str(tmp_path))
    assert got.columns == ["prompt", "question", "response"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_csv_odd_files(spark, tmp_path, small_splits):
    small_splits(16)
    (tmp_path / "a.csv").write_text('﻿prompt,question,response\nit is 5" wide,b,"c\nd"\n\n,"",e\n', encoding="utf-8")
    got = [tuple(r) for r in files.read_examples_csv(spark, str(tmp_path)).collect()]
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    assert sorted(got, key=str) == sorted([tuple(r) for r in whole.collect()], key=str) and ('it is 5" wide', "b", "c\nd") in got
    (tmp_path / "b.csv").write_text("prompt,other,response\n1,2,3\n")
    with pytest.raises(Exception, match="header"):
        files.read_examples_csv(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(("size", "indent"), [(700, None), (700, 2), (1 << 27, None)])
def test_json_array_in_splits(spark, tmp_path, small_splits, size, indent):
    rng = random.Random(size)
    rows = [{"image_path": f"p{k}{odd_text(rng)}", "labels": odd_text(rng), "more": {"deep": [{"x": odd_text(rng)}, {"x": None}]}} for k in range(90)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:60], indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(rows[60:], indent=indent) + "\n")
    (tmp_path / "c.json").write_text("[]")
    small_splits(size)
    got = files.read_label_json(spark, str(tmp_path), "image_path string, labels string, more struct<deep: array<struct<x: string>>>").collect()
    assert sorted((r["image_path"], r["labels"], [d["x"] for d in r["more"]["deep"]]) for r in got) == sorted(
        (r["image_path"], r["labels"], [d["x"] for d in r["more"]["deep"]]) for r in rows
    )


def test_whole_records_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text("prompt,question,response\n" + "a,b,c\n" * 100)
    records = pieces.read_records(spark, str(tmp_path), pieces.csv_format())
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert records.count() == 101 and plan.count("Aggregate [file") <= 2
