"""Where results go. Every writer is a plain distributed write."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.functions.text import iso_stamp, join_labels, run_stamp


def write_label_json(df: DataFrame, path: str, labels: str = "labels", mode: str = "error") -> None:
    """(image_path, labels) as JSON lines; label lists are joined to text here and nowhere earlier."""
    is_list = df.schema[labels].dataType.typeName() == "array"
    out = df.withColumn(labels, join_labels(labels)) if is_list else df
    keep = ["image_path", labels] + (["split"] if "split" in df.columns else [])
    writer = out.select(*keep).write.mode(mode)
    (writer.partitionBy("split") if "split" in keep else writer).json(path)


def write_label_arrays(df: DataFrame, path: str, mode: str = "error") -> None:
    """Files that hold one JSON array of row objects each, one file per task that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for batch in batches:
            for value in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([("," if opened else "[") + value])], ["value"])
                opened = True
        if opened:
            yield pa.record_batch([pa.array(["]"])], ["value"])

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(run, "value string").write.mode(mode).text(path)


def write_files(df: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """One file per row, ``content`` (binary or text) at ``path`` below ``root``; gives their number.

    Written by the tasks.  A file appears whole under its name, so a retried task replaces what it
    wrote with the same.  Of rows with equal paths any one stays.  Rows without path or content write none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        folders = set()
        for batch in batches:
            for name, body in zip(*(column.to_pylist() for column in batch.columns)):
                folder, _, last = f"{base}/{name}".rpartition("/")
                if folder not in folders:
                    store.create_dir(folder, recursive=True)
                    folders.add(folder)
                part = f"{folder}/_part-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(body)
                store.move(part, f"{folder}/{last}")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = df.select(F.col(path).cast("string"), F.col(content).cast("binary")).dropna()
    return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _store(root: str):
    """File system and path of a folder, for use within a task."""
    from pyarrow import fs

    local = re.fullmatch(r"(?:file:)?/*(/.*?)/*", root)
    return (fs.LocalFileSystem(), local.group(1)) if local else fs.FileSystem.from_uri(root.rstrip("/"))


def run_report(base_prompt: Column, compiled_prompt: Column, accuracy: Column, report: Column) -> list[Column]:
    """Columns of the run report; use in ``select`` on a one-row metric table."""
    return [
        iso_stamp().alias("date_generated"),
        base_prompt.alias("base_prompt"),
        compiled_prompt.alias("compiled_prompt"),
        accuracy.alias("accuracy"),
        F.struct(accuracy.alias("accuracy"), report.alias("report")).alias("performance"),
    ]


def write_run_report(df: DataFrame, path: str, mode: str = "error") -> None:
    """Report rows as JSON lines, one object per row of the metric table."""
    df.coalesce(1).write.mode(mode).json(path)


def write_prompt(spark: SparkSession, prompt: str, path: str, name: str = "optimized_prompt") -> str:
    """Prompt text below a time-stamped folder, which is made when missing; returns the folder."""
    one = spark.range(1).select(F.lit(prompt).alias("value"), F.concat_ws("_", run_stamp(), F.substring(F.uuid(), 1, 8)).alias("stamp"))
    stamp = one.first()["stamp"]
    target = f"{path.rstrip('/')}/{name}_{stamp}"  # two runs of one second keep apart
    one.select("value").coalesce(1).write.option("lineSep", "\n").mode("append").text(target)
    return target


def write_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    """Long metric rows (scope, name, metric, value)."""
    df.select("scope", "name", "metric", F.col("value").cast("double").alias("value")).write.mode(mode).parquet(path)


def class_metric_rows(per_class: DataFrame, metrics: list[str], scope: str, name: str = "label") -> DataFrame:
    """Long metric rows of a per-class table."""
    casted = per_class.select(F.col(name).cast("string").alias("name"), *[F.col(m).cast("double") for m in metrics])
    return casted.unpivot(["name"], metrics, "metric", "value").select(F.lit(scope).alias("scope"), "name", "metric", "value")


def write_rules(rules: DataFrame, path: str, mode: str = "error") -> None:
    rules.write.mode(mode).parquet(path)


def write_predictions(df: DataFrame, path: str, mode: str = "error") -> None:
    """Per-row results, failed rows apart from good ones."""
    df.write.mode(mode).partitionBy("status").parquet(path)
