"""Examples from CSV and JSON, and scans of file trees."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelkit.functions.text import has_extension
from labelkit.operators.bounded import local_table
from labelkit.session import written
from labelkit.sources.columns import require_columns
from labelkit.sources.pieces import csv_format, json_format, read_records

INSTRUCTION_COLUMNS = ["prompt", "question", "response"]
INTENT_COLUMNS = ["text", "label"]
LABEL_JSON_SCHEMA = "image_path string, labels string"

# File endings taken as images, per reader.
LABELLED_IMAGES = ["png", "jpg", "jpeg"]
MAPPED_IMAGES = ["png", "jpg", "jpeg", "webp", "gif"]
UNLABELLED_IMAGES = ["jpg", "jpeg", "png", "webp"]

LISTED = 10_000  # names of a folder that travel as one batch


def read_examples_csv(spark: SparkSession, path: str, columns: Sequence[str] = INSTRUCTION_COLUMNS) -> DataFrame:
    """CSV with a header whose fields may hold newlines, commas and doubled quotes.

    Columns are found by name; all files must have the same header.  Files are read in splits of any
    size (``sources.pieces``); an empty field is null, quoted or not, blank lines below the header are skipped.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    names = [n.removeprefix("\ufeff") for n in reader.csv(path).columns]  # reads the first record of one file
    records = read_records(spark, path, csv_format()).withColumn("record", F.regexp_replace("record", "\r$", ""))
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = records.where(F.trim("record") != "").withColumn("r", F.from_csv("record", fields, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}))
    same = [F.regexp_replace(f"r.c{i}", "^\ufeff", "").eqNullSafe(F.lit(n)) for i, n in enumerate(names)]
    other = F.raise_error(F.concat(F.lit(f"header is not {names}: "), "file")).cast("boolean")
    is_head = F.when((F.col("block") == 0) & (F.col("at") == 0), F.when(reduce(lambda a, b: a & b, same), True).otherwise(other)).otherwise(False)
    df = require_columns(parsed.where(~is_head).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)]), columns)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])


def land(df: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Write once as parquet and read back, so that later scans split and prune."""
    (df.repartition(partitions) if partitions else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_incomplete(df: DataFrame, columns: Sequence[str] = INTENT_COLUMNS) -> DataFrame:
    return df.na.drop(subset=list(columns))


def read_label_json(spark: SparkSession, path: str, schema: str | T.StructType = LABEL_JSON_SCHEMA) -> DataFrame:
    """JSON files that hold one array of {image_path, labels} objects each, read in splits of any size.

    The array may stand on one line; values may be nested.  Text that is no object gives no row.
    """
    records = read_records(spark, path, json_format())
    body = F.regexp_extract("record", r"(?s)^[\s,\[\ufeff]*(\{.*)$", 1)
    objects = records.select(F.concat(body, F.lit("}")).alias("body")).where(F.length("body") > 1)
    return objects.select(F.from_json("body", schema).alias("r")).select("r.*")


def _files(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """Paths only.  On a mounted file system tasks list the folders, a level at a time; elsewhere Spark's reader does.

    That reader keeps all paths on the driver and opens each file, some thirty to a task, which takes minutes for
    some 100,000 files.  Both leave out empty files and names that start with a dot or an underscore (flat scans: of files only).
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    if not set("*?[{") & set(root) and path.toUri().getScheme() in (None, "file"):
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.getScheme() == "file" and store.exists(path) and store.getFileStatus(path).isDirectory():
            return _listed(spark, store.makeQualified(path).toString().removeprefix("file:").rstrip("/"), recursive)
    reader = spark.read.format("binaryFile")
    if recursive:
        return reader.option("recursiveFileLookup", True).load(root).select("path")
    return reader.load(f"{root.rstrip('/')}/*").select("path")


def _listed(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """(path) of the files below a mounted folder; a folder is listed by one task, whatever it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with os.scandir(folder) as entries:
                    while part := list(islice(entries, LISTED)):
                        below = [e.is_dir() for e in part]
                        shown = [not e.name.startswith((".", "_")) or (is_folder and not recursive) for e, is_folder in zip(part, below)]
                        seen = [s and (is_folder or e.stat().st_size > 0) for s, e, is_folder in zip(shown, part, below)]
                        yield pa.record_batch([pa.array([e.path for e in part]), pa.array(below)], ["path", "below"]).filter(pa.array(seen))

    level, found = local_table(spark, {"path": [root]}, "path string"), []
    while True:
        entries = written(level.mapInArrow(run, "path string, below boolean"), "listed")
        found.append(entries.where("NOT below").select(F.concat(F.lit("file:"), "path").alias("path")))
        folders = entries.where("below").select("path")
        if (not recursive and len(found) == 2) or folders.isEmpty():
            return reduce(DataFrame.unionAll, found)
        level = folders.repartition(spark.sparkContext.defaultParallelism, "path")


def path_below(path: str | Column, root: str) -> Column:
    """Path relative to ``root``, whatever scheme prefix the scan put in front."""
    path = F.col(path) if isinstance(path, str) else path
    bare = F.regexp_replace(path, "^[a-z0-9]+:(//[^/]*)?", "")
    base = root.split("://", 1)[-1]
    base = base if root.find("://") < 0 else "/" + base.split("/", 1)[-1]
    prefix = "/" + base.strip("/") + "/"
    return F.when(F.startswith(bare, F.lit(prefix)), F.substr(bare, F.lit(len(prefix) + 1))).otherwise(bare)


def scan_folder(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] = LABELLED_IMAGES,
    recursive: bool = False,
) -> DataFrame:
    """(path, folder) of files whose ending matches in any case.

    Flat scans take files one level below ``root``; recursive ones take whole trees. The folder is
    always the first part below ``root``.
    """
    found = _files(spark, root, recursive).where(has_extension("path", extensions))
    parts = F.split(path_below("path", root), "/")
    deep_enough = F.size(parts) > 1 if recursive else F.size(parts) == 2
    return found.where(deep_enough).select("path", F.get(parts, F.lit(0)).alias("folder"))


def scan_files(spark: SparkSession, root: str, extensions: Sequence[str] = UNLABELLED_IMAGES) -> DataFrame:
    """Paths of a whole tree, without labels."""
    return _files(spark, root, True).where(has_extension("path", extensions))


def resolve_inputs(spark: SparkSession, uri: str) -> DataFrame:
    """Paths to score: one image, a JSON list of them, or a folder tree; anything else is an error."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise ValueError(f"no such input: {uri}")
    if fs.getFileStatus(path).isDirectory():
        return scan_files(spark, uri)
    ending = uri.lower().rsplit(".", 1)[-1]
    if ending in UNLABELLED_IMAGES:
        return spark.read.format("binaryFile").load(uri).select("path")
    if ending == "json":
        return read_label_json(spark, uri).select(F.col("image_path").alias("path"))
    raise ValueError(f"not an image, a JSON list or a folder: {uri}")


def uri_folder(uri: str | Column) -> Column:
    """First path part of an absolute URI; empty when there is none."""
    column = F.col(uri) if isinstance(uri, str) else uri
    return F.regexp_extract(column, r"^[a-z]+://[^/]+/([^/?#]*)", 1)
