"""Large CSV and JSON files read in splits, whatever line breaks and brackets their strings hold.

A file is read as text, cut after every separator byte (line feed for CSV, closing brace for JSON), so Spark
may split it anywhere.  Whether a cut ends a record depends on all that precedes it, through a small state:
inside a quoted string or not, and how deep in brackets.  Each piece is a function of that state, found by
patterns for both starts; functions are composed within each split as rows stream by, and the splits' functions
by a prefix scan over one row per split.  With the state before every piece known, pieces that are
records by themselves (nearly all) go on as they are; only parts of longer records are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelkit.operators.bounded import join_small
from labelkit.session import written

FEW_RECORDS = 1_000

_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
_REST = rf"(?:,{_FIELD})*+$"
_STRINGS = r'"[^"]*+("|$)'


@dataclass(frozen=True)
class Format:
    """How pieces of a file act on the state.

    ``after`` gives whether a piece that starts outside (0) or inside (1) a string ends inside one,
    ``depth`` by how much it deepens the brackets, ``base`` the depth at which records stand.
    """

    separator: str
    after: tuple[Column, Column]
    depth: tuple[Column, Column]
    base: int


def csv_format() -> Format:
    """Quoted fields with doubled quotes; a quote inside an unquoted field is an ordinary character."""
    value = F.col("value")
    outside = value.rlike(rf"^{_FIELD}{_REST}")
    inside = value.rlike(rf'^(?:[^"]++|"")*+"[^,]*+{_REST}')
    none = F.lit(0)
    return Format("\n", ((~outside).cast("int"), (~inside).cast("int")), (none, none), 0)


def json_format() -> Format:
    """One array of objects."""
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    odd = F.pmod(F.length(plain) - F.length(F.replace(plain, F.lit('"'))), F.lit(2))
    closed = F.concat(plain, F.lit("}"))

    def depth(text: Column) -> Column:
        outside = F.regexp_replace(text, _STRINGS, "")
        brackets = lambda some: F.length(outside) - F.length(F.translate(outside, some, ""))
        return (brackets("[{") - brackets("]}")).cast("int")

    inside = F.regexp_replace(closed, r'^[^"]*+("|$)', "")
    return Format("}", (odd, 1 - odd), (depth(closed), depth(inside)), 1)


def _states(start: int, after: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """State before each piece and after the last, for a block that starts in ``start``."""
    zero, one = after
    fixed, swaps = zero == one, (zero == 1) & (one == 0)
    turned = np.concatenate([[0], np.cumsum(swaps)])
    at = np.maximum.accumulate(np.where(np.concatenate([[True], fixed]), np.arange(len(zero) + 1), 0))
    value = np.concatenate([[start], zero])
    return (value[at] + turned - turned[at]) % 2


def _walked(pieces: DataFrame) -> DataFrame:
    """Adds the number of each piece in its block, and state and depth before and after it for both starts of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, count, state, deep = None, 0, [0, 1], [0, 0]
        for batch in batches:
            files, starts = batch.column("file").to_pylist(), batch.column("block").to_numpy()
            after = [batch.column(c).to_numpy() for c in ("after0", "after1")]
            depth = [batch.column(c).to_numpy() for c in ("depth0", "depth1")]
            edges = [k for k in range(1, len(files)) if starts[k] != starts[k - 1] or files[k] != files[k - 1]]
            made: list[list[np.ndarray]] = []
            for lo, hi in zip([0, *edges], [*edges, len(files)]):
                if lo == hi:
                    continue
                if (files[lo], starts[lo]) != block:
                    block, count, state, deep = (files[lo], starts[lo]), 0, [0, 1], [0, 0]
                columns = [np.arange(count, count + hi - lo)]
                for h in (0, 1):
                    states = _states(state[h], (after[0][lo:hi], after[1][lo:hi]))
                    steps = np.where(states[:-1] == 0, depth[0][lo:hi], depth[1][lo:hi])
                    depths = deep[h] + np.concatenate([[0], np.cumsum(steps)])
                    columns += [states[:-1], states[1:], depths[:-1], depths[1:]]
                    state[h], deep[h] = int(states[-1]), int(depths[-1])
                count += hi - lo
                made.append(columns)
            parts = [np.concatenate(c) for c in zip(*made)] if made else [np.empty(0, np.int64)] * 9
            names = ["at", *(f"{n}{h}" for h in (0, 1) for n in ("state", "end", "deep", "deep_end"))]
            yield pa.record_batch(
                [batch.column("file"), batch.column("block"), batch.column("value"), *[pa.array(p, pa.int64()) for p in parts]],
                ["file", "block", "value", *names],
            )

    numbers = ", ".join(f"{n}{h} long" for h in (0, 1) for n in ("state", "end", "deep", "deep_end"))
    return pieces.mapInArrow(run, f"file string, block long, value string, at long, {numbers}")


def _carried(blocks: DataFrame) -> DataFrame:
    """(file, block, state, deep): what each block starts with, from the functions of the blocks before it."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = ((F.col("end0") == 1) & (F.col("end1") == 0)).cast("int")
    turned = blocks.withColumn("turned", F.sum(swaps).over(order))
    last = F.last(F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").alias("value"), "turned")), ignorenulls=True).over(before)
    seen = turned.withColumns({"last": last, "upto": F.coalesce(F.max("turned").over(before), F.lit(0))})
    state = F.pmod(F.coalesce("last.value", F.lit(0)) + F.col("upto") - F.coalesce("last.turned", F.lit(0)), F.lit(2))
    stated = seen.withColumn("state", state)
    grown = F.when(F.col("state") == 0, F.col("deep_end0")).otherwise(F.col("deep_end1"))
    return stated.withColumn("deep", F.coalesce(F.sum(grown).over(before), F.lit(0))).select("file", "block", "state", "deep")


def read_records(spark: SparkSession, path: str, form: Format) -> DataFrame:
    """(file, block, at, record): the text of every record, with the place of its first piece.

    Records do not hold their last separator.  Pieces of one record meet in one task, whole records are not shuffled.
    """
    lines = spark.read.option("lineSep", form.separator).text(path)
    pieces = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        *[c.cast("long").alias(f"after{h}") for h, c in enumerate(form.after)],
        *[c.cast("long").alias(f"depth{h}") for h, c in enumerate(form.depth)],
    )
    walked = _walked(pieces)
    blocks = walked.groupBy("file", "block").agg(
        *[F.max_by(c, "at").alias(c) for c in ("end0", "end1", "deep_end0", "deep_end1")]
    )
    known = join_small(walked, _carried(written(blocks, "file-blocks")), ["file", "block"])
    pick = lambda name: F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    at_base = lambda state, deep: (pick(state) == 0) & (F.col("deep") + pick(deep) <= form.base)
    placed = known.select(
        "file", "block", "at", "value", at_base("state", "deep").alias("starts"), at_base("end", "deep_end").alias("ends")
    )
    # a part belongs to the last piece before it that starts a record, in its block or in an earlier one
    parts = written(placed.where("NOT (starts AND ends)"), "record-parts").withColumn("own", F.when(F.col("starts"), F.struct("block", "at")))
    inside = Window.partitionBy("file", "block").orderBy("at")
    parts = parts.withColumn("own", F.last("own", ignorenulls=True).over(inside))
    last = parts.groupBy("file", "block").agg(F.max_by("own", "at").alias("own"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = last.select("file", "block", F.last("own", ignorenulls=True).over(earlier).alias("opened"))
    parts = join_small(parts, opened, ["file", "block"]).withColumn("own", F.coalesce("own", "opened"))
    pieces_of = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    joined = parts.groupBy("file", "own").agg(F.array_join(pieces_of["value"], form.separator).alias("record"))
    joined = joined.select("file", "own.block", "own.at", "record")
    # put where the first piece stands; a few long records are broadcast, and rows then keep the order of the files
    records = join_small(placed.where("starts"), joined, ["file", "block", "at"], "left", FEW_RECORDS)
    return records.select("file", "block", "at", F.when(F.col("ends"), F.col("value")).otherwise(F.col("record")).alias("record"))
