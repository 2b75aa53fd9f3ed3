"""Streaming forms of the repeat, count and scoring operators.

The operators take and return streaming DataFrames.  Timestamps without zone are read as session
time, because watermarks need an instant.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelkit.functions.text import squeeze
from labelkit.session import SETTINGS, shared_dir

CLOSES = "closes_"
FAR = "9000-01-01 00:00:00"


def read_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    closing: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """A parquet table (one file or a folder of part files) as a stream.

    ``max_files`` bounds what one micro-batch takes on.  ``closing`` names a folder beside the input
    whose rows only move the watermark: ``run_available`` writes one there when a bounded input is
    done, so that windows and held rows still open are given out.  Such rows have nulls in all
    columns but the event time, and ``with_event_time`` takes them out.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rstrip("/").rpartition("/")
    first = None if "*" in path else spark.read.schema(schema).parquet(path).select("_metadata.file_path").first()
    if first is not None and first["file_path"].rstrip("/").endswith(f"/{name}"):  # the table is one file
        rows = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        rows = reader.parquet(path)
    if closing is None:
        return rows
    spark.createDataFrame([], rows.schema).withColumn(CLOSES, F.lit(True)).write.mode("append").parquet(closing)
    marks = spark.readStream.schema(T.StructType([*rows.schema.fields, T.StructField(CLOSES, T.BooleanType())])).parquet(closing)
    return rows.withColumn(CLOSES, F.lit(False)).unionByName(marks)


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if df.isStreaming else df.withColumn(ts, F.col(ts).cast("timestamp"))
    if CLOSES not in df.columns:
        return timed
    # the condition names the event time, or it would be moved below the watermark and marks would not be seen
    return timed.where(~F.col(CLOSES) | (F.col(ts) < F.lit(FAR).cast("timestamp"))).drop(CLOSES)


def repeats_sliding(
    df: DataFrame,
    author: str,
    message: str,
    ts: str,
    at_least: int = 2,
    window: str = "1 hour",
    slide: str = "10 minutes",
    delay: str = "2 hours",
) -> DataFrame:
    """Author and message seen at least ``at_least`` times in a sliding window.

    State holds the counts per slide of two window lengths, so a row enters two groups at most instead of one per
    window it lies in.  A group is given out when the watermark passes its end, up to one window length after
    the first windows in it; ``window`` must be a multiple of ``slide``, other windows are counted one by one.
    """
    timed = with_event_time(df, ts, delay).withColumn("message_key", F.md5(squeeze(message)))
    long, step = (pd.Timedelta(length) // pd.Timedelta(microseconds=1) for length in (window, slide))
    if long % step:
        counted = timed.groupBy(F.window(ts, window, slide), author, "message_key").agg(F.count("*").alias("n"))
        return counted.where(F.col("n") >= at_least).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), author, "message_key", "n")
    steps = long // step
    begin = F.unix_micros("window.start")
    placed = timed.withColumn("window", F.window(ts, f"{2 * long} microseconds", f"{long} microseconds"))
    placed = placed.withColumn("slot", F.floor((F.unix_micros(F.col(ts)) - begin) / step)).where(F.col("slot") < 2 * steps - 1)
    slots = placed.groupBy("window", author, "message_key").agg(*[F.count_if(F.col("slot") == k).alias(f"slot_{k}") for k in range(2 * steps - 1)])
    windows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), sum((F.col(f"slot_{k + i}") for i in range(1, steps)), F.col(f"slot_{k}")).alias("n")) for k in range(steps)])
    found = slots.select("window", author, "message_key", F.inline(F.filter(windows, lambda w: w.n >= max(at_least, 1))))
    start, end = (F.timestamp_micros(begin + F.col("k") * step + more) for more in (0, long))
    return found.select(start.alias("start"), end.alias("end"), author, "message_key", "n")


def label_counts(df: DataFrame, label: str, ts: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Rows per label and tumbling window."""
    return (
        with_event_time(df, ts, delay)
        .groupBy(F.window(ts, window), label)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), label, "n")
    )


def bursts(df: DataFrame, author: str, ts: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """An author's posts with no gap of ``gap`` between them: (author, start, end, n)."""
    return (
        with_event_time(df, ts, delay)
        .groupBy(F.session_window(ts, gap), author)
        .agg(F.count("*").alias("n"))
        .select(author, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def first_and_repeats(
    df: DataFrame,
    author: str,
    message: str,
    ts: str,
    key: str,
    seconds: int = 3600,
    delay: str = "2 hours",
) -> DataFrame:
    """Every post with ``is_repeat``: the author sent this message within the last ``seconds`` before it.

    Time is cut into cells of ``seconds``.  Of a thread's posts in one cell only the first can be new,
    since the others have it less than ``seconds`` before them; it is judged by the latest post of the
    cell before.  First and latest are one running aggregate per thread and cell, over windows of two
    cells that slide by one, and the posts meet it in a join on thread and cell.  So no task holds a list
    of posts, whatever a thread or an hour contains, nothing leaves the JVM, and state goes as soon as
    the watermark passes the cell.

    Posts are judged in event order, so answers do not depend on files or micro-batches.  Rows with the
    same time and key (a post delivered twice) are judged alike.  Rows without a time are dropped, as
    are those whose cell the watermark has passed (``delay``); null authors or messages are threads too.
    """
    span = seconds * 1_000_000
    cell, two_cells = f"{seconds} seconds", f"{2 * seconds} seconds"
    timed = with_event_time(df, ts, delay)
    posts = timed.select(
        F.col(author).cast("string").alias("author"),
        F.md5(F.concat_ws("|", F.col(author).cast("string"), F.md5(squeeze(message)))).alias("thread"),
        F.col(key).cast("bigint").alias("post"),
        F.col(ts).alias("seen_at"),
        F.unix_micros(F.col(ts)).alias("at"),
    )
    own = F.col("at") >= F.unix_micros(F.col("window.end")) - span
    firsts = (
        posts.withColumn("window", F.window("seen_at", two_cells, cell))
        .groupBy("window", F.col("thread").alias("of"))
        .agg(
            F.min(F.when(own, F.struct("at", "post"))).alias("first"),
            F.max(F.when(~own, F.col("at"))).alias("before"),
        )
        .where(F.col("first").isNotNull())
        .select(F.window_time("window").alias("ends"), "of", "first", "before")
    )
    placed = posts.withColumn("window", F.window("seen_at", cell)).select(
        "author", "thread", "post", "at", F.window_time("window").alias("cell")
    )
    is_first = (F.col("at") == F.col("first.at")) & F.col("post").eqNullSafe(F.col("first.post"))
    near = F.coalesce(F.col("at") - F.col("before") <= span, F.lit(False))
    return placed.join(firsts, (F.col("thread") == F.col("of")) & (F.col("cell") == F.col("ends"))).select(
        "author", "post", (~is_first | near).alias("is_repeat")
    )


def score_stream(df: DataFrame, steps: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Writer of scored batches: each micro-batch goes through ``steps`` (scorer and rules) once and
    is written under its batch id, so a retried batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        steps(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_available(
    stream: DataFrame, mode: str = "append", out: str | None = None, closing: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Run a stream over all input there is now and return what its sink holds; no input gives no rows.

    Results are written as parquet by the executors: each batch adds its own folder in append mode,
    and replaces the previous result in complete mode.  With ``closing`` (see ``read_files``) the
    input is taken as complete: a mark far in the future is written there and the stream runs once
    more, which closes what is open.
    """
    spark = stream.sparkSession
    for name, value in SETTINGS.items():
        if name.startswith("spark.sql.streaming."):
            spark.conf.set(name, value)
    base = out or shared_dir(spark, "stream")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{base}/data/none")

    def write(batch: DataFrame, batch_id: int) -> None:
        part = f"batch_id={batch_id}" if mode == "append" else "latest"
        batch.write.mode("overwrite").parquet(f"{base}/data/{part}")

    def once() -> None:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    once()
    if closing is not None:
        marks = spark.read.parquet(closing)
        mark = [F.lit(None).cast(f.dataType).alias(f.name) for f in marks.schema if f.name not in (ts, CLOSES)]
        at = F.lit(FAR).cast(marks.schema[ts].dataType).alias(ts)
        spark.range(1).select(*mark, at, F.lit(True).alias(CLOSES)).write.mode("append").parquet(closing)
        once()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{base}/data")
