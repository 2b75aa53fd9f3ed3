from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from labelkit.streaming import jobs

T0 = datetime.datetime(2024, 1, 1, 10, 0, 0)
SCHEMA = "id bigint, author bigint, message string, ts timestamp_ntz"


def _land(spark, path, batches):
    """One file per micro-batch, written in order."""
    import os
    import time

    for i, rows in enumerate(batches):
        made = [(n, a, m, T0 + datetime.timedelta(minutes=minute)) for n, a, m, minute in rows]
        target = f"{path}/part{i}"
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(target)
        stamp = time.time() - 1000 + i
        for name in os.listdir(target):
            os.utime(f"{target}/{name}", (stamp, stamp))
    return jobs.read_files(spark, f"{path}/*", SCHEMA, max_files=1)


def _jobs():
    return {
        "repeats": lambda df: jobs.first_and_repeats(df, "author", "message", "ts", "id", delay="30 days"),
        "sliding": lambda df: jobs.repeats_sliding(df, "author", "message", "ts", delay="30 days"),
        "counts": lambda df: jobs.label_counts(df, "message", "ts", delay="30 days"),
        "sessions": lambda df: jobs.bursts(df, "author", "ts", "15 minutes", delay="30 days"),
    }


def _written(spark, path, files, seed):
    import random

    rng = random.Random(7)
    rows = [(i, rng.randrange(3), rng.choice("xy"), rng.randrange(900)) for i in range(80)]
    random.Random(seed).shuffle(rows)
    made = [(n, a, m, T0 + datetime.timedelta(minutes=minute)) for n, a, m, minute in rows]
    for k in range(files):
        spark.createDataFrame(made[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("name", ["repeats", "sliding", "counts", "sessions"])
def test_answers_do_not_depend_on_files_or_batches(spark, tmp_path, name):
    results = []
    for files, per_batch in ((1, None), (3, 1), (10, None), (10, 4)):
        path = _written(spark, str(tmp_path / f"in{len(results)}"), files, files)
        closing = str(tmp_path / f"closing{len(results)}")
        stream = _jobs()[name](jobs.read_files(spark, path, SCHEMA, closing, per_batch))
        results.append(sorted(map(tuple, jobs.run_available(stream, closing=closing).collect()), key=str))
    assert results[0] and all(r == results[0] for r in results)


def test_repeats_equal_a_loop(spark, tmp_path):
    path = _written(spark, str(tmp_path / "in"), 3, 1)
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.ts, r.id))
    want, last = {}, {}
    for r in rows:
        before = last.get((r.author, r.message))
        want[r.id] = before is not None and r.ts - before <= datetime.timedelta(hours=1)
        last[r.author, r.message] = r.ts
    closing = str(tmp_path / "closing")
    done = jobs.run_available(_jobs()["repeats"](jobs.read_files(spark, path, SCHEMA, closing, 1)), closing=closing)
    assert {r.post: r.is_repeat for r in done.collect()} == want


def test_repeats_at_cell_edges_with_null_threads_and_posts_delivered_twice(spark, tmp_path):
    hour = 60
    rows = [
        (1, 1, "x", 0), (2, 1, "x", hour), (3, 1, "x", 3 * hour - 1), (4, 1, "x", 4 * hour - 1), (5, 1, "x", 5 * hour),
        (6, None, "x", 10), (7, None, " X ", 20), (8, 2, None, 10), (9, 2, "y", 20), (10, 3, "z", 10), (10, 3, "z", 10),
        (11, 1, "x", 0),
    ]
    made = [(n, a, m, T0 + datetime.timedelta(minutes=minute)) for n, a, m, minute in rows]
    made.append((12, 1, "x", None))
    path, closing = str(tmp_path / "in"), str(tmp_path / "closing")
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(path)
    done = jobs.run_available(_jobs()["repeats"](jobs.read_files(spark, path, SCHEMA, closing)), closing=closing).collect()
    assert sorted(r.post for r in done if r.is_repeat) == [2, 4, 7, 11]
    assert sorted(r.post for r in done if not r.is_repeat) == [1, 3, 5, 6, 8, 9, 10, 10]


def test_no_input_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    closing = str(tmp_path / "closing")
    stream = _jobs()["counts"](jobs.read_files(spark, str(tmp_path / "in"), SCHEMA, closing))
    assert jobs.run_available(stream, closing=closing).count() == 0


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    rows = [
        [(1, 1, "x", 0), (2, 1, "x", 5)],
        [(3, 9, "z", 600)],
        [(4, 9, "z", 700)],
        [(5, 1, "x", 6), (6, 9, "z", 800)],
    ]
    stream = _land(spark, str(tmp_path / "in"), rows)
    done = jobs.run_available(jobs.repeats_sliding(stream, "author", "message", "ts", slide="1 hour"))
    assert [(r.author, r.n) for r in done.collect()] == [(1, 2)]


def test_counts_and_bursts_equal_the_batch_result(spark, tmp_path):
    rows = [[(i, i % 3, "m", i * 7) for i in range(20)], [(i, i % 3, "m", i * 7) for i in range(20, 60)]]
    stream = _land(spark, str(tmp_path / "in"), rows)
    batch = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    for job in (
        lambda df: jobs.label_counts(df, "author", "ts"),
        lambda df: jobs.bursts(df, "author", "ts", "15 minutes"),
    ):
        live = sorted(map(tuple, jobs.run_available(job(stream), "complete").collect()), key=str)
        assert live == sorted(map(tuple, job(batch).collect()), key=str) and live


def test_scored_stream(spark, tmp_path):
    stream = _land(spark, str(tmp_path / "in"), [[(1, 1, "a", 0)], [(2, 1, "b", 1)]])
    steps = lambda df: df.select("id", F.upper("message").alias("up"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    jobs.score_stream(stream, steps, out, check).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(out)
    assert {(r.id, r.up, r.batch_id) for r in back.collect()} == {(1, "A", 0), (2, "B", 1)}


@pytest.mark.parametrize("window, slide", [("1 hour", "10 minutes"), ("1 hour", "1 hour"), ("50 minutes", "20 minutes")])
def test_sliding_windows_equal_spark_windows_with_less_state(spark, tmp_path, window, slide):
    path = _written(spark, str(tmp_path / "in"), 3, 1)
    rows = spark.read.parquet(path)
    count = lambda df: jobs.repeats_sliding(df, "author", "message", "ts", 2, window, slide, "30 days")
    plain = rows.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", window, slide), "author", F.md5("message").alias("key")).agg(F.count("*").alias("n"))
    want = plain.where("n >= 2").select("window.start", "window.end", "author", "key", "n")
    closing = str(tmp_path / "closing")
    done = jobs.run_available(count(jobs.read_files(spark, path, SCHEMA, closing, 1)), closing=closing)
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, want.collect()))
    if window != "50 minutes":
        plan = count(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert sum(line.count("named_struct(start") for line in plan.splitlines() if "Expand" in line) <= 2
