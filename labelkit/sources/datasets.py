"""Named dataset parts, many sources at once, and fallbacks."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.operators.bounded import local_table
from labelkit.sources.columns import require_columns

Reader = Callable[[], DataFrame]
STATUS_SCHEMA = "name string, status string, error string"


def parse_slice(split: str) -> tuple[str, int | None]:
    """``test[:10]`` as ("test", 10), ``test`` as ("test", None)."""
    match = re.fullmatch(r"([\w.]+)(?:\[:(\d+)\])?", split)
    if not match:
        raise ValueError(f"cannot read split {split!r}")
    return match.group(1), int(match.group(2)) if match.group(2) else None


def select_split(
    df: DataFrame, conditions: Mapping[str, str | None], limit: int | None = None, order: str | None = None
) -> DataFrame:
    """Rows of one dataset, config and split; a limit takes the first rows in ``order``."""
    for column, value in conditions.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    if limit is None:
        return df
    if order is None:
        raise ValueError("a slice needs an order column")
    return df.orderBy(order).limit(limit)


def read_split(
    spark: SparkSession,
    root: str,
    dataset: str,
    split: str,
    config: str | None = None,
    order: str | None = None,
) -> DataFrame:
    """Part of a table partitioned by dataset, config and split; only its folders are read."""
    name, limit = parse_slice(split)
    table = require_columns(spark.read.parquet(root), ["dataset", "config", "split"])
    return select_split(table, {"dataset": dataset, "config": config, "split": name}, limit, order)


def read_many(
    spark: SparkSession,
    readers: Mapping[str, Reader],
    required: Sequence[str] = (),
    on_error: str = "skip",
    tag: str | None = "source_name",
) -> tuple[DataFrame | None, DataFrame]:
    """Union of all sources that can be opened, and a status row per source.

    A source fails when its reader raises, a required column is missing or it has no row; this is
    checked by reading at most one row.  ``on_error="raise"`` stops at the first failure.
    """
    loaded, names, states, errors = [], list(readers), [], []
    for name in names:
        try:
            df = require_columns(readers[name](), required)
            if df.limit(1).count() == 0:
                raise ValueError("no rows")
        except Exception as failure:
            if on_error == "raise":
                raise
            states.append("failed")
            errors.append(str(failure).splitlines()[0])
            continue
        loaded.append(df.withColumn(tag, F.lit(name)) if tag else df)
        states.append("loaded")
        errors.append(None)
    status = local_table(spark, {"name": names, "status": states, "error": errors}, STATUS_SCHEMA)
    return (union_all(loaded) if loaded else None), status


def load_status(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """(name, status, n) of wanted sources kept in one table: one aggregate over the table."""
    names = local_table(df.sparkSession, {"name": wanted}, "name string")
    counts = df.where(F.col(column).isin(list(wanted))).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return names.join(counts, "name", "left").select(
        "name", F.when(n > 0, "loaded").otherwise("failed").alias("status"), n.alias("n")
    )


def read_with_fallback(readers: Sequence[Reader], required: Sequence[str] = ()) -> DataFrame:
    """The first source that opens and has a row; the last error when none does."""
    problem: Exception = ValueError("no readers given")
    for reader in readers:
        try:
            df = require_columns(reader(), required)
            if df.limit(1).count() == 0:
                raise ValueError("no rows")
            return df
        except Exception as failure:
            problem = failure
    raise problem


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Concatenation by column name; repeated rows stay, missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
