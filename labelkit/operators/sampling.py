"""Splits, caps and samples that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.functions.hashing import hash_order, unit_draw
from labelkit.operators.ranking import first_of_groups, row_of_rank, split_at


def stratified_split(
    df: DataFrame,
    label: str | Sequence[str],
    key: str,
    ratio: float = 0.8,
    seed: int = 42,
    names: tuple[str, str] = ("train", "val"),
) -> DataFrame:
    """Per label, the first floor(ratio * n) rows of the shuffle order go to train, the rest to val.

    A label with a single row goes wholly to val.
    """
    return split_at(df, key, [lambda n: F.floor(n * F.lit(float(ratio)))], names, label, seed)


def random_split(
    df: DataFrame,
    key: str,
    test_size: float = 0.2,
    seed: int = 42,
    rounding: str = "ceil_test",
    names: tuple[str, str] = ("train", "test"),
) -> DataFrame:
    """Two-way split with an exact size.

    ``ceil_test`` gives ceil(test_size * n) rows to test, ``floor_train`` gives
    floor((1 - test_size) * n) rows to train.
    """
    if rounding == "ceil_test":
        cut = lambda n: n - F.ceil(n * F.lit(float(test_size)))
    elif rounding == "floor_train":
        share = round(1.0 - test_size, 12)
        cut = lambda n: F.floor(n * F.lit(share))
    else:
        raise ValueError(f"unknown rounding {rounding!r}")
    return split_at(df, key, [cut], names, None, seed)


def three_way_split(
    df: DataFrame,
    key: str,
    holdout: float = 0.2,
    test_share: float = 0.5,
    seed: int = 42,
    names: tuple[str, str, str] = ("train", "val", "test"),
) -> DataFrame:
    """Hold out ceil(holdout * n) rows, and give ceil(test_share * m) of those m rows to test."""

    def held(n: Column) -> Column:
        return F.ceil(n * F.lit(float(holdout)))

    return split_at(
        df,
        key,
        [lambda n: n - held(n), lambda n: n - F.ceil(held(n) * F.lit(float(test_share)))],
        names,
        None,
        seed,
    )


def approximate_split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, column: str = "split"
) -> DataFrame:
    """One-pass split by hash share; sizes are right only on average."""
    return df.withColumn(
        column, F.when(unit_draw(seed, "split", key) < test_size, "test").otherwise("train")
    )


def ensure_validation(df: DataFrame, key: str, test_size: float = 0.05, seed: int = 42) -> DataFrame:
    """Split off a validation part only when the table has no ``split`` column yet."""
    if "split" in df.columns:
        return df
    return random_split(df, key, test_size, seed, names=("train", "validation"))


def keep_split(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a separate index table."""
    return df.join(chosen.select(key), key, "left_semi")


def cap_per_group(df: DataFrame, by: str | Sequence[str], order: str, n: int) -> DataFrame:
    """At most ``n`` rows of each source, the first in source order."""
    return first_of_groups(df, by, [F.col(order)], n)


def sample_per_group(
    df: DataFrame, by: str | Sequence[str], key: str, n: int = 5, seed: int = 42
) -> DataFrame:
    """``n`` rows of each group in shuffle order."""
    return first_of_groups(df, by, [hash_order(seed, key), F.col(key)], n)


def head_n(df: DataFrame, order: str | Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of a table (each task keeps n, one merge)."""
    return df.orderBy(*([order] if isinstance(order, str) else order)).limit(n)


def row_at(df: DataFrame, order: str, index: int) -> DataFrame:
    """The row at a zero-based position; no row when the position is out of range."""
    return row_of_rank(df, [F.col(order)], index + 1)


def row_or_error(df: DataFrame, order: str, index: int) -> DataFrame:
    """Always one row: the columns at that position with status OK, or nulls with status ERROR."""
    found = row_at(df, order, index).agg(F.first(F.struct(*df.columns)).alias("row"), F.count("*").alias("n"))
    message = F.lit(f"index {index} is out of range")
    return found.select(
        "row.*",
        F.when(F.col("n") > 0, "OK").otherwise("ERROR").alias("status"),
        F.when(F.col("n") == 0, message).alias("error"),
    )


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in shuffle order (range-partitioned sort)."""
    return df.orderBy(hash_order(seed, key), F.col(key))
