"""Multi-label rows made from single-label ones, and the dataset built from both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.functions.hashing import hash_int, hash_order
from labelkit.operators.bounded import local_table
from labelkit.operators.ranking import group_rank
from labelkit.operators.sampling import sample_per_group, stratified_split
from labelkit.session import written


def n_multi(n: int, share: float) -> int:
    """Multi-label rows to add so that they make up ``share`` of the result, rounded down."""
    if not 0 <= share < 1:
        raise ValueError("share must be in [0, 1)")
    return int(n * share / (1 - share))


def pick_categories(row: Column, categories: Sequence[str], seed: int) -> Column:
    """Two or three distinct categories for a row, in drawn order."""
    wanted = F.least(F.lit(2) + (hash_int(seed, F.lit("size"), row) % 2).cast("int"), F.lit(len(categories)))
    drawn = F.array_sort(
        F.transform(
            F.array(*[F.lit(c) for c in categories]),
            lambda c: F.struct(hash_order(seed, F.lit("pick"), row, c).alias("h"), c.alias("c")),
        )
    )
    return F.transform(F.slice(drawn, F.lit(1), wanted), lambda x: x["c"])


def synth_multilabel(
    pool: DataFrame,
    key: str,
    categories: Sequence[str],
    share: float = 0.2,
    seed: int = 42,
    category: str = "category",
    part: str | None = None,
) -> DataFrame:
    """New rows (row, <key>, labels): an item of the first drawn category that has any, all labels.

    A row whose categories are all empty is not made.  The pool is ranked within its categories by
    bucketed rank, and each new row finds its item by an equi join on (category, rank), a unique
    key.  With ``part`` every part of the pool gets its own new rows, in the same pass; the result
    then has that column too.
    """
    spark = pool.sparkSession
    of_part = F.col(part) if part else F.lit("all")
    pool = pool.where(F.col(category).isin(list(categories))).select(
        of_part.alias("part"), F.col(category).alias("category"), key
    )
    # one row per part and listed category
    sizes = {(r["part"], r["category"]): r["count"] for r in pool.groupBy("part", "category").count().collect()}
    parts = sorted({p for p, _ in sizes})
    wanted = {p: n_multi(sum(n for (q, _), n in sizes.items() if q == p), share) for p in parts}
    counts = local_table(
        spark,
        {"part": [p for p, _ in sizes], "category": [c for _, c in sizes], "size": list(sizes.values())},
        "part string, category string, size bigint",
    )
    picks = spark.range(sum(wanted.values())).select(F.inline(_numbered(F.col("id"), wanted)))
    filled = _filled(sizes, parts)
    drawn = picks.withColumn("drawn", pick_categories(F.col("row"), categories, seed)).withColumn(
        "category", F.get(F.filter("drawn", lambda c: F.array_contains(filled, c)), F.lit(0))
    )
    chosen = drawn.join(counts, ["part", "category"], "inner").withColumn(
        "rank", hash_int(seed, F.lit("item"), F.col("row")) % F.col("size") + 1
    )
    ranked = group_rank(pool, key, ["part", "category"], seed)
    made = chosen.join(ranked, ["part", "category", "rank"], "inner")
    return made.select(
        *([F.col("part").alias(part)] if part else []), "row", key, F.array_join("drawn", ", ").alias("labels")
    )


def _numbered(number: Column, wanted: dict[str, int]) -> Column:
    """Running numbers over all parts as (part, row) with rows counted from 0 in each part."""
    entries, first = [], 0
    for name, n in wanted.items():
        inside = (number >= first) & (number < first + n)
        entries.append(F.when(inside, F.struct(F.lit(name).alias("part"), (number - first).alias("row"))))
        first += n
    empty = F.struct(F.lit("").alias("part"), number.alias("row"))
    return F.array_compact(F.array(*entries, F.when(F.lit(False), empty)))


def _filled(sizes: dict[tuple[str, str], int], parts: Sequence[str]) -> Column:
    """Categories of the row's part that hold an item."""
    chosen = F.array().cast("array<string>")
    for name in parts:
        there = F.array(*[F.lit(c) for p, c in sizes if p == name])
        chosen = F.when(F.col("part") == name, there).otherwise(chosen)
    return chosen


def build_dataset(
    pool: DataFrame,
    key: str,
    categories: Sequence[str],
    ratio: float = 0.8,
    share: float = 0.2,
    multi_label: bool = True,
    sample: int = 5,
    seed: int = 42,
    category: str = "category",
) -> DataFrame:
    """Rows (split, <key>, labels, is_multi, shuffle) for train, val and a small sample of train.

    Each part holds its single-label rows and its own multi-label rows; ordering by ``shuffle``
    gives the shuffled order of a part.
    """
    rows = stratified_split(pool.select(key, category), category, key, ratio, seed)
    few = sample_per_group(rows.where(F.col("split") == "train"), category, key, sample, seed)
    parts = written(rows.unionByName(few.withColumn("split", F.lit("sample"))), "parts")
    built = parts.select(
        "split", key, F.col(category).alias("labels"), F.lit(False).alias("is_multi"), F.lit(-1).cast("bigint").alias("row")
    )
    if multi_label and len(categories) > 1:
        multi = synth_multilabel(parts, key, categories, share, seed, category, "split")
        built = built.unionByName(multi.withColumn("is_multi", F.lit(True)))
    return built.withColumn("shuffle", hash_order(seed, "split", key, "row")).drop("row")
