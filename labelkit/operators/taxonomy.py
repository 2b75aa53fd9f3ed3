"""Raw folder or label names mapped to a versioned taxonomy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.operators.bounded import join_small, local_table

# The moderation categories and the two folder maps in use. The maps disagree on
# memes, middle_finger and credit_card_images, which is why a taxonomy carries an id.
MODERATION_CATEGORIES = [
    "PORNOGRAPHY", "GORE", "WEAPONS", "EXTREMISM", "DRUGS", "GAMBLING", "ID_CARDS", "DOCUMENTS",
    "FACE", "SWIM_UNDERWEAR", "ALCOHOL", "Safe Content",
]
CATEGORY_OF_FOLDER = {
    "alcohol": "ALCOHOL", "credit_card": "ID_CARDS", "drug-name": "DRUGS", "gore": "GORE",
    "hate": "EXTREMISM", "memes": "Safe Content", "middle_finger": "Safe Content",
    "porn": "PORNOGRAPHY", "safe": "Safe Content", "self_harm": "GORE", "selfie": "FACE",
    "violence": "GORE", "weapons": "WEAPONS",
}
SKIPPED_FOLDERS = ["credit_card_images"]
CLASS_OF_FOLDER = {
    "safe": "safe", "memes": "text_image", "alcohol": "harm", "credit_card": "harm",
    "credit_card_images": "harm", "drug-name": "harm", "gore": "harm", "hate": "harm",
    "middle_finger": "harm", "porn": "harm", "self_harm": "harm", "selfie": "harm",
    "violence": "harm", "weapons": "harm",
}
CLASSES = ["harm", "safe", "text_image"]
DEFAULT_CLASS = "harm"


def taxonomy(spark: SparkSession, mapping: Mapping[str, str], taxonomy_id: str = "default") -> DataFrame:
    """Dimension table (taxonomy_id, folder, category)."""
    return local_table(
        spark,
        {"taxonomy_id": [taxonomy_id] * len(mapping), "folder": mapping.keys(), "category": mapping.values()},
        "taxonomy_id string, folder string, category string",
    )


def known_taxonomies(spark: SparkSession) -> DataFrame:
    return taxonomy(spark, CATEGORY_OF_FOLDER, "moderation").unionByName(
        taxonomy(spark, CLASS_OF_FOLDER, "three_class")
    )


def map_taxonomy(
    df: DataFrame,
    dim: DataFrame,
    folder: str = "folder",
    category: str = "category",
    default: str | None = None,
) -> DataFrame:
    """Category of each row's folder; unmapped rows are dropped, or take ``default``."""
    small = dim.select(F.col("folder").alias(folder), F.col("category").alias(category))
    if default is None:
        return join_small(df, small, folder, "inner")
    mapped = join_small(df, small, folder, "left")
    return mapped.withColumn(category, F.coalesce(category, F.lit(default)))


def unmapped(df: DataFrame, dim: DataFrame, folder: str = "folder", skip: Sequence[str] = ()) -> DataFrame:
    """Folder names that no taxonomy row covers, apart from those skipped on purpose."""
    names = df.select(folder).where(F.col(folder).isNotNull())
    if skip:
        names = names.where(~F.col(folder).isin(list(skip)))
    return join_small(
        names.distinct(), dim.select(F.col("folder").alias(folder)), folder, "left_anti"
    )


def dense_ids(
    df: DataFrame,
    label: str,
    ordered: Sequence[str],
    extra: Sequence[str] = ("noise", "others"),
) -> DataFrame:
    """Table (label, class_id): listed labels that occur in ``df`` in list order, then the extras.

    The ids have no gaps for labels that did not load.  The result has at most
    ``len(ordered) + len(extra)`` rows.
    """
    names = df.select(F.col(label).alias("label")).where(F.col(label).isin(list(ordered))).distinct()
    present = {r.label for r in names.collect()}  # no more rows than ``ordered`` has names
    kept = [name for name in ordered if name in present] + list(extra)
    return local_table(
        df.sparkSession,
        {"label": kept, "class_id": range(len(kept))},
        "label string, class_id int",
    )


def assign_ids(df: DataFrame, ids: DataFrame, label: str, column: str = "class_id") -> DataFrame:
    """Class id of each row's label; rows whose label has no id are dropped."""
    small = ids.select(F.col("label").alias(label), F.col("class_id").alias(column))
    return join_small(df, small, label, "inner")


def with_label(df: DataFrame, ids: DataFrame, class_id: str, column: str = "label_name") -> DataFrame:
    """Label of each row's class id, null when the id is unknown."""
    small = ids.select(F.col("class_id").alias(class_id), F.col("label").alias(column))
    return join_small(df, small, class_id, "left")


def label_counts(df: DataFrame, label: str, dim: DataFrame | None = None) -> DataFrame:
    """Rows per label, most frequent first; with ``dim`` (column ``category``) also empty ones."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    if dim is not None:
        names = dim.select(F.col("category").alias(label)).distinct()
        counts = names.join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return counts.orderBy(F.desc("n"), F.asc(label))
