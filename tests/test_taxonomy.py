from __future__ import annotations

import pytest

from labelkit.operators import taxonomy as tx


@pytest.fixture(scope="module")
def folders(spark):
    names = ["gore", "memes", "credit_card_images", "selfie", "zzz", "zzz", None]
    return spark.createDataFrame([(n,) for n in names], "folder string")


def test_known_taxonomies_disagree_where_they_should(spark):
    known = tx.known_taxonomies(spark)
    by_id = {(r.taxonomy_id, r.folder): r.category for r in known.collect()}
    assert by_id["moderation", "memes"] == "Safe Content" and by_id["three_class", "memes"] == "text_image"
    assert ("moderation", "credit_card_images") not in by_id
    assert by_id["three_class", "credit_card_images"] == "harm"
    assert {c for (t, _), c in by_id.items() if t == "three_class"} == set(tx.CLASSES)


def test_unmapped_folders_are_dropped_or_defaulted(spark, folders):
    dim = tx.taxonomy(spark, tx.CATEGORY_OF_FOLDER)
    assert sorted((r.folder, r.category) for r in tx.map_taxonomy(folders, dim).collect()) == [
        ("gore", "GORE"), ("memes", "Safe Content"), ("selfie", "FACE"),
    ]
    classes = tx.map_taxonomy(folders, tx.taxonomy(spark, tx.CLASS_OF_FOLDER), default=tx.DEFAULT_CLASS)
    assert classes.count() == 7 and classes.where("category = 'harm'").count() == 6


def test_unmapped_report_leaves_out_skipped_ones(spark, folders):
    dim = tx.taxonomy(spark, tx.CATEGORY_OF_FOLDER)
    assert [r.folder for r in tx.unmapped(folders, dim, skip=tx.SKIPPED_FOLDERS).collect()] == ["zzz"]
    assert {r.folder for r in tx.unmapped(folders, dim).collect()} == {"zzz", "credit_card_images"}


def test_dense_ids(spark):
    rows = spark.createDataFrame([("fr",), ("en",), ("xx",), (None,)], "lang string")
    ids = tx.dense_ids(rows, "lang", ["en", "es", "fr"])
    assert {r.label: r.class_id for r in ids.collect()} == {"en": 0, "fr": 1, "noise": 2, "others": 3}
    assigned = tx.assign_ids(rows, ids, "lang")
    assert {r.lang: r.class_id for r in assigned.collect()} == {"en": 0, "fr": 1}
    named = tx.with_label(assigned.drop("lang"), ids, "class_id")
    assert {r.class_id: r.label_name for r in named.collect()} == {0: "en", 1: "fr"}


def test_label_counts(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    assert [tuple(r) for r in tx.label_counts(rows, "c").collect()] == [("b", 2), ("a", 1)]
    dim = spark.createDataFrame([("a",), ("z",), ("b",)], "category string")
    assert [tuple(r) for r in tx.label_counts(rows, "c", dim).collect()] == [("b", 2), ("a", 1), ("z", 0)]
