from __future__ import annotations

import pytest

from labelkit.operators import metrics as m


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "label string, pred string")


MIXED = [("a", "a")] * 6 + [("a", "b")] * 2 + [("b", "b")] + [("b", "x")] + [("only_true", "a")]


def test_report_over_the_union_of_classes(spark):
    rows = {r.name: r for r in m.classification_report(_pairs(spark, MIXED), "label", "pred").collect()}
    assert set(rows) == {"a", "b", "x", "only_true", "accuracy", "macro avg", "weighted avg"}
    assert (rows["a"].precision, rows["a"].recall, rows["a"].support) == (6 / 7, 6 / 8, 8)
    assert rows["x"].support == 0 and rows["x"].recall == 0 and rows["x"].precision == 0
    assert rows["accuracy"].f1 == pytest.approx(7 / 11)
    assert rows["macro avg"].recall == pytest.approx((0.75 + 0.5 + 0 + 0) / 4)
    assert rows["weighted avg"].recall == pytest.approx(rows["accuracy"].recall)
    assert rows["weighted avg"].support == 11


@pytest.mark.parametrize("rows, want", [([("a", "a"), ("b", "b")], 1.0), ([("a", "b"), ("b", "a")], 0.0)])
def test_all_right_and_all_wrong(spark, rows, want):
    got = m.weighted_metrics(_pairs(spark, rows), "label", "pred").first()
    assert tuple(got) == (want, want, want, want)


def test_weighted_rows_and_empty_table(spark):
    wide = m.weighted_metrics(_pairs(spark, MIXED), "label", "pred")
    rows = {r.metric: r.value for r in m.metric_rows(wide).collect()}
    assert set(rows) == {"accuracy", "f1", "precision", "recall"}
    assert rows["recall"] == pytest.approx(rows["accuracy"])
    empty = m.weighted_metrics(_pairs(spark, MIXED).where("false"), "label", "pred").first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0)


def test_report_by_split(spark):
    df = spark.createDataFrame([("t", "a", "a"), ("v", "a", "b")], "split string, label string, pred string")
    rows = {(r.split, r.name): r.recall for r in m.classification_report(df, "label", "pred", ["split"]).collect()}
    assert rows["t", "accuracy"] == 1.0 and rows["v", "accuracy"] == 0.0 and ("t", "b") not in rows


def test_per_class_accuracy_skips_others(spark):
    rows = MIXED + [("others", "a"), ("a", None)]
    got = {r.label: (r.accuracy, r["count"]) for r in m.per_class_accuracy(_pairs(spark, rows), "label", "pred").collect()}
    assert got["a"] == (pytest.approx(6 / 9), 9) and "others" not in got and got["only_true"] == (0.0, 1)


SETS = [("A, B", "B,A"), ("A", "A, B"), ("Safe Content", "Safe Content"), ("", "Safe Content"), ("A", ""), ("Z", "Z")]
CATS = ["A", "B", "C", "Safe Content"]


def test_label_sets(spark):
    df = spark.createDataFrame(SETS, "t string, p string")
    detail = m.label_set_detail(df, "t", "p")
    assert tuple(m.exact_set_accuracy(detail).first()) == (pytest.approx(4 / 6), 6)
    rows = {r.category: r for r in m.multilabel_prf(detail, CATS).collect()}
    assert set(rows) == set(CATS)
    assert (rows["A"].tp, rows["A"].fp, rows["A"].fn) == (2, 0, 1)
    assert (rows["B"].tp, rows["B"].fp, rows["B"].fn, rows["B"].precision) == (1, 1, 0, 0.5)
    assert (rows["C"].precision, rows["C"].recall, rows["C"].f1) == (0.0, 0.0, 0.0)
    assert (rows["Safe Content"].tp, rows["Safe Content"].fp) == (2, 1)


def test_label_sets_compat_counts_safe_rows_as_wrong(spark):
    df = spark.createDataFrame(SETS, "t string, p string")
    detail = m.label_set_detail(df, "t", "p", compat=True)
    assert m.exact_set_accuracy(detail).first().accuracy == pytest.approx(3 / 6)
    rows = {r.category: r for r in m.multilabel_prf(detail, CATS).collect()}
    assert (rows["Safe Content"].tp, rows["Safe Content"].fn) == (0, 1)


def test_true_labels_are_tp_plus_fn(spark):
    detail = m.label_set_detail(spark.createDataFrame(SETS, "t string, p string"), "t", "p", compat=True)
    rows = m.multilabel_prf(detail, ["A", "B", "Z", "Safe Content"]).collect()
    assert sum(r.tp + r.fn for r in rows) == 6


def test_prediction_summary(spark):
    df = spark.createDataFrame([("A, B",), ("A",), ("ERROR",), ("B,A",)], "prediction string")
    assert [tuple(r) for r in m.prediction_summary(df).collect()] == [("A", 3, 75.0), ("B", 2, 50.0)]
