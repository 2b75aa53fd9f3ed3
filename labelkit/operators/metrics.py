"""Evaluation tables. Each one shuffles the rows once, as counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.functions.text import label_set, predicted_label_set, same_labels, split_labels
from labelkit.operators.bounded import local_table


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _prf(tp: Column, n_pred: Column, n_true: Column) -> dict[str, Column]:
    return {
        "precision": _ratio(tp, n_pred),
        "recall": _ratio(tp, n_true),
        "f1": _ratio(2.0 * tp, n_pred + n_true),
    }


def join_predictions(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Truth and prediction of the same row."""
    return truth.join(predictions, key, "inner")


def split_sizes(df: DataFrame, by: str | Sequence[str] = "split") -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def mean_metric(df: DataFrame, metric: Column, name: str = "score") -> DataFrame:
    """Mean of a per-row metric over the table."""
    return df.agg(F.avg(metric).alias(name))


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (label, prediction) pair: at most classes squared rows."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )


def per_class(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support for every class seen as truth or as prediction."""
    n, hit = F.col("n"), F.col("label") == F.col("pred")
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.when(hit, n).otherwise(none).alias("tp"),
            n.alias("n_true"),
            none.alias("n_pred"),
        ),
        F.struct(F.col("pred").alias("class"), none.alias("tp"), none.alias("n_true"), n.alias("n_pred")),
    )
    counts = (
        pairs.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "n_true", "n_pred")])
    )
    return counts.withColumns(_prf(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def _weighted(name: str) -> Column:
    return _ratio(F.sum(F.col(name) * F.col("n_true")), F.sum("n_true"))


def weighted_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, one row (per ``by``)."""
    classes = per_class(confusion(df, label, pred, by), by)
    return classes.groupBy(*by).agg(
        _ratio(F.sum("tp"), F.sum("n_true")).alias("accuracy"),
        _weighted("f1").alias("f1"),
        _weighted("precision").alias("precision"),
        _weighted("recall").alias("recall"),
    )


def metric_rows(wide: DataFrame, metrics: Sequence[str] = ("accuracy", "f1", "precision", "recall")) -> DataFrame:
    """(metric, value) rows of a one-row metric table."""
    return wide.unpivot([], list(metrics), "metric", "value")


def per_class_accuracy(
    df: DataFrame, label: str, pred: str, skip: Sequence[str] = ("others",)
) -> DataFrame:
    """Share of each class's rows that were predicted right (its recall), and their number."""
    kept = df.where(~F.col(label).isin(list(skip))) if skip else df
    hit = F.coalesce(F.col(label) == F.col(pred), F.lit(False)).cast("double")
    return kept.groupBy(F.col(label).alias("label")).agg(
        F.avg(hit).alias("accuracy"), F.count("*").alias("count")
    )


def classification_report(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class, then accuracy, macro average and weighted average.

    The class set is the union of true and predicted classes, also for the macro average.  The
    three summary rows and the class rows share one confusion aggregate.
    """
    return report_of_counts(confusion(df, label, pred, by), by)


def report_of_counts(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The report from (label, pred, n) counts, however they were made."""
    classes = per_class(pairs, by)
    rows = classes.select(*by, F.col("class").alias("name"), "precision", "recall", "f1", F.col("n_true").alias("support"))
    totals = classes.groupBy(*by).agg(
        _ratio(F.sum("tp"), F.sum("n_true")).alias("acc"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[_weighted(m).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        F.sum("n_true").alias("support"),
    )

    def line(name: str, precision: str, recall: str, f1: str) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.col(precision).alias("precision"),
            F.col(recall).alias("recall"),
            F.col(f1).alias("f1"),
            F.col("support"),
        )

    summary = totals.select(
        *by,
        F.inline(
            F.array(
                line("accuracy", "acc", "acc", "acc"),
                line("macro avg", "macro_precision", "macro_recall", "macro_f1"),
                line("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"),
            )
        ),
    )
    return rows.unionByName(summary)


def label_set_detail(
    df: DataFrame, truth: str, prediction: str, compat: bool = False
) -> DataFrame:
    """Adds true_set, pred_set and is_correct from two joined-label columns.

    By default a "Safe Content" answer and "no label" are the same on both sides.  ``compat=True``
    empties a safe answer but not a safe truth, so safe rows always count as wrong.
    """
    return df.withColumns(
        {
            "true_set": label_set(truth, compat=compat),
            "pred_set": predicted_label_set(prediction, compat=compat),
        }
    ).withColumn("is_correct", same_labels(F.col("true_set"), F.col("pred_set")))


def exact_set_accuracy(detail: DataFrame) -> DataFrame:
    """Share of rows whose label set is exactly right."""
    return detail.agg(
        F.coalesce(F.avg(F.col("is_correct").cast("double")), F.lit(0.0)).alias("accuracy"),
        F.count("*").alias("total"),
    )


def multilabel_prf(detail: DataFrame, categories: Sequence[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of every listed category.

    Truth and prediction sit on the same row, so their union is exploded in place: no join, and
    one shuffle of per-category counts.
    """
    names = local_table(detail.sparkSession, {"category": categories}, "category string")
    flags = detail.select(
        F.explode(F.array_union("true_set", "pred_set")).alias("category"), "true_set", "pred_set"
    ).select(
        "category",
        F.array_contains("true_set", F.col("category")).alias("in_true"),
        F.array_contains("pred_set", F.col("category")).alias("in_pred"),
    )
    counts = flags.groupBy("category").agg(
        F.count_if(F.col("in_true") & F.col("in_pred")).alias("tp"),
        F.count_if(~F.col("in_true") & F.col("in_pred")).alias("fp"),
        F.count_if(F.col("in_true") & ~F.col("in_pred")).alias("fn"),
    )
    zero = F.lit(0).cast("bigint")
    tp, fp, fn = (F.coalesce(F.col(c), zero) for c in ("tp", "fp", "fn"))
    measures = _prf(tp, tp + fp, tp + fn)
    return names.join(counts, "category", "left").select(
        "category",
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        *[value.alias(name) for name, value in measures.items()],
    )


def prediction_summary(df: DataFrame, prediction: str = "prediction", error: str = "ERROR") -> DataFrame:
    """How often each label was predicted, and its share of all rows, failed rows included."""
    counts = df.groupBy(F.col(prediction).alias("p")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").cast("double").alias("total"))
    # labels and the total both come from the table of distinct predictions, which is computed once
    shown = counts.where(F.col("p") != error).select(F.explode(split_labels("p")).alias("category"), "c").groupBy("category").agg(F.sum("c").alias("n"))
    return shown.select("category", "n", F.round(100.0 * F.col("n") / total.scalar(), 1).alias("pct")).orderBy(
        F.desc("n"), F.asc("category")
    )
