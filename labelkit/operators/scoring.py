"""Batch scoring by any model, row-level failures, and a Spark ML classifier."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[pd.DataFrame], pd.DataFrame]

BATCH = 1_000


def _parse_schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def score(
    df: DataFrame,
    scorer_factory: Callable[[], Scorer],
    out_schema: str | T.StructType,
    on_error: str = "fail",
    timing: bool = False,
) -> DataFrame:
    """Input columns plus what the model says about each row.

    ``scorer_factory`` runs once per task and returns a function from a batch of rows to a frame of
    ``out_schema`` columns, in the same order.  With ``on_error="row"`` a failing batch is halved
    until the bad rows stand alone; these get status ``ERROR`` and a message, and the job goes on.
    ``timing`` adds the seconds spent per row of the batch.  A batch has at most ``BATCH`` rows, so that what a worker
    holds beside Arrow's own batch stays small.  Select only the columns needed before
    the call: what comes in is copied to Python and back.
    """
    if on_error not in ("fail", "row"):
        raise ValueError(f"unknown on_error {on_error!r}")
    out = _parse_schema(out_schema)
    names = out.fieldNames()
    full = T.StructType(list(df.schema.fields) + list(out.fields))
    if on_error == "row":
        full = full.add("status", "string").add("error", "string")
    if timing:
        full = full.add("elapsed_s", "double")

    def run(scorer: Scorer, batch: pd.DataFrame) -> pd.DataFrame:
        if on_error == "fail":
            return scorer(batch)[names].reset_index(drop=True)
        try:
            done = scorer(batch)[names].reset_index(drop=True)
            if len(done) != len(batch):
                raise ValueError(f"scorer gave {len(done)} rows for {len(batch)}")
            return done.assign(status="OK", error=None)
        except Exception as failure:  # the model's own errors are data here
            if len(batch) == 1:
                row = {name: [None] for name in names}
                return pd.DataFrame({**row, "status": ["ERROR"], "error": [str(failure)]}, dtype=object)
            half = len(batch) // 2
            parts = [run(scorer, batch.iloc[:half]), run(scorer, batch.iloc[half:])]
            return pd.concat([p.astype(object) for p in parts], ignore_index=True)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for batch in (arrived.iloc[at : at + BATCH] for arrived in batches for at in range(0, len(arrived), BATCH)):
            began = time.perf_counter()
            found = run(scorer, batch)
            joined = pd.concat([batch.reset_index(drop=True), found], axis=1)
            if timing:
                joined["elapsed_s"] = (time.perf_counter() - began) / len(batch)
            yield joined[full.fieldNames()]

    return df.mapInPandas(task, full)


def linear_scorer(weights: Sequence[float], vector: str, bias: float = 0.0) -> Callable[[], Scorer]:
    """Factory of a dot product with fixed weights."""

    def build() -> Scorer:
        import numpy as np

        w = np.asarray(weights, dtype="float64")

        def apply(batch: pd.DataFrame) -> pd.DataFrame:
            rows = np.stack([np.asarray(v, dtype="float64") for v in batch[vector]])
            return pd.DataFrame({"score": rows @ w + bias})

        return apply

    return build


def only_scored(df: DataFrame) -> DataFrame:
    """Rows the model could handle."""
    return df.where(F.col("status") != "ERROR")


def train_classifier(
    df: DataFrame,
    features: str,
    label: str,
    split: str = "split",
    reg_params: Sequence[float] = (0.0, 0.01, 0.1),
    max_iter: int = 20,
) -> tuple[object, DataFrame]:
    """Fit on train, keep the candidate with the best validation accuracy, measure on test.

    Returns the Spark ML model and the scored test rows (label, prediction).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = df.select(
        array_to_vector(F.col(features).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
        F.col(split).alias("split"),
    )
    train, val, test = (rows.where(F.col("split") == s) for s in ("train", "val", "test"))
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    fitted = [LogisticRegression(maxIter=max_iter, regParam=r).fit(train) for r in reg_params]
    best = max(fitted, key=lambda m: judge.evaluate(m.transform(val)))
    return best, best.transform(test).select("label", "prediction")


def train_gaussian(df: DataFrame, features: str, label: str, split: str = "split") -> tuple[object, DataFrame]:
    """Naive Bayes with a normal density per class and feature: one pass of sums, no iterations.

    Returns the Spark ML model and the scored test rows (label, prediction).
    """
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.functions import array_to_vector

    rows = df.select(
        array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), F.col(split).alias("split")
    )
    model = NaiveBayes(modelType="gaussian").fit(rows.where(F.col("split") == "train"))
    return model, model.transform(rows.where(F.col("split") == "test")).select("label", "prediction")
