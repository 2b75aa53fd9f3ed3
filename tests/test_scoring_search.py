from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelkit.operators import metrics, sampling, scoring, search


def test_linear_scorer_and_timing(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    scored = scoring.score(df, scoring.linear_scorer([1.0, 10.0], "v", 0.5), "score double", timing=True)
    rows = {r.id: r for r in scored.collect()}
    assert rows[1].score == 21.5 and rows[2].score == 10.5 and rows[1].elapsed_s >= 0


def _picky():
    def factory():
        def apply(batch):
            import pandas as pd

            if (batch["id"] % 10 == 3).any():
                raise ValueError("three")
            return pd.DataFrame({"double": batch["id"] * 2, "name": batch["id"].astype(str)})

        return apply

    return factory


def test_failing_rows_become_errors_and_the_rest_is_scored(spark):
    scored = scoring.score(spark.range(100).repartition(3), _picky(), "double bigint, name string", on_error="row")
    rows = {r.id: r for r in scored.collect()}
    assert len(rows) == 100
    for i, r in rows.items():
        if i % 10 == 3:
            assert (r.status, r.error, r.double) == ("ERROR", "three", None)
        else:
            assert (r.status, r.error, r.double, r.name) == ("OK", None, 2 * i, str(i))
    assert scoring.only_scored(scored).count() == 90


def test_all_rows_fail(spark):
    def factory():
        def apply(batch):
            raise RuntimeError("no model")

        return apply

    scored = scoring.score(spark.range(5), factory, "x double", on_error="row")
    assert {(r.status, r.error) for r in scored.collect()} == {("ERROR", "no model")}


def test_failure_stops_the_job_by_default(spark):
    with pytest.raises(Exception, match="three"):
        scoring.score(spark.range(10), _picky(), "double bigint, name string").collect()
    with pytest.raises(ValueError):
        scoring.score(spark.range(1), _picky, "x int", on_error="maybe")


def test_wrong_row_count_is_an_error(spark):
    scored = scoring.score(spark.range(2).coalesce(1), lambda: lambda b: pd.DataFrame({"x": [1.0] * 3}), "x double", on_error="row")
    assert {r.status for r in scored.collect()} == {"ERROR"}


def test_train_classifier_learns(spark):
    rows = spark.range(300).select(
        "id", F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("v"), (F.col("id") % 3).alias("label")
    )
    split = sampling.three_way_split(rows, "id")
    _, tested = scoring.train_classifier(split, "v", "label", reg_params=(0.0, 0.1))
    assert tested.count() == 30
    assert metrics.weighted_metrics(tested, "label", "prediction").first().accuracy > 0.9


@pytest.fixture(scope="module")
def dev(spark):
    return spark.createDataFrame([(i, "x" if i % 4 else "y") for i in range(8)], "id int, label string")


def test_candidates(dev):
    cands = {
        (0, "basic"): F.lit("x"),
        (0, "teleprompter"): F.lit("y"),
        (0, "bootstrap"): F.col("label"),
        (1, "basic"): F.col("label"),
        (1, "teleprompter"): F.lit(None).cast("string"),
        (1, "bootstrap"): F.lit("y"),
    }
    scores = search.evaluate_candidates(dev, "label", cands)
    table = {r.prompt_id: tuple(r)[1:] for r in search.score_table(scores).collect()}
    assert table == {0: (0.75, 0.25, 1.0, 1.0), 1: (1.0, 0.0, 0.25, 1.0)}
    # both prompts reach 1.0: the first one wins, with its own best method
    assert tuple(search.best_candidate(scores).first()) == (0, "bootstrap", 1.0)


def test_method_order_breaks_ties(dev):
    cands = {(0, m): F.lit("x") for m in reversed(search.METHODS)}
    assert search.best_candidate(search.evaluate_candidates(dev, "label", cands)).first().method == "basic"


def test_dev_rows(dev):
    scores = search.evaluate_candidates(dev, "label", {(0, "basic"): F.lit("x")}, dev_rows=2, order="id")
    assert scores.first().score == 0.5
    with pytest.raises(ValueError):
        search.evaluate_candidates(dev, "label", {(0, "basic"): F.lit("x")}, dev_rows=2)


def test_evaluate_prompts_with_a_model(dev):
    def factory():
        return lambda texts, prompt: [prompt if t % 2 else "y" for t in texts]

    scores = search.evaluate_prompts(dev, "id", "label", ["x", "y"], factory)
    assert {r.prompt_id: r.score for r in scores.collect()} == {0: 0.75, 1: 0.25}


def test_demos_grid_and_fewshot(spark, dev):
    demos = search.bootstrap_demos(dev, F.lit("y"), "label", "id", 1)
    assert [r.id for r in demos.collect()] == [0]
    grid = search.search_grid(dev, "label", ["x", "y"], ["keep", "label"], lambda i, d: F.lit(i) if d == "keep" else F.col("label"))
    assert {(r.instruction, r.demos): r.score for r in grid.collect()} == {
        ("x", "keep"): 0.75, ("x", "label"): 1.0, ("y", "keep"): 0.25, ("y", "label"): 1.0,
    }
    few = search.render_fewshot(dev.withColumn("t", F.concat(F.lit("q"), "id")), "t", "label", "id", 2)
    assert few.first().examples == '- "q0" → y\n- "q1" → x'
    assert len(search.render_fewshot(spark.range(300).withColumn("t", F.lit("a")), "t", "t", "id", 250).first().examples.split("\n")) == 250
    tried = search.try_inputs(spark.createDataFrame([("a",)], "text string"), F.upper("text"))
    assert tuple(tried.first()) == ("a", "A")


def test_prompts_are_attached_by_id(spark):
    prompts = search.prompt_table(spark, ["a", "b"])
    rows = spark.createDataFrame([(1, 1), (2, 7)], "id int, prompt_id int")
    assert {r.id: r.prompt for r in search.attach_prompt(rows, prompts).collect()} == {1: "b", 2: None}


def test_models_get_batches_of_bounded_size(spark):
    def factory():
        return lambda batch: pd.DataFrame({"size": [len(batch)] * len(batch)})

    sizes = scoring.score(spark.range(4_500).coalesce(1), factory, "size long").groupBy("size").count().collect()
    assert {(r["size"], r["count"]) for r in sizes} == {(1_000, 4_000), (500, 500)}
