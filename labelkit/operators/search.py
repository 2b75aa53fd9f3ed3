"""Which prompt, and which way of using it, does best on labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.operators.bounded import join_small, local_table
from labelkit.operators.sampling import head_n
from labelkit.operators.scoring import score

Metric = Callable[[Column, Column], Column]

# The ways a prompt is tried, in the order that wins ties.
METHODS = ("basic", "teleprompter", "bootstrap")


def accuracy_metric(pred: Column, gold: Column) -> Column:
    return F.coalesce(pred == gold, F.lit(False)).cast("double")


def evaluate_candidates(
    dev: DataFrame,
    label: str,
    candidates: Mapping[tuple[int, str], Column],
    metric: Metric = accuracy_metric,
    dev_rows: int | None = None,
    order: str | None = None,
) -> DataFrame:
    """Mean metric of each (prompt_id, method) candidate: rows (prompt_id, method, score).

    Every candidate is a column over the dev rows, so one pass over the table scores them all and
    no row is copied per candidate.  ``dev_rows`` limits the evaluation to the first rows in
    ``order``; None takes the whole table.
    """
    if dev_rows is not None:
        if order is None:
            raise ValueError("dev_rows needs an order column")
        dev = head_n(dev, order, dev_rows)
    keys = list(candidates)
    means = dev.agg(
        *[F.avg(metric(candidates[k], F.col(label))).alias(f"c{i}") for i, k in enumerate(keys)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(p).cast("int").alias("prompt_id"),
                F.lit(m).alias("method"),
                F.col(f"c{i}").alias("score"),
            )
            for i, (p, m) in enumerate(keys)
        ]
    )
    return means.select(F.inline(rows))


def evaluate_prompts(
    dev: DataFrame,
    text: str,
    label: str,
    prompts: Sequence[str],
    scorer_factory: Callable[[], Callable[[pd.Series, str], Sequence[str]]],
    metric: Metric = accuracy_metric,
) -> DataFrame:
    """Mean metric per prompt for a model that is called with a batch of texts and a prompt.

    The model answers all prompts while it holds the batch; rows are expanded after scoring, inside
    the task, and pre-aggregated there.
    """
    prompts = list(prompts)

    def factory() -> Callable[[pd.DataFrame], pd.DataFrame]:
        ask = scorer_factory()

        def apply(batch: pd.DataFrame) -> pd.DataFrame:
            answers = [list(ask(batch[text], prompt)) for prompt in prompts]
            return pd.DataFrame({"answers": [list(row) for row in zip(*answers)]})

        return apply

    scored = score(dev.select(text, label), factory, "answers array<string>")
    return (
        scored.select(F.posexplode("answers").alias("prompt_id", "answer"), label)
        .groupBy("prompt_id")
        .agg(F.avg(metric(F.col("answer"), F.col(label))).alias("score"))
    )


def score_table(scores: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """One row per prompt: a column per method, and their maximum."""
    wide = scores.groupBy("prompt_id").agg(
        *[F.max(F.when(F.col("method") == m, F.col("score"))).alias(m) for m in methods]
    )
    best = F.greatest(*[F.col(m) for m in methods]) if len(methods) > 1 else F.col(methods[0])
    return wide.withColumn("max_score", best)


def best_candidate(scores: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Best prompt, then its best method; the first one wins ties. The prompt keeps its own text."""
    place = F.coalesce(
        *[F.when(F.col("method") == m, F.lit(i)) for i, m in enumerate(methods)], F.lit(len(methods))
    )
    rank = F.struct(F.col("score"), -F.col("prompt_id"), -place)
    return scores.agg(F.max_by(F.struct("prompt_id", "method", "score"), rank).alias("best")).select("best.*")


def bootstrap_demos(
    train: DataFrame,
    pred: Column,
    label: str,
    order: str,
    k: int,
    metric: Metric = accuracy_metric,
    passes: float = 1.0,
) -> DataFrame:
    """First ``k`` training rows whose prediction passes the metric."""
    return head_n(train.where(metric(pred, F.col(label)) >= passes), order, k)


def search_grid(
    dev: DataFrame,
    label: str,
    instructions: Sequence[str],
    demo_sets: Sequence[str],
    scorer: Callable[[str, str], Column],
    metric: Metric = accuracy_metric,
) -> DataFrame:
    """Every instruction with every demo set: rows (instruction, demos, score)."""
    names = [(i, d) for i in instructions for d in demo_sets]
    flat = evaluate_candidates(
        dev, label, {(n, "grid"): scorer(i, d) for n, (i, d) in enumerate(names)}, metric
    )
    place = F.col("prompt_id") + 1
    return flat.select(
        F.element_at(F.array(*[F.lit(i) for i, _ in names]), place).alias("instruction"),
        F.element_at(F.array(*[F.lit(d) for _, d in names]), place).alias("demos"),
        "score",
    )


def render_fewshot(df: DataFrame, text: str, label: str, order: str, n: int = 10) -> DataFrame:
    """One row with the first ``n`` examples as ``- "text" → label`` lines."""
    few = head_n(df.select(order, text, label), order, n)
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("t"), F.col(label).alias("l")))),
        lambda r: F.concat(F.lit('- "'), r["t"], F.lit('" → '), r["l"].cast("string")),
    )
    return few.agg(F.array_join(lines, "\n").alias("examples"))


def prompt_table(spark: SparkSession, prompts: Sequence[str]) -> DataFrame:
    """(prompt_id, prompt). Rows carry the id; the text is attached where it is needed."""
    return local_table(spark, {"prompt_id": range(len(prompts)), "prompt": prompts}, "prompt_id int, prompt string")


def attach_prompt(df: DataFrame, prompts: DataFrame, prompt_id: str = "prompt_id") -> DataFrame:
    """Prompt text of each row's prompt id."""
    return join_small(df, prompts.select(F.col("prompt_id").alias(prompt_id), "prompt"), prompt_id, "left")


def try_inputs(texts: DataFrame, answer: Column, text: str = "text") -> DataFrame:
    """Smoke run of the chosen candidate on a few inputs."""
    return texts.select(text, answer.alias("answer"))
