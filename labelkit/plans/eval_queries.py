"""Metrics, reports and candidate search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.operators import metrics, sampling, search
from labelkit.plans.registry import query, table
from labelkit.plans.standins import (
    CATEGORY_SQL,
    PREDICTED_SQL,
    SEED,
    SPACED_SQL,
    category,
    frequent_hits,
    language_of,
    predict_language,
    predicted,
    word_counts,
    word_rule_sql,
)


def _ratio_sql(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN ({part})::DOUBLE / ({whole}) ELSE 0::DOUBLE END"


def _class_sql(rows: str, by: str = "") -> str:
    """Per class of ``rows`` (lang, pred): n_true, n_pred, tp and P/R/F1."""
    keys = f"{by}, " if by else ""
    using = f"({by}, class)" if by else "(class)"
    return f"""
SELECT {keys}class, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp,
       {_ratio_sql('coalesce(tp, 0)', 'coalesce(n_pred, 0)')} AS precision, {_ratio_sql('coalesce(tp, 0)', 'coalesce(n_true, 0)')} AS recall,
       {_ratio_sql('2 * coalesce(tp, 0)', 'coalesce(n_pred, 0) + coalesce(n_true, 0)')} AS f1
FROM (SELECT {keys}lang AS class, count(*) AS n_true, count(*) FILTER (WHERE lang = pred) AS tp FROM {rows} GROUP BY ALL)
FULL JOIN (SELECT {keys}pred AS class, count(*) AS n_pred FROM {rows} GROUP BY ALL) USING {using}
"""


def _report_sql(rows: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    r6 = ", ".join(f"round({m}, 6) AS {m}" for m in ("precision", "recall", "f1"))
    macro = ", ".join(f"round(avg({m}), 6)" for m in ("precision", "recall", "f1"))
    weighted = ", ".join(f"round(sum({m} * n_true) / sum(n_true), 6)" for m in ("precision", "recall", "f1"))
    acc = "round(sum(tp)::DOUBLE / sum(n_true), 6)"
    classes = f"({_class_sql(rows, by)})"
    return f"""
SELECT {keys}class AS name, {r6}, n_true AS support FROM {classes}
UNION ALL SELECT {keys}'accuracy', {acc}, {acc}, {acc}, sum(n_true)::BIGINT FROM {classes} GROUP BY ALL
UNION ALL SELECT {keys}'macro avg', {macro}, sum(n_true)::BIGINT FROM {classes} GROUP BY ALL
UNION ALL SELECT {keys}'weighted avg', {weighted}, sum(n_true)::BIGINT FROM {classes} GROUP BY ALL
"""


def _rounded(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


@query(f"WITH p AS ({PREDICTED_SQL}) {_report_sql('p')}")
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    """Language prediction: per class, accuracy, macro and weighted averages."""
    return _rounded(metrics.classification_report(predicted(spark, folder), "lang", "pred"))


@query(
    f"""
WITH p AS ({PREDICTED_SQL}), c AS ({_class_sql('p')})
SELECT round(sum(tp)::DOUBLE / sum(n_true), 6) AS accuracy, round(sum(f1 * n_true) / sum(n_true), 6) AS f1,
       round(sum(precision * n_true) / sum(n_true), 6) AS precision, round(sum(recall * n_true) / sum(n_true), 6) AS recall
FROM c
"""
)
def weighted_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.weighted_metrics(predicted(spark, folder), "lang", "pred"))


@query(
    f"""
SELECT lang AS label, round(avg(CASE WHEN lang = pred THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS count
FROM ({PREDICTED_SQL}) WHERE lang <> 'others' GROUP BY lang
"""
)
def per_class_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.per_class_accuracy(predicted(spark, folder), "lang", "pred"))


# -- label sets --------------------------------------------------------------------------------

SET_CATEGORIES = ["toxic", "junk", "Safe Content", "unseen"]
TRUTH_SQL = "coalesce(nullif(concat_ws(', ', CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'junk' END), ''), 'Safe Content')"
SETS_SQL = f"""
SELECT doc_id, string_split(truth, ', ') AS t, string_split(CASE doc_id % 5 WHEN 0 THEN 'Safe Content' WHEN 1 THEN 'junk'
       WHEN 2 THEN 'junk, toxic' ELSE truth END, ', ') AS p
FROM (SELECT doc_id, {TRUTH_SQL} AS truth FROM labels)
"""


def _label_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Joined truth and prediction strings of each labelled document, as sets."""
    named = F.concat_ws(", ", F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "junk"))
    rows = table(spark, folder, "labels").select("doc_id", named.alias("truth"))
    case = F.col("doc_id") % 5
    guess = (
        F.when(case == 0, "Safe Content").when(case == 1, "junk").when(case == 2, " junk ,toxic").otherwise(F.col("truth"))
    )
    return metrics.label_set_detail(rows.withColumn("pred", guess), "truth", "pred")


@query(
    f"SELECT round(avg(CASE WHEN list_sort(t) = list_sort(p) THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS total FROM ({SETS_SQL})"
)
def exact_set_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.exact_set_accuracy(_label_sets(spark, folder)))


@query(
    f"""
WITH s AS ({SETS_SQL}),
n AS (SELECT category, count(*) FILTER (WHERE list_contains(t, category) AND list_contains(p, category)) AS tp,
             count(*) FILTER (WHERE NOT list_contains(t, category) AND list_contains(p, category)) AS fp,
             count(*) FILTER (WHERE list_contains(t, category) AND NOT list_contains(p, category)) AS fn
      FROM s, (VALUES ('toxic'), ('junk'), ('Safe Content'), ('unseen')) AS c(category) GROUP BY category)
SELECT category, tp, fp, fn, round({_ratio_sql('tp', 'tp + fp')}, 6) AS precision, round({_ratio_sql('tp', 'tp + fn')}, 6) AS recall,
       round({_ratio_sql('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM n
"""
)
def multilabel_prf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.multilabel_prf(_label_sets(spark, folder), SET_CATEGORIES))


@query(
    """
WITH p AS (SELECT CASE event_type WHEN 'click' THEN ['click', 'engaged'] WHEN 'purchase' THEN ['purchase', 'engaged']
                  ELSE [event_type] END AS cats FROM events WHERE event_type <> 'error'),
u AS (SELECT unnest(cats) AS category FROM p)
SELECT category, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 1) AS pct FROM u GROUP BY category
"""
)
def prediction_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted labels of a scored table whose failed rows say ERROR."""
    kind = F.col("event_type")
    answer = (
        F.when(kind == "error", "ERROR").when(kind.isin("click", "purchase"), F.concat(kind, F.lit(", engaged"))).otherwise(kind)
    )
    return metrics.prediction_summary(table(spark, folder, "events").select(answer.alias("prediction")))


# -- candidates --------------------------------------------------------------------------------

CUTS = {0: 1, 1: 3, 2: None}
FALLBACKS = {"basic": "others", "teleprompter": "en", "bootstrap": "de"}


def _candidates() -> dict[tuple[int, str], Column]:
    return {(p, m): language_of(f"counts_{p}", nothing) for p in CUTS for m, nothing in FALLBACKS.items()}


def _counted_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the frequent-word counts each candidate decides by."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    hits = docs.select("doc_id", "lang", frequent_hits("text").alias("hits"))
    return hits.withColumns({f"counts_{p}": word_counts("hits", words) for p, words in CUTS.items()})


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return search.evaluate_candidates(_counted_docs(spark, folder), "lang", _candidates())


def _mean_sql(words: int | None, nothing: str) -> str:
    return f"avg(CASE WHEN {word_rule_sql(words, nothing)} = lang THEN 1 ELSE 0 END)"


SCORES_SQL = " UNION ALL ".join(
    f"SELECT {p}::INTEGER AS prompt_id, {i} AS place, '{m}' AS method, {_mean_sql(words, nothing)} AS score FROM s"
    for p, words in CUTS.items()
    for i, (m, nothing) in enumerate(FALLBACKS.items())
)


@query(
    f"""
WITH s AS ({SPACED_SQL}), c AS ({SCORES_SQL})
SELECT prompt_id, {', '.join(f"round(max(score) FILTER (WHERE method = '{m}'), 6) AS {m}" for m in FALLBACKS)}, round(max(score), 6) AS max_score
FROM c GROUP BY prompt_id
"""
)
def evaluate_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Mean accuracy of three word rules used in three ways, on all documents."""
    return _rounded(search.score_table(_scores(spark, folder)))


@query(
    f"""
WITH s AS ({SPACED_SQL}), c AS ({SCORES_SQL})
SELECT prompt_id, method, round(score, 6) AS score FROM c ORDER BY c.score DESC, prompt_id, place LIMIT 1
"""
)
def best_candidate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(search.best_candidate(_scores(spark, folder)))


@query(
    f"SELECT doc_id, lang FROM ({SPACED_SQL}) WHERE {word_rule_sql(1)} = lang ORDER BY doc_id LIMIT 16"
)
def bootstrap_demos(spark: SparkSession, folder: str) -> DataFrame:
    """First 16 documents a one-word rule gets right."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    demos = search.bootstrap_demos(docs, predict_language("text", 1), "lang", "doc_id", 16)
    return demos.select("doc_id", "lang")


@query(
    f"WITH s AS ({SPACED_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{words}' AS instruction, '{nothing}' AS demos, round({_mean_sql(None if words == 'all' else int(words), nothing)}, 6) AS score FROM s"
        for words in ("1", "3", "all")
        for nothing in ("others", "en")
    )
)
def search_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every instruction with every demo set."""

    def scorer(instruction: str, demos: str) -> Column:
        return language_of({"1": "counts_0", "3": "counts_1", "all": "counts_2"}[instruction], demos)

    grid = search.search_grid(_counted_docs(spark, folder), "lang", ["1", "3", "all"], ["others", "en"], scorer)
    return _rounded(grid)


PROMPTS = (" the ", " of ", " der ")


@query(
    " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS prompt_id, round(avg(CASE WHEN (CASE WHEN contains(text, '{p}') THEN 'en' ELSE 'others' END) = lang THEN 1.0 ELSE 0.0 END), 6) AS score FROM documents"
        for i, p in enumerate(PROMPTS)
    )
)
def evaluate_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of a model that is called with batches of texts and each prompt; here it looks for the prompt in the text."""

    def factory():
        return lambda texts, prompt: ["en" if prompt in t else "others" for t in texts]

    found = search.evaluate_prompts(table(spark, folder, "documents"), "text", "lang", PROMPTS, factory)
    return found.select("prompt_id", F.round("score", 6).alias("score"))


# -- the whole way -----------------------------------------------------------------------------

REPORT_BASE_SQL = f"""
SELECT split, category, lang, pred FROM ({PREDICTED_SQL}) JOIN (
  SELECT doc_id, category, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM (
    SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || doc_id), doc_id) AS rn,
           count(*) OVER (PARTITION BY category) AS n FROM (SELECT doc_id, {CATEGORY_SQL} AS category FROM labels))
) USING (doc_id)
"""


@query(
    f"""
WITH b AS ({REPORT_BASE_SQL})
{_report_sql('b', 'split')}
UNION ALL SELECT split, 'category ' || category, NULL, NULL, NULL, count(*) FROM b GROUP BY split, category
"""
)
def moderation_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each moderation category per split, and how good language prediction is there."""
    labels = table(spark, folder, "labels").select("doc_id", category().alias("category"))
    split = sampling.stratified_split(labels, "category", "doc_id", 0.8, SEED)
    # keys first, so the rule runs once and only on labelled documents; one aggregate serves both parts
    rows = metrics.join_predictions(split, table(spark, folder, "documents").select("doc_id", "lang", "text"), "doc_id")
    counts = rows.groupBy("split", "category", F.col("lang").alias("label"), predict_language("text").alias("pred")).agg(F.count("*").alias("n"))
    report = metrics.report_of_counts(counts, ["split"])
    sizes = counts.groupBy("split", "category").agg(F.sum("n").alias("support")).select(
        "split", F.concat(F.lit("category "), "category").alias("name"), "support"
    )
    return _rounded(report.unionByName(sizes, allowMissingColumns=True))
