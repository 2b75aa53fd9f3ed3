"""Waveform, logit and probability arrays; batch scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.functions import arrays
from labelkit.functions.hashing import unit_draw
from labelkit.operators import audio, sampling, scoring
from labelkit.plans.registry import query, table
from labelkit.plans.standins import (
    LOGITS_SQL,
    SEED,
    WAVE_SQL,
    checksum,
    checksum_sql,
    class_names,
    logits,
    noise_sql,
)


def _draw_sql(purpose: str) -> str:
    return f"(('0x' || substr(md5('42|{purpose}|' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _waves(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding")


@query(
    f"""
SELECT vec_id, 48 AS n_cut, 81 AS n_padded, {checksum_sql('a[1:48]')} AS cut,
       round(list_sum(list_transform(a, lambda x, i: x * (i + 8))), 6) AS padded
FROM ({WAVE_SQL})
"""
)
def fix_length(spark: SparkSession, folder: str) -> DataFrame:
    """64 samples cut to 48, and centred in 81 (8 zeros left, 9 right)."""
    cut, padded = arrays.fix_length("embedding", 48), arrays.fix_length("embedding", 81)
    return _waves(spark, folder).select(
        "vec_id", F.size(cut).alias("n_cut"), F.size(padded).alias("n_padded"), checksum(cut).alias("cut"), checksum(padded).alias("padded")
    )


SHIFT_SQL = f"trunc(64 * (-0.2::DOUBLE + 0.4::DOUBLE * {_draw_sql('shift')}))::INTEGER"


@query(
    f"""
WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS a, {SHIFT_SQL} AS shift FROM embeddings)
SELECT vec_id, shift, 64 AS n,
       round(list_sum(list_transform(a, lambda x, i: CASE WHEN i + shift BETWEEN 1 AND 64 THEN x * (i + shift) ELSE 0 END)), 6) AS shifted
FROM w
"""
)
def time_shift(spark: SparkSession, folder: str) -> DataFrame:
    shift = (64 * (F.lit(-0.2) + F.lit(0.4) * unit_draw(SEED, "shift", "vec_id"))).cast("int")
    rows = _waves(spark, folder).withColumn("shift", shift)
    moved = arrays.time_shift("embedding", F.col("shift"))
    return rows.select("vec_id", "shift", F.size(moved).alias("n"), checksum(moved).alias("shifted"))


NOISY_SQL = "list_transform({wave}, lambda x, i: greatest(least(x + noise[i] * {sigma}, 1), -1))"


@query(
    f"""
SELECT vec_id, 64 AS n, {checksum_sql(NOISY_SQL.format(wave='a', sigma='0.03::DOUBLE'))} AS checksum
FROM ({noise_sql(WAVE_SQL, "vec_id", 64)})
"""
)
def add_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Seeded noise of sigma 0.03 on every waveform, clipped."""
    rows = _waves(spark, folder).withColumn("sigma", F.lit(0.03))
    noisy = audio.add_noise(rows, "embedding", "sigma", "vec_id", SEED)
    return noisy.select("vec_id", F.size("noisy").alias("n"), checksum(F.col("noisy")).alias("checksum"))


@query(
    f"SELECT vec_id, {checksum_sql('list_transform(a, lambda y: greatest(least(y * 10, 1), -1))')} AS clipped FROM ({WAVE_SQL})"
)
def clip_array(spark: SparkSession, folder: str) -> DataFrame:
    loud = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 10)
    return _waves(spark, folder).select("vec_id", checksum(arrays.clip_array(loud)).alias("clipped"))


PLANNED_SQL = f"""
WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) AS rn, count(*) OVER () AS n FROM embeddings),
s AS (SELECT vec_id, rn <= n - ceil(n * 0.2::DOUBLE) AS is_train FROM r),
k AS (SELECT vec_id, CASE WHEN is_train AND {_draw_sql('gate')} >= 0.5
        THEN ['time_shift', 'speed', 'noise', 'all'][('0x' || substr(md5('42|kind|' || vec_id), 1, 8))::BIGINT % 4 + 1]
        ELSE 'none' END AS augmentation FROM s)
"""


@query(
    f"""{PLANNED_SQL}SELECT vec_id, augmentation,
       CASE WHEN augmentation IN ('time_shift', 'all') THEN {SHIFT_SQL} ELSE 0 END AS shift,
       CASE WHEN augmentation IN ('speed', 'all') THEN round(0.9::DOUBLE + 0.2::DOUBLE * {_draw_sql('speed')}, 6) END AS speed,
       CASE WHEN augmentation IN ('noise', 'all') THEN round(0.01::DOUBLE + 0.04::DOUBLE * {_draw_sql('sigma')}, 6) END AS sigma
FROM k
"""
)
def augment_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Which train rows are augmented, and how."""
    rows = sampling.random_split(_waves(spark, folder), "vec_id", 0.2, SEED)
    planned = audio.augment_plan(rows, "vec_id", F.size("embedding"), SEED, F.col("split") == "train")
    return planned.select(
        "vec_id", "augmentation", F.coalesce("shift", F.lit(0)).alias("shift"), F.round("speed", 6).alias("speed"), F.round("sigma", 6).alias("sigma")
    )


SHIFTED_SQL = "list_transform(range(1, 65), lambda i: CASE WHEN i - shift BETWEEN 1 AND 64 THEN a[i - shift] ELSE 0 END)"
CHANGED_SQL = f"CASE WHEN shift IS NULL THEN a ELSE {SHIFTED_SQL} END"


@query(
    f"""{PLANNED_SQL},
p AS (SELECT vec_id, augmentation, embedding::DOUBLE[] AS a,
             CASE WHEN augmentation IN ('time_shift', 'all') THEN {SHIFT_SQL} END AS shift,
             CASE WHEN augmentation IN ('noise', 'all') THEN 0.01::DOUBLE + 0.04::DOUBLE * {_draw_sql('sigma')} END AS sigma
      FROM k JOIN embeddings USING (vec_id)),
c AS (SELECT vec_id, augmentation, sigma, {CHANGED_SQL} AS b FROM p),
z AS ({noise_sql("SELECT vec_id FROM embeddings", "vec_id", 64)})
SELECT vec_id, augmentation, 64 AS n,
       CASE WHEN sigma IS NULL THEN {checksum_sql('b')} ELSE {checksum_sql(NOISY_SQL.format(wave='b', sigma='sigma'))} END AS checksum
FROM c JOIN z USING (vec_id)
"""
)
def augment(spark: SparkSession, folder: str) -> DataFrame:
    """Train waveforms shifted and made noisy as planned; the others as they are."""
    rows = sampling.random_split(_waves(spark, folder), "vec_id", 0.2, SEED)
    made = audio.augment(rows, "embedding", "vec_id", SEED, F.col("split") == "train")
    return made.select("vec_id", "augmentation", F.size("augmented").alias("n"), checksum(F.col("augmented")).alias("checksum"))


@query(
    f"""
WITH m AS (SELECT vec_id, a, list_avg(a) AS mean FROM ({WAVE_SQL})),
v AS (SELECT vec_id, list_transform(a, lambda x: x - mean) AS c FROM m),
s AS (SELECT vec_id, c, sqrt(list_avg(list_transform(c, lambda x: x * x)) + 1e-7::DOUBLE) AS sd FROM v)
SELECT vec_id, round(list_sum(list_transform(c, lambda x, i: x / sd * i)), 6) AS scaled FROM s
"""
)
def zscore_array(spark: SparkSession, folder: str) -> DataFrame:
    return _waves(spark, folder).select("vec_id", checksum(arrays.zscore_array("embedding")).alias("scaled"))


@query(
    f"""
WITH w AS (SELECT vec_id, list_concat(list_concat(list_resize([]::DOUBLE[], 8, 0), a), list_resize([]::DOUBLE[], 8, 0)) AS a FROM ({WAVE_SQL})),
m AS (SELECT vec_id, a, list_avg(a) AS mean FROM w),
s AS (SELECT vec_id, a, mean, sqrt(list_avg(list_transform(a, lambda x: (x - mean) * (x - mean))) + 1e-7::DOUBLE) AS sd FROM m)
SELECT vec_id, 80 AS n, round(list_sum(list_transform(a, lambda x, i: (x - mean) / sd * i)), 6) AS scaled FROM s
"""
)
def standardise_waves(spark: SparkSession, folder: str) -> DataFrame:
    """Waveforms centred in 80 samples and normalised, over Arrow buffers."""
    made = audio.standardise_waves(_waves(spark, folder), "embedding", 80, dtype="double")
    return made.select("vec_id", F.size("input_values").alias("n"), checksum(F.col("input_values")).alias("scaled"))


@query(
    f"""
SELECT vec_id, 32 AS n, round(list_sum(list_transform(range(1, 33), lambda i: (a[2 * i - 1] + a[2 * i]) / 2 * i)), 6) AS mono
FROM ({WAVE_SQL})
"""
)
def to_mono(spark: SparkSession, folder: str) -> DataFrame:
    """64 samples as 32 stereo frames."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice(F.col("embedding"), i * 2 + 1, 2))
    mono = arrays.to_mono(frames)
    return _waves(spark, folder).select("vec_id", F.size(mono).alias("n"), checksum(mono).alias("mono"))


@query(
    f"""
WITH w AS (SELECT vec_id, list_transform(a, lambda x: x * 4) AS a FROM ({WAVE_SQL})),
p AS (SELECT vec_id, a, list_max(list_transform(a, lambda x: abs(x))) AS peak FROM w)
SELECT vec_id, peak > 1 AS loud, round(list_sum(list_transform(a, lambda x, i: x * i)) / CASE WHEN peak > 1 THEN peak ELSE 1 END, 6) AS normed
FROM p
"""
)
def peak_norm(spark: SparkSession, folder: str) -> DataFrame:
    wave = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 4)
    loud = F.array_max(F.transform(wave, F.abs)) > 1
    return _waves(spark, folder).select("vec_id", loud.alias("loud"), checksum(arrays.peak_norm(wave)).alias("normed"))


# -- classes -----------------------------------------------------------------------------------

SOFT_SQL = """
SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p
FROM (SELECT vec_id, label, list_transform({z}, lambda x: exp(x - list_max({z}))) AS e FROM ({rows}))
"""
SOFT_ALL_SQL = SOFT_SQL.format(z="z", rows=LOGITS_SQL)
SOFT_KNOWN_SQL = SOFT_SQL.format(z="list_concat(z[1:9], z[11:64])", rows=LOGITS_SQL)


def _logits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", logits().alias("z"))


@query(f"SELECT vec_id, label, (list_position(z, list_max(z)) - 1)::INTEGER AS pred FROM ({LOGITS_SQL})")
def argmax_class(spark: SparkSession, folder: str) -> DataFrame:
    return _logits(spark, folder).select("vec_id", "label", arrays.argmax("z").alias("pred"))


@query(
    f"""
WITH u AS (SELECT vec_id, unnest(p) AS prob, generate_subscripts(p, 1) - 1 AS i FROM ({SOFT_ALL_SQL})),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, i) AS pos FROM u)
SELECT vec_id, pos::INTEGER - 1 AS pos, CASE WHEN i = 9 THEN 'others' ELSE 'class_' || i END AS label, round(prob, 6) AS prob FROM r WHERE pos <= 3
"""
)
def topk_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Three most likely classes with their probabilities."""
    rows = _logits(spark, folder).withColumn("p", arrays.softmax("z"))
    best = arrays.top_k(F.col("p"), class_names(), 3)
    return rows.select("vec_id", F.posexplode(best).alias("pos", "best")).select(
        "vec_id", "pos", "best.label", F.round("best.prob", 6).alias("prob")
    )


@query(
    f"""
SELECT vec_id, len(p)::INTEGER AS n, round(list_sum(p), 6) AS total, {checksum_sql('p')} AS checksum FROM ({SOFT_KNOWN_SQL})
"""
)
def softmax_no_others(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p")
    rows = _logits(spark, folder).withColumn("p", arrays.softmax(arrays.drop_named("z", class_names(), "others")))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.size(p).alias("n"), F.round(total, 6).alias("total"), checksum(p).alias("checksum"))


@query(
    f"""
SELECT vec_id, CASE WHEN top < 0.021::DOUBLE THEN 'others' ELSE 'class_' || i END AS pred,
       CASE WHEN top < 0.021::DOUBLE THEN 9 ELSE i END::INTEGER AS class_id, round(top, 6) AS confidence
FROM (SELECT vec_id, list_max(p) AS top, CASE WHEN list_position(p, list_max(p)) <= 9 THEN list_position(p, list_max(p)) - 1
             ELSE list_position(p, list_max(p)) END AS i FROM ({SOFT_KNOWN_SQL}))
"""
)
def open_set_label(spark: SparkSession, folder: str) -> DataFrame:
    """Most likely class by name and id among all, or others when none reaches 0.021."""
    rows = _logits(spark, folder).withColumn("p", arrays.softmax(arrays.drop_named("z", class_names(), "others")))
    known = arrays.without_name(class_names(), "others")
    label = arrays.open_set_label(F.col("p"), known, 0.021, F.lit("others"))
    named = rows.select("vec_id", label.alias("pred"), F.round(F.array_max("p"), 6).alias("confidence"))
    return named.select("vec_id", "pred", arrays.class_id(F.col("pred"), class_names()).alias("class_id"), "confidence")


# -- scoring -----------------------------------------------------------------------------------

WEIGHTS = [((i * 7) % 11 - 5) / 10.0 for i in range(64)]


@query(
    "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x * (((i - 1) * 7) % 11 - 5) / 10.0::DOUBLE)), 6) AS score "
    "FROM embeddings"
)
def score_linear(spark: SparkSession, folder: str) -> DataFrame:
    """A linear model as batch scorer."""
    scored = scoring.score(_waves(spark, folder), scoring.linear_scorer(WEIGHTS, "embedding"), "score double")
    return scored.select("vec_id", F.round("score", 6).alias("score"))


@query(
    """
SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN 'ERROR' ELSE 'OK' END AS status,
       CASE WHEN vec_id % 50 = 7 THEN 'bad row ' || vec_id END AS error,
       CASE WHEN vec_id % 50 <> 7 THEN round(list_sum(embedding::DOUBLE[]), 6) END AS score
FROM embeddings
"""
)
def score_with_errors(spark: SparkSession, folder: str) -> DataFrame:
    """A scorer that refuses some rows: they become ERROR rows, the others are scored."""

    def factory():
        import pandas as pd

        def apply(batch):
            bad = batch.loc[batch["vec_id"] % 50 == 7, "vec_id"]
            if len(bad):
                raise ValueError(f"bad row {bad.iloc[0]}")
            return pd.DataFrame({"score": [float(sum(map(float, v))) for v in batch["embedding"]]})

        return apply

    scored = scoring.score(_waves(spark, folder), factory, "score double", on_error="row")
    return scored.select("vec_id", "status", "error", F.round("score", 6).alias("score"))


@query(
    """
WITH h AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) AS rn, count(*) OVER () AS n FROM embeddings),
s AS (SELECT *, CASE WHEN rn <= n - ceil(n * 0.2::DOUBLE) THEN 'train' WHEN rn <= n - ceil(ceil(n * 0.2::DOUBLE) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM h),
x AS (SELECT vec_id, label, split, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM s),
m AS (SELECT label, i, avg(v) AS mu, avg(v * v) - avg(v) * avg(v) AS var, count(*) AS c FROM x WHERE split = 'train' GROUP BY label, i),
l AS (SELECT x.vec_id, x.label, m.label AS pred, sum(-0.5::DOUBLE * ln(2 * pi() * var) - (v - mu) * (v - mu) / (2 * var)) + ln(max(c)) AS ll
      FROM x JOIN m USING (i) WHERE split = 'test' GROUP BY ALL),
b AS (SELECT vec_id, any_value(label) AS label, arg_max(pred, ll) AS pred FROM l GROUP BY vec_id)
SELECT label, count(*) AS n, count(*) FILTER (WHERE label = pred) AS hits FROM b GROUP BY label
"""
)
def train_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Gaussian naive Bayes trained on 80 %: rows and hits per class on the last 10 %."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    split = sampling.three_way_split(rows, "vec_id", seed=SEED)
    _, tested = scoring.train_gaussian(split, "embedding", "label")
    return tested.groupBy(F.col("label").cast(rows.schema["label"].dataType).alias("label")).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("hits")
    )
