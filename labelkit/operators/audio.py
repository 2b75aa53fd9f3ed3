"""Waveform rows: noise, augmentation plan, rate check."""

from __future__ import annotations

import statistics
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelkit.functions.arrays import fix_length, time_shift
from labelkit.functions.hashing import hash_int, unit_draw

# The sampling rate the speech models expect, the clip length in seconds, the
# augmentations to choose from, and the ranges their strength is drawn from.
TARGET_RATE = 16000
MAX_SECONDS = 5.0
AUGMENTATIONS = ["time_shift", "speed", "noise", "all"]
SHIFT_RANGE = (-0.2, 0.2)
SPEED_RANGE = (0.9, 1.1)
NOISE_RANGE = (0.01, 0.05)


# Fixed values of the noise generator: a prime modulus below 2**31, so that products of two values
# fit 63 bits in any engine, and the multipliers of its counter and of its two mixing steps.
NOISE_PRIME = 2**31 - 1
NOISE_STEP = 1640531527
NOISE_MIX = (739982445, 695872825)
NOISE_KNOTS = 1024


def normal_table() -> list[float]:
    """Normal quantiles at ``NOISE_KNOTS`` even steps, ends at 1/8 of a step, scaled to unit variance
    of the linear pieces between them and rounded to 6 places."""
    inverse = statistics.NormalDist().inv_cdf
    edge = 1 / (8 * NOISE_KNOTS)
    raw = [inverse(min(max(k / NOISE_KNOTS, edge), 1 - edge)) for k in range(NOISE_KNOTS + 1)]
    variance = sum((a * a + a * b + b * b) / 3 for a, b in zip(raw, raw[1:])) / NOISE_KNOTS
    return [round(q / variance**0.5, 6) for q in raw]


def noise_source(seed: int) -> Callable:
    """``draw(key, n, sigma)``: the same numbers for the same seed and integer key, on any worker.

    A counter-based generator: sample ``i`` depends on (seed, key, i) alone, by integer steps that SQL
    can repeat.  Each key has two 31-bit words, an offset of the counter and a second one mixed in
    later, so rows do not share shifted stretches of one sequence.  The uniform integer is turned into
    a normal value by ``normal_table``, linear between its knots.
    """
    import numpy as np

    table = np.asarray(normal_table())
    low_bits = 31 - (NOISE_KNOTS.bit_length() - 1)

    def mix(a):
        a = (a ^ (a >> 15)) * NOISE_MIX[0] % NOISE_PRIME
        a = (a ^ (a >> 13)) * NOISE_MIX[1] % NOISE_PRIME
        return a ^ (a >> 16)

    start = mix(seed % NOISE_PRIME)

    def draw(key: int, n: int, sigma: float):
        high, low = divmod(int(key), NOISE_PRIME)
        first = mix((mix((start + high) % NOISE_PRIME) + low) % NOISE_PRIME)
        second = mix((first + 1) % NOISE_PRIME)
        counter = (first + np.arange(n, dtype="int64") * NOISE_STEP) % NOISE_PRIME
        drawn = mix((mix(counter) + second) % NOISE_PRIME)
        knot, part = drawn >> low_bits, (drawn & ((1 << low_bits) - 1)) / (1 << low_bits)
        return (table[knot] + (table[knot + 1] - table[knot]) * part) * sigma

    return draw


def noise_rows(keys: DataFrame, key: str, n_samples: int, sigma: float = 0.1, seed: int = 42, rate: int = TARGET_RATE) -> DataFrame:
    """One white-noise waveform per integer key, the same one whenever it is made; a null key has none."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = noise_source(seed)
        for batch in batches:
            waves = [None if pd.isna(k) else draw(k, n_samples, sigma).astype("float32") for k in batch[key]]
            yield pd.DataFrame({key: batch[key], "array": waves})

    made = keys.select(key).mapInPandas(
        task, T.StructType([keys.schema[key], T.StructField("array", T.ArrayType(T.FloatType()))])
    )
    return made.select(
        key,
        F.struct("array", F.lit(rate).alias("sampling_rate")).alias("audio"),
        F.lit(-1).alias("language"),
        F.lit("noise").alias("language_str"),
        F.lit("noise").alias("original_lang"),
    )


def synthetic_noise(spark: SparkSession, n: int, n_samples: int = int(TARGET_RATE * MAX_SECONDS), sigma: float = 0.1, seed: int = 42) -> DataFrame:
    """``n`` noise rows from nothing, for a source that could not be read."""
    return noise_rows(spark.range(n), "id", n_samples, sigma, seed)


def map_waves(
    df: DataFrame,
    wave: str,
    column: str,
    build: Callable[[], Callable],
    extra: Sequence[str] = (),
    dtype: str = "float",
) -> DataFrame:
    """Adds ``column``: a numpy function of each row's waveform, the samples moved as Arrow buffers.

    Column expressions visit a waveform of 80,000 samples one boxed value at a time; a numpy pass
    over the Arrow buffer of a batch is about ten times faster.  ``build`` runs once per task and
    returns ``f(samples, *extra values)`` for one row; null waveforms stay null, and all other
    columns pass through untouched.
    """
    sample_type, np_type = {"float": (T.FloatType(), "float32"), "double": (T.DoubleType(), "float64")}[dtype]
    schema = T.StructType(list(df.schema.fields) + [T.StructField(column, T.ArrayType(sample_type))])
    extra = list(extra)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        apply = build()
        for batch in batches:
            waves = batch.column(batch.schema.get_field_index(wave))
            samples = waves.flatten().to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.list_value_length(waves), 0).to_numpy(zero_copy_only=False)
            missing = waves.is_null().to_numpy(zero_copy_only=False)
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in extra]
            made, at = [], 0
            for i, n in enumerate(lengths):
                piece = samples[at:at + n]
                made.append(piece[:0] if missing[i] else np.asarray(apply(piece, *[v[i] for v in values]), dtype=np_type))
                at += n
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype("int32")
            flat = np.concatenate(made) if made else np.empty(0, dtype=np_type)
            out = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array(missing))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, column])

    return df.mapInArrow(task, schema)


def standardise_waves(
    df: DataFrame,
    wave: str,
    n_samples: int | None = None,
    column: str = "input_values",
    eps: float = 1e-7,
    dtype: str = "float",
) -> DataFrame:
    """Model input of long waveforms: fixed length when asked for, then zero mean and unit variance.

    The same values as ``fix_length`` followed by ``zscore_array``.
    """
    fitted, source = (df, wave) if n_samples is None else (df.withColumn("__fitted", fix_length(wave, n_samples)), "__fitted")

    def build() -> Callable:
        import numpy as np

        def standardise(samples):
            x = samples.astype("float64")
            return x if len(x) == 0 else (x - x.mean()) / np.sqrt(x.var() + eps)

        return standardise

    return map_waves(fitted, source, column, build, dtype=dtype).drop("__fitted")


def add_noise(df: DataFrame, wave: str, sigma: str, key: str, seed: int = 42, column: str = "noisy") -> DataFrame:
    """Gaussian noise of each row's own ``sigma``, then clipped to [-1, 1]. Null sigma or key leaves the row."""

    def build() -> Callable:
        import numpy as np

        draw = noise_source(seed)

        def noisy(samples, sigma_of_row, key_of_row):
            if sigma_of_row is None or key_of_row is None:
                return samples
            return np.clip(samples + draw(key_of_row, len(samples), sigma_of_row), -1.0, 1.0)

        return noisy

    return map_waves(df, wave, column, build, [sigma, key], "double")


def _between(bounds: tuple[float, float], draw: Column) -> Column:
    low, high = bounds
    return F.lit(low) + F.lit(high - low) * draw


def augment_plan(df: DataFrame, key: str, length: Column, seed: int = 42, where: Column | None = None) -> DataFrame:
    """Which rows are changed, how, and how strongly: augmentation, shift, speed, sigma.

    Half of the rows (of those that meet ``where``, usually the train part) stay as they are.
    """
    chosen = unit_draw(seed, "gate", key) >= 0.5
    if where is not None:
        chosen = chosen & F.coalesce(where, F.lit(False))
    kinds = F.array(*[F.lit(a) for a in AUGMENTATIONS])
    kind = F.element_at(kinds, (hash_int(seed, F.lit("kind"), key) % len(AUGMENTATIONS) + 1).cast("int"))
    planned = df.withColumn("augmentation", F.when(chosen, kind).otherwise(F.lit("none")))
    is_kind = lambda name: F.col("augmentation").isin(name, "all")
    # the cast cuts towards zero
    shift = (length * _between(SHIFT_RANGE, unit_draw(seed, "shift", key))).cast("int")
    return planned.withColumns(
        {
            "shift": F.when(is_kind("time_shift"), shift),
            "speed": F.when(is_kind("speed"), _between(SPEED_RANGE, unit_draw(seed, "speed", key))),
            "sigma": F.when(is_kind("noise"), _between(NOISE_RANGE, unit_draw(seed, "sigma", key))),
        }
    )


def augment(df: DataFrame, wave: str, key: str, seed: int = 42, where: Column | None = None, column: str = "augmented") -> DataFrame:
    """Shift and noise as planned. A drawn speed change is recorded in ``speed`` for the DSP library."""
    planned = augment_plan(df, key, F.size(wave), seed, where)
    shifted = planned.withColumn(
        "__shifted",
        F.when(F.col("shift").isNotNull(), time_shift(wave, F.col("shift"))).otherwise(F.col(wave).cast("array<float>")),
    )
    return add_noise(shifted, "__shifted", "sigma", key, seed, column).drop("__shifted")


def rate_check(df: DataFrame, rate: str = "audio.sampling_rate", target: int = TARGET_RATE) -> DataFrame:
    """Rows per sampling rate that is not the target rate."""
    return (
        df.where(F.col(rate) != target).groupBy(F.col(rate).alias("sampling_rate")).agg(F.count("*").alias("n"))
    )
