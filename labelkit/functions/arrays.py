"""Waveform, logit and probability arrays as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelkit.functions.binding import let


def _col(sel: str | Column) -> Column:
    return F.col(sel) if isinstance(sel, str) else sel


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))


def as_float(sel: str | Column) -> Column:
    return _col(sel).cast("array<float>")


def fix_length(sel: str | Column, n: int) -> Column:
    """Exactly ``n`` samples: the tail is cut, a short array is centred in zeros.

    An odd number of zeros puts the extra one on the right.
    """

    def fit(arr: Column) -> Column:
        missing = F.lit(n) - F.size(arr)
        left = F.floor(missing / 2)
        return F.when(missing <= 0, F.slice(arr, 1, n)).otherwise(
            F.concat(_zeros(left), arr, _zeros(missing - left))
        )

    return let(as_float(sel), fit)


def time_shift(sel: str | Column, shift: Column) -> Column:
    """Move samples right (positive) or left by ``shift``, zero filled, same length."""

    def move(arr: Column) -> Column:
        n = F.size(arr)
        by = F.least(F.greatest(shift.cast("int"), -n), n)
        return (
            F.when(by > 0, F.concat(_zeros(by), F.slice(arr, F.lit(1), n - by)))
            .when(by < 0, F.concat(F.slice(arr, F.lit(1) - by, n + by), _zeros(-by)))
            .otherwise(arr)
        )

    return let(as_float(sel), move)


def clip_array(sel: str | Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Limit every sample to [low, high]; NaN stays NaN."""
    return F.transform(
        _col(sel),
        lambda x: F.when(F.isnan(x), x).otherwise(F.greatest(F.least(x, F.lit(high)), F.lit(low))),
    )


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def _mean(arr: Column) -> Column:
    return F.try_divide(_sum(arr), F.size(arr))


def zscore_array(sel: str | Column, eps: float = 1e-7) -> Column:
    """Zero mean and unit variance: (x - mean) / sqrt(variance + eps)."""

    def scale(arr: Column) -> Column:
        centred = let(_mean(arr), lambda mean: F.transform(arr, lambda x: x - mean))
        return let(centred, unit)

    def unit(arr: Column) -> Column:
        spread = F.sqrt(_mean(F.transform(arr, lambda x: x * x)) + F.lit(eps))
        return let(spread, lambda s: F.transform(arr, lambda x: x / s))

    return let(_col(sel).cast("array<double>"), scale)


def to_mono(sel: str | Column) -> Column:
    """Mean over the channels of each frame of a (frames, channels) waveform."""
    return F.transform(
        _col(sel).cast("array<array<double>>"), _mean
    )


def peak_norm(sel: str | Column) -> Column:
    """Divide by the peak when it is above one; quieter waveforms stay as they are."""

    def by_peak(arr: Column) -> Column:
        return let(
            F.array_max(F.transform(arr, F.abs)),
            lambda peak: F.when(peak > 1.0, F.transform(arr, lambda x: x / peak)).otherwise(arr),
        )

    return let(_col(sel).cast("array<double>"), by_peak)


def argmax(sel: str | Column) -> Column:
    """Zero-based index of the largest value, the first one on ties."""
    return let(_col(sel), lambda arr: (F.array_position(arr, F.array_max(arr)) - 1).cast("int"))


def drop_index(sel: str | Column, index: int) -> Column:
    """Array without one position; a negative index counts from the end."""

    def keep(arr: Column) -> Column:
        gone = F.lit(index) if index >= 0 else F.size(arr) + F.lit(index)
        return let(gone, lambda g: F.filter(arr, lambda x, i: i != g))

    return let(_col(sel), keep)


def without_name(names: Column, name: str) -> Column:
    """The class names without one, in their order."""
    return F.filter(names, lambda x: x != name)


def drop_named(sel: str | Column, names: Column, name: str) -> Column:
    """Values without those of the classes called ``name``, wherever they stand; all values when there is none."""
    kept = F.filter(F.arrays_zip(_col(sel).alias("v"), names.alias("n")), lambda x: x["n"] != name)
    return F.transform(kept, lambda x: x["v"])


def class_id(label: Column, names: Column) -> Column:
    """Position of a label among the class names, counted from 0; -1 when no class has this name."""
    return F.coalesce(F.array_position(names, label) - 1, F.lit(-1)).cast("int")


def class_key(label: Column, keys: dict[str, str]) -> Column:
    """String id of a label; "-1" when it has none."""
    pairs = [F.lit(x) for pair in keys.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[label] if pairs else F.lit(None).cast("string"), F.lit("-1"))


def softmax(sel: str | Column, drop: int | None = None) -> Column:
    """Probabilities over all classes, or over all but the one at ``drop`` (the "others" class)."""
    kept = _col(sel) if drop is None else drop_index(sel, drop)

    def exps(arr: Column) -> Column:
        return let(F.array_max(arr), lambda top: F.transform(arr, lambda x: F.exp(x - top)))

    def normed(arr: Column) -> Column:
        return let(_sum(arr), lambda total: F.transform(arr, lambda x: x / total))

    return let(let(kept.cast("array<double>"), exps), normed)


def open_set_label(probs: Column, labels: Column, threshold: float, others: Column) -> Column:
    """Label of the most likely class, or ``others`` when its probability is below the threshold."""
    return let(
        probs,
        lambda p: F.when(F.array_max(p) < threshold, others).otherwise(
            F.element_at(labels, F.array_position(p, F.array_max(p)).cast("int"))
        ),
    )


def top_k(probs: Column, labels: Column, k: int = 3) -> Column:
    """The k most likely classes as (label, prob) structs, best first, lower class id on ties."""
    ranked = F.slice(
        F.array_sort(F.transform(probs, lambda x, i: F.struct((-x).alias("neg"), i.alias("i")))), 1, k
    )
    return F.transform(
        ranked,
        lambda r: F.struct(
            F.element_at(labels, r["i"] + 1).alias("label"), (-r["neg"]).alias("prob")
        ),
    )
