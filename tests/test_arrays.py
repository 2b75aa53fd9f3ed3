from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from labelkit.functions import arrays as a

FLOATS = "array<float>"
DOUBLES = "array<double>"


@pytest.mark.parametrize(
    "wave, n, want",
    [
        ([], 3, [0, 0, 0]),
        ([1.0], 4, [0, 1, 0, 0]),
        ([1.0, 2.0, 3.0], 4, [1, 2, 3, 0]),
        ([1.0, 2.0, 3.0, 4.0], 4, [1, 2, 3, 4]),
        ([1.0, 2.0, 3.0, 4.0, 5.0], 4, [1, 2, 3, 4]),
    ],
)
def test_fix_length(one, wave, n, want):
    assert one(a.fix_length("x", n), x=(wave, FLOATS)) == want


@pytest.mark.parametrize(
    "shift, want", [(0, [1, 2, 3]), (1, [0, 1, 2]), (-1, [2, 3, 0]), (5, [0, 0, 0]), (-5, [0, 0, 0])]
)
def test_time_shift(one, shift, want):
    assert one(a.time_shift("x", F.lit(shift)), x=([1.0, 2.0, 3.0], FLOATS)) == want


def test_clip_array(one):
    got = one(a.clip_array("x"), x=([-2.0, 0.5, 3.0, math.nan], DOUBLES))
    assert got[:3] == [-1.0, 0.5, 1.0] and math.isnan(got[3])


def test_zscore_array(one):
    got = one(a.zscore_array("x"), x=([1.0, 2.0, 3.0], DOUBLES))
    assert sum(got) == pytest.approx(0) and sum(v * v for v in got) / 3 == pytest.approx(1, abs=1e-6)
    assert one(a.zscore_array("x"), x=([], DOUBLES)) == []
    assert one(a.zscore_array("x"), x=([2.0, 2.0], DOUBLES)) == [0.0, 0.0]


def test_to_mono(one):
    frames = F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(5.0)))
    assert one(a.to_mono(frames)) == [2.0, 5.0]


@pytest.mark.parametrize(
    "wave, want", [([0.5, -1.0], [0.5, -1.0]), ([0.75, -1.5], [0.5, -1.0]), ([], [])]
)
def test_peak_norm_only_divides_above_one(one, wave, want):
    assert one(a.peak_norm("x"), x=(wave, DOUBLES)) == want


@pytest.mark.parametrize("z, want", [([1.0, 3.0, 3.0], 1), ([5.0], 0), ([-1.0, -2.0], 0)])
def test_argmax_takes_the_first(one, z, want):
    assert one(a.argmax("x"), x=(z, DOUBLES)) == want


def test_softmax(one):
    got = one(a.softmax("x"), x=([1.0, 1.0, 1000.0], DOUBLES))
    assert sum(got) == pytest.approx(1) and got[2] == pytest.approx(1)
    assert one(a.softmax("x", drop=-1), x=([1.0, 1.0, 1000.0], DOUBLES)) == [0.5, 0.5]
    assert one(a.softmax("x", drop=0), x=([9.0, 1.0, 1.0], DOUBLES)) == [0.5, 0.5]


@pytest.mark.parametrize("threshold, want", [(0.5, "a"), (0.51, "others")])
def test_open_set_label_is_strictly_below(one, threshold, want):
    names = F.array(F.lit("a"), F.lit("b"))
    assert one(a.open_set_label(F.col("p"), names, threshold, F.lit("others")), p=([0.5, 0.5], DOUBLES)) == want


def test_top_k_breaks_ties_by_class(one):
    names = F.array(*[F.lit(c) for c in "abcd"])
    got = one(a.top_k(F.col("p"), names, 3), p=([0.1, 0.4, 0.1, 0.4], DOUBLES))
    assert [(r["label"], r["prob"]) for r in got] == [("b", 0.4), ("d", 0.4), ("a", 0.1)]


def test_noise_is_normal_and_differs_between_keys():
    import numpy as np

    from labelkit.operators.audio import noise_source, normal_table

    table = normal_table()
    assert len(table) == 1025 and table == [-v for v in reversed(table)] and table == sorted(table)
    draw = noise_source(42)
    waves = np.array([draw(k, 5000, 1.0) for k in [0, 1, 2, -3, 2**31 - 1, 2**31, 2**62]])
    assert np.allclose(waves.mean(axis=1), 0, atol=0.06) and np.allclose(waves.std(axis=1), 1, atol=0.05)
    assert abs((np.abs(waves) < 1).mean() - 0.6827) < 0.01 and abs((np.abs(waves) < 2).mean() - 0.9545) < 0.005
    between = np.corrcoef(waves) - np.eye(len(waves))
    assert np.abs(between).max() < 0.06  # rows
    for lag in range(1, 20):  # samples of a row
        assert np.abs([np.corrcoef(w[:-lag], w[lag:])[0, 1] for w in waves]).max() < 0.06
    assert (draw(7, 100, 2.0) == 2 * draw(7, 200, 1.0)[:100]).all()
    assert not np.allclose(noise_source(43)(7, 100, 1.0), draw(7, 100, 1.0))
