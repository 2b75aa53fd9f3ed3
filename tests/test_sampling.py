from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelkit.operators import ranking, sampling, synth
from labelkit.operators.bounded import is_small, join_small, local_copy, local_table


@pytest.fixture(scope="module")
def skewed(spark):
    """Labels of 1, 2, 5, 10 and 600 rows, and one of 300 rows without a label."""
    sizes = {"a": 1, "b": 2, "c": 5, "d": 10, "hot": 600, None: 300}
    rows = [(f"{label}-{i}", label) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "key string, label string").repartition(7).cache()


def _by_label(df):
    return Counter((r.label, r.split) for r in df.collect())


def test_stratified_sizes(skewed):
    got = _by_label(sampling.stratified_split(skewed, "label", "key", 0.8))
    train = {label: n for (label, split), n in got.items() if split == "train"}
    assert train == {"b": 1, "c": 4, "d": 8, "hot": 480, None: 240}
    assert sum(got.values()) == 918


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_ranks_equal_a_plain_sort(skewed, digits):
    ranked = ranking.group_rank(skewed, "key", "label", digits=digits).collect()
    import hashlib

    order = lambda r: (hashlib.md5(f"42|{r.key}".encode()).hexdigest(), r.key)
    for label in {r.label for r in ranked}:
        mine = sorted((r for r in ranked if r.label == label), key=order)
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_splits_do_not_depend_on_partitions(skewed):
    results = []
    for n in (1, 4, 16):
        split = sampling.stratified_split(skewed.repartition(n), "label", "key", 0.8, 7)
        results.append(sorted((r.key, r.split) for r in split.collect()))
    assert results[0] == results[1] == results[2]
    other = sampling.stratified_split(skewed, "label", "key", 0.8, 8)
    assert sorted((r.key, r.split) for r in other.collect()) != results[0]


def test_many_groups_take_the_shuffle_join(skewed, monkeypatch):
    want = sorted((r.key, r.split) for r in sampling.stratified_split(skewed, "label", "key").collect())
    monkeypatch.setattr(ranking, "local_copy", lambda df: None)
    got = sorted((r.key, r.split) for r in sampling.stratified_split(skewed, "label", "key").collect())
    assert got == want
    assert sampling.random_split(skewed, "key", 0.2).where("split = 'test'").count() == math.ceil(918 * 0.2)


def test_large_cut_buckets_are_refined(skewed, monkeypatch):
    want = sorted((r.key, r.split) for r in sampling.three_way_split(skewed, "key").collect())
    want_by = sorted((r.key, r.split) for r in sampling.stratified_split(skewed, "label", "key").collect())
    monkeypatch.setattr(ranking, "SORT_ROWS", 0)
    assert sorted((r.key, r.split) for r in sampling.three_way_split(skewed, "key").collect()) == want
    monkeypatch.setattr(ranking, "SORT_ROWS", 1)
    assert sorted((r.key, r.split) for r in sampling.stratified_split(skewed, "label", "key").collect()) == want_by


@pytest.mark.parametrize("n", [0, 1, 2, 5, 10, 101])
def test_rounding_rules(spark, n):
    rows = spark.range(n)
    test = sampling.random_split(rows, "id", 0.2).where("split = 'test'").count()
    assert test == math.ceil(n * 0.2)
    train = sampling.random_split(rows, "id", 0.2, rounding="floor_train").where("split = 'train'").count()
    assert train == int(0.8 * n)
    three = Counter(r.split for r in sampling.three_way_split(rows, "id").collect())
    held = math.ceil(n * 0.2)
    assert (three["train"], three["val"], three["test"]) == (n - held, held - math.ceil(held / 2), math.ceil(held / 2))


def test_ensure_validation_only_splits_once(spark):
    rows = spark.range(100)
    split = sampling.ensure_validation(rows, "id")
    assert split.where("split = 'validation'").count() == 5
    assert sampling.ensure_validation(split, "id") is split


def test_approximate_split(spark):
    share = sampling.approximate_split(spark.range(10000), "id", 0.2).where("split = 'test'").count() / 10000
    assert share == pytest.approx(0.2, abs=0.02)


def test_caps_and_samples(skewed):
    capped = sampling.cap_per_group(skewed, "label", "key", 3).collect()
    assert Counter(r.label for r in capped) == {"a": 1, "b": 2, "c": 3, "d": 3, "hot": 3, None: 3}
    assert sorted(r.key for r in capped if r.label == "hot") == ["hot-0", "hot-1", "hot-10"]
    assert skewed.columns == sampling.cap_per_group(skewed, "label", "key", 3).columns
    sample = sampling.sample_per_group(skewed, "label", "key", 5)
    ranks = ranking.group_rank(skewed, "key", "label").where("rank <= 5")
    assert {r.key for r in sample.collect()} == {r.key for r in ranks.collect()}


def test_row_at_and_head(spark):
    rows = spark.range(5)
    assert sampling.row_at(rows, "id", 4).first()["id"] == 4
    assert sampling.row_at(rows, "id", 5).count() == 0
    assert [r["id"] for r in sampling.head_n(rows, "id", 2).collect()] == [0, 1]


def test_row_or_error(spark):
    rows = spark.range(5).withColumn("t", F.lit("x"))
    assert tuple(sampling.row_or_error(rows, "id", 2).first()) == (2, "x", "OK", None)
    assert tuple(sampling.row_or_error(rows, "id", 9).first()) == (None, None, "ERROR", "index 9 is out of range")


def test_keep_split(spark):
    assert sampling.keep_split(spark.range(5), spark.range(2, 4), "id").count() == 2


def test_next_in_group_equals_lead(spark):
    rows = [(g, o, f"{g}{o}") for g in "ab" for o in (0, 3, 4, 1023, 1024, 5000, 9000)]
    df = spark.createDataFrame(rows, "g string, o bigint, v string")
    got = {(r.g, r.o): r.next_v for r in ranking.next_in_group(df, "g", "o", ["v"]).collect()}
    order = [0, 3, 4, 1023, 1024, 5000, 9000]
    for g in "ab":
        for here, there in zip(order, order[1:] + [None]):
            assert got[(g, here)] == (f"{g}{there}" if there is not None else None)


def test_size_checks(spark):
    small = local_table(spark, {"a": [1, 2]}, "a int")
    assert is_small(small, 2) and not is_small(small, 1)
    assert local_copy(small, 1) is None and local_copy(small, 2).count() == 2
    plan = join_small(spark.range(10).withColumnRenamed("id", "a"), small, "a")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    big = join_small(spark.range(10).withColumnRenamed("id", "a"), small.hint("merge"), "a", max_rows=1)
    assert big.count() == 2 and "rightHint=(strategy=broadcast)" not in big._jdf.queryExecution().toString()


# -- multi-label synthesis ---------------------------------------------------------------------


@pytest.mark.parametrize("n, share, want", [(100, 0.2, 25), (10, 0.2, 2), (0, 0.5, 0)])
def test_n_multi(n, share, want):
    assert synth.n_multi(n, share) == want


def test_n_multi_refuses_everything():
    with pytest.raises(ValueError):
        synth.n_multi(10, 1.0)


def test_synth_multilabel(skewed):
    pool = skewed.where("label is not null").withColumnRenamed("label", "category")
    cats = ["hot", "a", "d", "empty"]
    made = synth.synth_multilabel(pool, "key", cats, 0.2).collect()
    members = {r.key: r.category for r in pool.collect()}
    # "c" and "b" are not listed, so 611 rows count
    assert 0 < len(made) <= int(611 * 0.25)
    for r in made:
        labels = r.labels.split(", ")
        assert len(labels) in (2, 3) and len(set(labels)) == len(labels)
        assert members[r.key] == next(c for c in labels if c != "empty")


def test_no_row_without_any_item(spark):
    pool = spark.createDataFrame([(f"k{i}", "x") for i in range(40)], "key string, category string")
    made = synth.synth_multilabel(pool, "key", ["x", "p", "q", "r", "s"], 0.5).collect()
    assert len(made) < 40 and all("x" in r.labels.split(", ") for r in made)


def test_build_dataset(skewed):
    pool = skewed.where("label is not null").withColumnRenamed("label", "category")
    cats = ["a", "b", "c", "d", "hot"]
    built = synth.build_dataset(pool, "key", cats).cache()
    single = Counter(r.split for r in built.where("not is_multi").collect())
    assert single == {"train": 493, "val": 125, "sample": 1 + 4 + 5 + 5}
    multi = Counter(r.split for r in built.where("is_multi").collect())
    assert multi == {"train": 123, "val": 31, "sample": 3}
    assert built.columns.count("shuffle") == 1
    plain = synth.build_dataset(pool, "key", cats, multi_label=False)
    assert plain.where("is_multi").count() == 0 and plain.count() == 493 + 125 + 15
    assert plain.where(F.col("shuffle").isNull()).count() == 0


def test_first_of_groups_by_counted_cuts(spark):
    """A group of most rows, ties, copies of rows and groups smaller than n, with windows of at most 50 rows."""
    rng = random.Random(4)
    rows = [("hot", rng.choice((rng.random(), 0.25, 0.5)), rng.randrange(3)) for _ in range(4000)]
    rows += [("few", float(k % 2), 0) for k in range(7)] + [(None, None, k) for k in range(300)] + [("copies", 1.0, 1)] * 500
    df = spark.createDataFrame(rows, "g string, o double, x int").repartition(5)
    low = lambda r: (r[1] is not None, r[1] or 0.0)
    for n in (1, 60, 1500, 3999):
        got = {}
        for r in ranking.first_of_groups(df, "g", [F.col("o")], n, rows=50).collect():
            got.setdefault(r["g"], []).append(tuple(r))
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g), key=low)
            assert [low(r) for r in sorted(got[g], key=low)] == [low(r) for r in own[:n]]
            assert not Counter(got[g]) - Counter(own)


def test_row_of_a_million_without_a_window_of_them(spark):
    df = spark.range(0, 1_000_000, numPartitions=8).select((F.col("id") * 7919 % 1_000_003).alias("v"), F.col("id").alias("x"))
    want = sorted(k * 7919 % 1_000_003 for k in range(1_000_000))
    for index in (0, 499_999, 999_999):
        found = sampling.row_at(df, "v", index)
        assert found.first()["v"] == want[index]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "GlobalLimit" not in plan and "Sort" not in plan
    assert sampling.row_at(df, "v", 1_000_000).count() == 0
