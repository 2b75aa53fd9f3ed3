"""Near duplicates by sketches against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from labelkit.llm import sketches


def corpus(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(k)) for k in (12, 60, 200, 400)]
    texts: list[str | None] = [None, "", " \n", "One", "one", "one two three", "One two  three", "a b c d", "a b c d e"]
    for _ in range(120):  # documents that are little but shared passages
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 20, 60, 150))))
        texts.append(f"{own} {rng.choice(passages)} {rng.choice(['', passages[0], passages[1]])}")
    for size in (60, 150, 400):  # groups of near copies around the threshold, most of them linked through others
        origin = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(60):
            words = list(origin)
            for at in rng.sample(range(size), max(0, int(size * rng.choice((0, 0.01, 0.02, 0.03, 0.04, 0.05))))):
                words[at] = rng.choice(vocabulary)
            texts.append(" ".join(words[: rng.choice((size, size, size - 5))]))
    words = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(25):  # a chain: each differs a little from the one before
        words = words[2:] + [rng.choice(vocabulary) for _ in range(2)]
        texts.append(" ".join(words).upper())
    texts += [passages[2]] * 30 + [passages[2] + " x y z"] * 3
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute(rows) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("seed", "k"), [(1, 128), (3, 64)])
def test_components_equal_all_pairs(spark, seed, k):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes, linked = sketches.linked_components(docs, k=k)
    component = {r["id"]: r["component"] for r in linked.collect()}
    assert {r["id"]: (r["n"], component.get(r["id"], r["id"])) for r in sizes.collect()} == brute(rows)


@pytest.mark.parametrize(("seed", "few", "block"), [(4, 64, 1000), (5, 3, 16)])
def test_pairs_without_stars_equal_all_pairs(spark, monkeypatch, seed, few, block):
    """The lists alone find every link, joined or compared in blocks: the stars only save work."""
    monkeypatch.setattr(sketches, "FEW", few)
    monkeypatch.setattr(sketches, "BLOCK", block)
    monkeypatch.setattr(sketches, "_stars", lambda index, pivot: index.sparkSession.createDataFrame([], "a long, b long"))
    rows = corpus(seed)
    _, linked = sketches.linked_components(spark.createDataFrame(rows, "doc_id long, text string"))
    component = {r["id"]: r["component"] for r in linked.collect()}
    assert {i: component.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in brute(rows).items()}


def test_union_estimate_is_exact_on_small_sets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(2))
        shared, size = sketches.union_estimate(x, y, 128)
        assert (shared, size) == (len(np.intersect1d(x, y)), len(np.union1d(x, y)))
        shared, size = sketches.union_estimate(x[:8], y[:8], 8)
        union = np.union1d(x, y)[:8]
        assert (shared, size) == (len(np.intersect1d(np.intersect1d(x, y), union)), len(union))


def test_tail_bound():
    assert sketches.tail_bound(128, 80, 1e-9) < sketches.tail_bound(128, 80, 1e-3) < 102
    assert sketches.tail_bound(10, 100) == 10


def test_deduplicated_and_odd_rows(spark):
    rows = [(2, "a b c d e f g", 1), (1, "A b c d e f g", 2), (1, "A b c d e f g", 2), (3, None, 3), (4, "", 4), (None, "a b c d e f g", 5), (5, "long " * 50_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long")
    kept = sorted(((r["doc_id"], r["component"]) for r in sketches.deduplicated(docs).collect()), key=str)
    assert kept == [(1, 2), (1, 2), (3, 3), (4, 4), (5, 6), (None, 5)]
    assert sketches.deduplicated(docs.limit(0)).count() == 0


def test_rows_of_one_id_with_other_texts(spark):
    rng = random.Random(11)
    first, other = ([f"{c}{rng.randrange(10**6)}" for _ in range(120)] for c in "ab")
    near = [*other[:119], "changed"]
    rows = [(1, " ".join(first)), (2, " ".join(first)), (2, " ".join(other)), (3, " ".join(near)), (4, "alone in the world with five words")]
    _, linked = sketches.linked_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: r["component"] for r in linked.collect() if r["id"] != r["component"]} == {2: 1, 3: 1}


def test_rows_grow_with_the_group_not_its_square(spark):
    """Variants too far from each other to link leave before they meet."""
    rng = random.Random(6)
    origin = [f"w{rng.randrange(3000)}" for _ in range(140)]
    rows = []
    for k in range(1200):
        words = list(origin)
        for at in rng.sample(range(140), 14):
            words[at] = f"own{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    kept_pairs = sketches._kept_pairs

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return kept_pairs(pairs, *rest)

    sketches._kept_pairs = counted
    try:
        _, linked = sketches.linked_components(docs)
        assert linked.count() == 0 and max(seen) <= 4 * len(rows)
    finally:
        sketches._kept_pairs = kept_pairs
