"""Near copies against all pairs, with shared passages, chains and large groups."""

from __future__ import annotations

import random

import numpy as np
import pytest

from labelkit.llm import graph, jaccard


def corpus(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(k)) for k in (12, 60, 200)]
    origin = [rng.choice(vocabulary) for _ in range(150)]
    texts: list[str | None] = [None, "", " \n", "One", "one", "one two three", "One two  three", "one two", "a b c d e", "a b c d e f"]
    for _ in range(120):  # many documents share passages, some are little else
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 20, 60, 150))))
        texts.append(f"{own} {rng.choice(passages)} {rng.choice(['', passages[0], passages[1]])}")
    for _ in range(70):  # a group of near copies, most of them linked only through others
        words = list(origin)
        for at in rng.sample(range(150), rng.choice((0, 1, 3, 5, 8))):
            words[at] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    words = [rng.choice(vocabulary) for _ in range(100)]
    for step in range(25):  # a chain: each differs a little from the one before
        words = words[2:] + [rng.choice(vocabulary) for _ in range(2)]
        texts.append(" ".join(words).upper())
    texts += [passages[2]] * 30 + [passages[2] + " x y z"] * 3
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute(rows) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("few", [1, 4, 20])
def test_components_equal_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = corpus(few)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes, linked = jaccard.linked_components(docs)
    got = {r["id"]: r["n"] for r in sizes.collect()}
    component = {r["id"]: r["component"] for r in linked.collect()}
    assert {i: (n, component.get(i, i)) for i, n in got.items()} == brute(rows)


def test_one_of_each_and_odd_rows(spark):
    rows = [(2, "a b c d e f g", 1), (1, "A b c d e f g", 2), (1, "A b c d e f g", 2), (3, None, 3), (4, "", 4), (None, "a b c d e f g", 5), (5, "long " * 50_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long")
    kept = sorted(((r["doc_id"], r["component"]) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert kept == [(1, 2), (1, 2), (3, 3), (4, 4), (5, 6), (None, 5)]
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)]
    rng.shuffle(edges)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1200)}


def test_other_text_of_a_folded_id_keeps_its_links(spark):
    rng = random.Random(11)
    first, other = ([f"{c}{rng.randrange(10**6)}" for _ in range(120)] for c in "ab")
    near = [*other[:119], "changed"]
    rows = [(1, " ".join(first)), (2, " ".join(first)), (2, " ".join(other)), (3, " ".join(near)), (4, "alone in the world with five words")]
    _, linked = jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: r["component"] for r in linked.collect() if r["id"] != r["component"]} == {2: 1, 3: 1}


def test_variants_that_do_not_link_in_blocks(spark, monkeypatch):
    """A template of many variants: long buckets are dealt to blocks, few pairs become rows, links equal all pairs."""
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    rng = random.Random(5)
    template = [f"t{k}" for k in range(160)]
    rows = []
    for i in range(260):
        words = list(template)
        for at in rng.sample(range(0, 160, 8), 14 if i % 13 else rng.choice((0, 1, 2))):
            words[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    tried = []
    real = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: tried.append(pairs.count()) or real(pairs, *rest))
    sizes, linked = jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    component = {r["id"]: r["component"] for r in linked.collect()}
    assert {r["id"]: (r["n"], component.get(r["id"], r["id"])) for r in sizes.collect()} == brute(rows)
    assert tried[-1] < 260


def test_differing_bits_never_exceed_differing_tokens():
    rng = np.random.default_rng(7)
    for size in (1, 5, 100, 128, 129, 300, 600, 3000):
        for changed in (0, 1, size // 10, size // 4, size):
            x = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
            y = np.unique(np.concatenate([x[: len(x) - changed], rng.integers(-(2**63), 2**63 - 1, changed + size // 9)]))
            bits = [np.frombuffer(jaccard.parity_bits(s), np.uint64).reshape(1, -1) for s in (x, y)]
            width = min(b.shape[1] for b in bits)
            differ = np.bitwise_count(jaccard._folded(bits[0], width) ^ jaccard._folded(bits[1], width)).sum()
            assert differ <= len(np.setxor1d(x, y))
    assert [len(jaccard.parity_bits(np.arange(n))) // 8 for n in (0, 1, 128, 129, 256, 257, 512, 513, 5000)] == [2, 2, 2, 4, 4, 8, 8, 16, 16]


def test_variants_that_do_not_link_make_few_rows(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    origin = [rng.choice(vocabulary) for _ in range(100)]
    rows = []
    for i in range(300):  # pairs are between 0.6 and 0.8 alike and meet in many buckets
        words = list(origin)
        for at in rng.sample(range(100), 4):
            words[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    counted = []
    met = jaccard._met

    def seen(groups, percent):
        found = met(groups, percent).persist()
        counted.append((found.count(), found.distinct().count()))
        return found

    monkeypatch.setattr(jaccard, "_met", seen)
    sizes, linked = jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    component = {r["id"]: r["component"] for r in linked.collect()}
    assert {r["id"]: (r["n"], component.get(r["id"], r["id"])) for r in sizes.collect()} == brute(rows)
    given, pairs = counted[0]
    assert 0 < pairs < 2 * len(rows) and given < 1.5 * pairs


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    """Each round is a dozen jobs the driver plans; the components of an earlier call are stars."""
    rounds, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, purpose: rounds.append(purpose) or write(df, purpose))
    stars, chain = [(3, 1), (4, 1), (1, 1), (9, 7)], [(i, i + 1) for i in range(20, 40)]
    for links, want, few in ((stars, {1: 1, 3: 1, 4: 1, 7: 7, 9: 7}, 1), (chain, {i: 20 for i in range(20, 41)}, 12), ([(2, 1), (2, 0), (3, 1)], {i: 0 for i in range(4)}, 4), ([], {}, 1)):
        rounds.clear()
        assert {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()} == want
        assert len(rounds) <= few
