"""Repeated lines against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from labelkit.llm import lines


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng: random.Random, line: str, n: int) -> str:
    chars = list(line)
    for _ in range(n):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcdeé𝄞 ")
        elif kind == 1:
            chars.insert(at, rng.choice("abcdeé𝄞"))
        else:
            del chars[at]
    return "".join(chars).strip()


def corpus() -> list[tuple[int, str]]:
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(16, 60))).strip() for _ in range(25)]
    texts = []
    for doc in range(60):
        picked = [edited(rng, rng.choice(base), rng.choice((0, 0, 1, 2, 3, 4))) for _ in range(rng.randrange(1, 5))]
        texts.append((doc, "\n".join(picked + rng.choice([[], ["", "short"], ["  "], ["short"]]))))
    return texts


def brute(rows: list[tuple[int, str]]) -> dict[int, set[int]]:
    places: dict[str, list[tuple[int, int]]] = {}
    for doc, text in rows:
        for pos, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\x0b\x0c\r")
            if line:
                places.setdefault(line, []).append((doc, pos))
    names = sorted(places)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if min(len(a), len(b)) >= lines.MIN_CHARS and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                root[find(a)] = find(b)
    groups: dict[str, list[tuple[int, int]]] = {}
    for n in names:
        groups.setdefault(find(n), []).extend(places[n])
    gone: dict[int, set[int]] = {}
    for group in groups.values():
        for doc, pos in sorted(group)[1:]:
            gone.setdefault(doc, set()).add(pos)
    return gone


def test_removed_lines_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["key"]: set(r["cut"]) for r in lines.removed(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("ab c") for _ in range(rng.randrange(5, 30)))
        b = edited(rng, a, rng.randrange(6)) or "aaaaa"
        a, b = sorted((a, b), key=len)
        if len(a) > edits:
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within_edits(F.col("a"), F.col("b"), edits).alias("x")).collect()
    assert all(r["x"] == (distance(r["a"], r["b"]) <= edits) for r in got)


def test_cleaned_documents(spark):
    rows = [
        (1, "one long line of text here\nshort", 5, "x"), (2, "one long line of text herE\nother\n\nshort", 5, "x"), (3, "short\n short ", 9, "y"),
        (4, None, None, None), (5, "", 0, None), (6, " \n ", 3, None), (7, "alone", 5, None), (None, "short\nnew", 1, None), (8, "w" * 70000 + "\nshort", 7, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key string")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.dedup_lines(docs).collect()}
    assert got == {
        1: ("one long line of text here\nshort", 5), 2: ("other\n", 6), 4: (None, None), 5: ("", 0), 6: (" \n ", 3),
        7: ("alone", 5), None: ("short\nnew", 1), 8: ("w" * 70000, 70000),
    }
    assert lines.dedup_lines(docs).columns == docs.columns
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "same line"), (1, "same line"), (2, "same line")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in lines.dedup_lines(twice).collect()) == [1, 1]
