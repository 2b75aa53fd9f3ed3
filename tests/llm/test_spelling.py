"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from labelkit.llm import spelling


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts: dict[str, int], times: int = 5) -> dict[str, tuple]:
    forms, out = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[x], x) for x in counts if near(w, x))
        best = others[0] if others and -others[0][0] >= times * n else None
        forms[w] = best and best[1]
        out[w] = (best and best[1], n, len(others), best and -best[0])
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def vocabulary(seed: int) -> dict[str, int]:
    rng = random.Random(seed)
    letters = "abcdeéàÿ"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(60)}
    for w in list(words):
        for _ in range(6):
            at, c = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice((w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]))
            words.add(w)
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa"}
    return {w: rng.choice((5, 5, 7, 30, 200, 2000)) for w in words}


def rows_of(df) -> dict[str, tuple]:
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "shard"), [(1, 4000), (2, 40), (3, 5), (4, 1)])
def test_variants_equal_all_pairs(spark, seed, shard):
    counts = vocabulary(seed)
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.spelling_variants(df, shard=shard)) == brute(counts)


def test_one_edit():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))) for _ in range(2))
        assert spelling.one_edit(a, b) == near(a, b)


def test_chain_of_forms(spark):
    counts = {"aaaaaa" + "b" * k: 5 ** (k + 1) for k in range(12)}
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r[1] for r in got.values()} == {"aaaaaa" + "b" * 11} and got == brute(counts)


def test_query_against_plain_counts(spark, tmp_path):
    rng = random.Random(9)
    words = [*vocabulary(9)][:80]
    weights = [rng.choice((1, 3, 60)) for _ in words]
    rows: list[tuple[int | None, str | None]] = [(None, " ".join(words * 6)), (1, None), (2, ""), (3, "a1b2 ÀÉ× " * 9), (4, "long" * 30_000 + " " + "Longer " * 500)]
    for k in range(5, 600):
        rows.append((k, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=60))))
    rows.append(rows[-1])
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts: Counter[str] = Counter()
    for doc, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = rows_of(spelling.op11_spelling_variants(spark, str(tmp_path)))
    assert got == brute(counts) and any(r[0] for r in got.values())


def test_empty_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x")], "doc_id long, text string, word string")
    for table in (docs, docs.limit(0)):
        assert spelling.spelling_variants(spelling.word_counts(table)).count() == 0
