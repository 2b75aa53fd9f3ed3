"""Runs of words against a plain search, and collapsed texts."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from labelkit.llm import periodic


def brute(words: list[bytes], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            start, length = k, end + q - k
            if length >= max(least, times * q):
                found.setdefault((start, length), q)  # the smallest period of a stretch comes first
            k = end + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def texts(seed: int) -> list[list[bytes]]:
    rng = random.Random(seed)
    out = [[], [b"a"], [b"a"] * 23, [b"a"] * 24, [b"a"] * 1500, [b"x", b"y"] * 12, [b"x", b"y"] * 11 + [b"x"]]
    for _ in range(150):
        vocabulary = [b"w%d" % k for k in range(rng.choice((1, 2, 3, 50, 1000)))]
        words = []
        while len(words) < rng.choice((10, 80, 300)):
            period = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 7, 8, 9, 20)))]
            words += (period * rng.choice((1, 2, 3, 4, 9, 30)))[: rng.randrange(1, 200)]
        out.append(words)
    for _ in range(10):  # runs inside the periods of other runs, and blocks of one word of many lengths
        inner = [b"p"] * 26 + [rng.choice((b"q", b"r")) for _ in range(6)]
        out.append(inner * 4 + inner[: rng.randrange(len(inner))])
        out.append([w for k in range(20) for w in [b"0"] * rng.randrange(60) + [b"%d" % (k % 2)]])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("least", "times"), [(24, 3), (4, 2), (10, 4)])
def test_runs_equal_plain_search(monkeypatch, seed, least, times):
    monkeypatch.setattr(periodic, "BLOCK", 8)
    for words in texts(seed):
        assert periodic.find_runs(words, least, times) == brute(words, least, times)


def test_long_run_of_one_word_and_of_many_blocks():
    words = [b"0"] * 200_000
    assert periodic.find_runs(words) == [(0, 200_000, 1)]
    blocks = [w for k in range(3000) for w in [b"0"] * (24 + k % 7) + [b"x%d" % k]]
    assert len(periodic.find_runs(blocks)) == 3000


def test_collapse_keeps_other_texts_and_columns(spark):
    run = "one two three " * 10
    rows = [(1, f"before {run}after", 5, 6), (1, f"before {run}after", 5, 6), (2, "no  run\there", 7, 8), (None, None, 1, 2), (3, "", 1, 2), (4, "été " * 30, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long, collapsed long")
    got = [tuple(r) for r in periodic.collapse_runs(docs).orderBy("doc_id").collect()]
    assert got == [(None, None, 1, 2), (1, "before one two three after", 5, 6), (1, "before one two three after", 5, 6), (2, "no  run\there", 7, 8), (3, "", 1, 2), (4, "été", 1, 2)]
    assert periodic.collapse_runs(docs.limit(0)).count() == 0
    found = {r["doc_id"]: r for r in periodic.detect_runs(docs).collect()}
    assert [tuple(r) for r in found[1]["runs"]] == [(1, 30, 3)] and found[None]["runs"] == [] and found[None]["collapsed"] == ""


def test_query_columns_against_plain_search(spark, tmp_path):
    rng = random.Random(5)
    rows: list[tuple[int | None, str | None]] = [(None, "a " * 40), (7, None), (8, " \n")]
    for k in range(10, 400):
        rows.append((k, " ".join(rng.choice("abcdefghij") + rng.choice("xyzé") for _ in range(rng.choice((1, 5, 60, 200))))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    runs_seen = 0
    for doc, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode())
        if doc is not None and words and h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        runs_seen += len(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert got[doc] == {
            "doc_id": doc,
            "n_runs": len(runs),
            "start": best and best[0],
            "length": best and best[1],
            "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
        }
    assert runs_seen > 10
