"""Stretches of text that repeat themselves: runs of words with a period, found and collapsed.

A run is a stretch with smallest period q (words q apart are equal) of at least ``times`` periods and
``least`` words that no neighbouring word extends.  Per document:

1. A run's first word s and word s + q begin suffixes with a common prefix of ``length - q`` words, which is at
   least ``least * (times - 1) / times``.  Documents in which no stretch of that many words occurs twice
   have no run and cost one sort of window hashes.
2. Otherwise words get ranks by prefix doubling (exact, no hashes), which sort the suffixes and give the longest
   common prefix (LCP) of neighbours.
3. Suffix classes are united by decreasing LCP with union-find, the smaller ordered set of positions
   put into the larger one.  Positions i < j that become neighbours in a set at level L have
   LCP(i, j) = L; if L >= j - i, they lie in a run of smallest period j - i that ends at j + L.  The first
   words s and s + q of every run meet as neighbours: one between them would give a smaller period.
   So the least i per (end, period) is the run's start.

Every document is whole in one task, nothing is shuffled, and memory follows the longest document.

Defined results: null or blank text has no words and no runs, and collapses to the empty text; a null
text stays null in ``collapse_runs``.  Repeated rows and ids are judged one by one, rows without id too.
Extra columns pass through ``collapse_runs`` whatever they are named.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.llm.registry import query
from labelkit.plans.registry import table

LEAST = 24
TIMES = 3
BLOCK = 1024

Run = tuple[int, int, int]
Rewrite = Callable[[object, list[bytes]], list[bytes]]

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Positions:
    """An ordered set of positions in blocks of bounded length."""

    def __init__(self, first: int) -> None:
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The positions before and after ``x``, which is not in the set."""
        b = max(bisect_right(self.heads, x) - 1, 0)
        block = self.blocks[b]
        at = bisect_left(block, x)
        after = block[at] if at < len(block) else self.heads[b + 1] if b + 1 < len(self.heads) else None
        return (block[at - 1] if at else None), after  # a block's head is at most x, unless x precedes all

    def add(self, x: int) -> None:
        b = max(bisect_right(self.heads, x) - 1, 0)
        block = self.blocks[b]
        at = bisect_left(block, x)
        block.insert(at, x)
        if not at:
            self.heads[b] = x
        if len(block) > BLOCK:
            self.blocks[b : b + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
            self.heads.insert(b + 1, block[BLOCK // 2])
        self.size += 1


def repeats_itself(words: list[bytes], span: int) -> bool:
    """Whether some ``span`` consecutive words occur twice, by hash: may say yes wrongly, never no."""
    n = len(words)
    if n <= span:
        return False
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    width = 1
    with np.errstate(over="ignore"):
        while width < span:
            step = min(width, span - width)
            h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ (h[step:] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
            width += step
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _doubled_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, .. words from each position, until all differ; a shorter rest ranks first."""
    ranks, width, n = [ids], 1, len(ids)
    while int(ranks[-1].max()) + 1 < n:
        rank = ranks[-1].astype(np.int64)
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:] + 1
        ranks.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return ranks


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of the suffixes from a and b, pair by pair."""
    n, length = len(ranks[0]), np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < n) & (y < n)
        same = inside & (ranks[level][np.minimum(x, n - 1)] == ranks[level][np.minimum(y, n - 1)])
        length += np.where(same, 1 << level, 0)
    return length


def find_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    span = -(-least * (times - 1) // times)
    if not repeats_itself(words, span):
        return []
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
    ranks = _doubled_ranks(ids)
    order = np.argsort(ranks[-1])
    lcp = _common(ranks, order[:-1], order[1:])
    steps = np.nonzero(lcp >= span)[0]
    steps = steps[np.argsort(-lcp[steps], kind="stable")]
    place, levels = order.tolist(), lcp[steps].tolist()
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}
    ends: dict[tuple[int, int], int] = {}

    def find(k: int) -> int:
        while (up := parent.setdefault(k, k)) != k:
            parent[k] = parent[up]
            k = parent[k]
        return k

    def meet(i: int, j: int, level: int) -> None:
        period = j - i
        if level >= (times - 1) * period and level + period >= least:
            key = (j + level, period)
            ends[key] = min(i, ends.get(key, i))

    for step, level in zip(steps.tolist(), levels):
        a, b = find(step), find(step + 1)
        large, small = (classes.pop(k, None) or Positions(place[k]) for k in (a, b))
        if large.size < small.size:
            large, small, a, b = small, large, b, a
        moved = list(small)
        for k, x in enumerate(moved):
            before, after = large.around(x)
            if before is not None and (k == 0 or moved[k - 1] < before):
                meet(before, x, level)
            if after is not None and (k + 1 == len(moved) or after < moved[k + 1]):
                meet(x, after, level)
        for x in moved:
            large.add(x)
        parent[b] = a
        classes[a] = large
    return sorted((start, end - start, period) for (end, period), start in ends.items())


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that any run contains after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return b" ".join([words[k] for k in np.nonzero(keep)[0]])


def detect_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, rewrite: Rewrite | None = None
) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row.  ``rewrite`` changes a document's words (id, words) beforehand."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, texts = [], [], []
            for doc, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                words = (value.as_py() or b"").split()
                words = rewrite(doc, words) if rewrite else words
                runs = find_runs(words, least, times)
                sizes.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(collapsed(words, runs))
            made = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(found, _RUNS), pa.array(texts, pa.binary())]
            yield pa.record_batch(made, ["id", "n_words", "runs", "collapsed"])

    out = rows.mapInArrow(run, f"id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return out.select(F.col("id").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with the texts that hold runs collapsed to one period each; all other texts stay as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for value in batch.column(at).to_pylist():
                words = (value or "").encode().split()
                runs = find_runs(words, least, times)
                values.append(collapsed(words, runs).decode() if runs else value)
            columns = list(batch.columns)
            columns[at] = pa.array(values, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _periodic_tail(doc: object, words: list[bytes]) -> list[bytes]:
    """The rewriting that the query's contract fixes: every tenth document ends in a repeated stretch."""
    if doc is None or not words:
        return words
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query()
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = detect_runs(table(spark, folder, "documents"), rewrite=_periodic_tail)
    longer = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(longer(best, r), r).otherwise(best))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
