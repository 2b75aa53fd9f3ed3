"""Benchmark passages in training documents, by a generalised suffix automaton over words.

The items are normalised to words and put into one automaton whose states know which items hold
their strings.  A document is streamed through it once; the state and the length of the longest match
that ends at each word tell every window of ``window`` item words that occurs, and every shorter item
that occurs whole, in time linear in the document.

Scale: the automaton is built in each Python worker from item texts that are broadcast in shards of
at most ``shard_bytes``; a benchmark beyond one shard is matched shard by shard and the hits, which
are few and narrow, are joined back.  Documents are never shuffled for the usual single shard.

Defined results: null or empty texts have no words and no hits; items without words or without id
never match; repeated items count once per id; repeated documents are matched one by one; an empty
benchmark matches nothing; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.llm.registry import query
from labelkit.llm.words import WORD, lower_words
from labelkit.plans.registry import table
from labelkit.session import written

WINDOW = 10
MAX_COVERAGE = 0.5
SHARD_BYTES = 1_000_000
GROUP_BYTES = 32_000_000


class ItemAutomaton:
    """Suffix automaton of many word sequences, with the items of each window and of each short item."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in lower_words(text)]) for name, text in items]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        size = len(self.next)
        self.top = [0] * size  # the state that holds the last ``window`` words of the match
        order = sorted(range(1, size), key=self.length.__getitem__)
        for v in order:
            parent = self.link[v]
            self.top[v] = v if self.length[parent] < window else self.top[parent]
        self.windows: dict[int, set[str]] = {}
        self.shorts: dict[int, list[tuple[int, str]]] = {}
        for name, codes in coded:
            state = 0
            for i, code in enumerate(codes):
                state = self.next[state][code]
                if i + 1 >= window:
                    self.windows.setdefault(self.top[state], set()).add(name)
            if 0 < len(codes) < window:
                while self.length[self.link[state]] >= len(codes):
                    state = self.link[state]
                self.shorts.setdefault(state, []).append((len(codes), name))
        self.short_above = [-1] * size  # nearest state up the links, itself included, where a short item ends
        for v in order:
            self.short_above[v] = v if v in self.shorts else self.short_above[self.link[v]]

    def _clone(self, source: int, length: int, parent: int, code: int) -> int:
        made = len(self.next)
        self.next.append(dict(self.next[source]))
        self.length.append(length)
        self.link.append(self.link[source])
        while parent >= 0 and self.next[parent].get(code) == source:
            self.next[parent][code] = made
            parent = self.link[parent]
        self.link[source] = made
        return made

    def _extend(self, last: int, code: int) -> int:
        known = self.next[last].get(code)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(known, self.length[last] + 1, last, code)
        made = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        parent = last
        while parent >= 0 and code not in self.next[parent]:
            self.next[parent][code] = made
            parent = self.link[parent]
        if parent >= 0:
            target = self.next[parent][code]
            self.link[made] = target if self.length[target] == self.length[parent] + 1 else self._clone(target, self.length[parent] + 1, parent, code)
        return made

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged hit ranges [start, end) over the words, and the items with occurring windows."""
        window, follow, link, length, short_above = self.window, self.next, self.link, self.length, self.short_above
        found: list[list[int]] = []
        items: set[str] = set()
        state = size = 0
        root = follow[0]
        for i, code in enumerate(map(self.ids.get, words)):
            if code is None:
                state = size = 0
                continue
            step = follow[state].get(code)
            if step is not None:
                state = step
                size += 1
            else:
                while state and code not in follow[state]:
                    state = link[state]
                size = length[state] + 1
                state = root[code] if not state else follow[state][code]
            start = -1
            if size >= window:
                start = i - window + 1
                items |= self.windows[self.top[state]]
            at = short_above[state]
            while at >= 0:
                for words_in, name in self.shorts[at]:
                    if words_in <= size:
                        items.add(name)
                        if start < 0 or i - words_in + 1 < start:
                            start = i - words_in + 1
                at = short_above[link[at]]
            if start >= 0:
                while found and found[-1][1] >= start:
                    start = min(start, found.pop()[0])
                found.append([start, i + 1])
        return found, items


_BUILT: dict[int, ItemAutomaton] = {}


def _automaton(shared, window: int) -> ItemAutomaton:
    """The automaton of a broadcast shard, built once in each worker."""
    key = (shared.value["token"], window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ItemAutomaton(shared.value["items"], window)
    return _BUILT[key]


def _merged(ranges: list[list[int]]) -> list[list[int]]:
    """Ranges [start, end) that overlap or touch, as one each."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _matched(shared: list, window: int, texts: list[list[bytes]]) -> list[tuple[list[list[int]], set[str]]]:
    """Merged hit ranges and items of each text over all shards, one automaton in memory at a time."""
    if len(shared) == 1:
        return [_automaton(shared[0], window).match(words) for words in texts]
    found: list[tuple[list[list[int]], set[str]]] = [([], set()) for _ in texts]
    for shard in shared:
        automaton = _automaton(shard, window)
        for (ranges, items), words in zip(found, texts):
            more, names = automaton.match(words)
            ranges += more
            items |= names
    return [(_merged(ranges), items) for ranges, items in found]


def _cut(raw: bytes, ranges: list[list[int]]) -> bytes:
    places, kept, done = [m.span() for m in WORD.finditer(raw)], [], 0
    for a, b in ranges:
        kept.append(raw[done : places[a][0]])
        done = places[b - 1][1]
    return b"".join(kept) + raw[done:]


def _grouped(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``GROUP_BYTES`` of text, so that automata of many shards are built seldom."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= GROUP_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


FOUND = "n_words: long, ranges: array<array<int>>, items: array<string>"
FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])


def _shards(items: DataFrame, item_id: str, text: str, limit: int) -> list[list[tuple[str, bytes]]]:
    """Item texts in shards of about ``limit`` bytes, each a list that fits the driver and a broadcast."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = rows.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    parts = -(-total // limit) or 1
    at = F.pmod(F.xxhash64("i"), F.lit(parts)) if parts > 1 else F.lit(0)
    return [sorted((r["i"], bytes(r["t"])) for r in rows.where(at == k).toLocalIterator()) for k in range(parts)]


def _broadcast(spark: SparkSession, shard: list[tuple[str, bytes]]):
    return spark.sparkContext.broadcast({"token": os.urandom(8), "items": shard})


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``key`` and a struct ``found`` (n_words, word ranges hit, item ids) for each row of ``docs``."""
    spark = docs.sparkSession
    shards = _shards(items, item_id, item_text, shard_bytes)
    many = len(shards) > 1
    narrow = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{text}`").cast("binary").alias("text"),
        *([F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256).alias("digest")] if many else []),
    )
    ids = [c for c in narrow.columns if c != "text"]
    schema = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in ids) + f", found struct<{FOUND}>"

    def over(shard: list[tuple[str, bytes]]) -> DataFrame:
        shared = _broadcast(spark, shard)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared, window)
            for batch in batches:
                out = []
                for value in batch.column("text").to_pylist():
                    words = lower_words(value)
                    ranges, names = automaton.match(words)
                    out.append({"n_words": len(words), "ranges": ranges, "items": sorted(names)})
                yield pa.record_batch([*[batch.column(c) for c in ids], pa.array(out, FOUND_TYPE)], [*ids, "found"])

        return narrow.mapInArrow(run, schema)

    if not many:
        return over(shards[0])
    hits, base = None, None
    for shard in shards:  # one shard at a time in memory; what is kept of each is narrow
        part = written(over(shard), "item-hits")
        base = base or part.select(*ids, "found.n_words")
        part = part.where("size(found.ranges) > 0").select(*ids, "found.ranges", "found.items").distinct()
        hits = part if hits is None else hits.unionByName(part)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("ranges"))),
        F.array().cast("array<array<int>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.get(F.get(done, F.size(done) - 1), F.lit(1)) >= r[0]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.array(F.get(F.get(done, F.size(done) - 1), F.lit(0)), F.greatest(F.get(F.get(done, F.size(done) - 1), F.lit(1)), r[1]))),
            ),
        ).otherwise(F.concat(done, F.array(r))),
    )
    total = hits.groupBy(*ids).agg(merged.alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = base.alias("b").join(total.alias("t"), [F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ids], "left")
    none = F.array().cast("array<array<int>>")
    return joined.select(
        "b.key",
        F.struct("n_words", F.coalesce("ranges", none).alias("ranges"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).alias("found"),
    )


def remove_items(
    docs: DataFrame, items: DataFrame, text: str = "text", chars: str = "n_chars", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_coverage: float = MAX_COVERAGE, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``docs`` without the benchmark passages.

    Hit ranges are cut out of the text (and the text is matched again until nothing is hit, since a
    cut joins what stood around it); a document of whose words more than ``max_coverage`` are hit is
    dropped.  ``chars`` is the length of the new text, where that column exists.  Coverage is judged
    once, on the whole text and the merged ranges of all shards, and all ranges are cut at once, so
    what goes does not depend on how the items are dealt to shards.
    """
    shared = [_broadcast(docs.sparkSession, shard) for shard in _shards(items, item_id, item_text, shard_bytes)]
    names = docs.columns

    def clean(values: list[str | None]) -> list[str | None]:
        raw = {i: v.encode("utf-8", "surrogatepass") for i, v in enumerate(values) if v is not None}
        done, first = list(values), True
        while raw:
            listed = {i: lower_words(r) for i, r in raw.items()}
            hit = {i: ranges for i, (ranges, _) in zip(listed, _matched(shared, window, list(listed.values()))) if ranges}
            if first:
                for i in [i for i, ranges in hit.items() if sum(b - a for a, b in ranges) > max_coverage * len(listed[i])]:
                    done[i] = None
                    del hit[i]
            raw, first = {i: _cut(raw[i], ranges) for i, ranges in hit.items()}, False
            for i, r in raw.items():
                done[i] = r.decode("utf-8", "surrogatepass")
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if len(shared) == 1 else _grouped(batches, text):
            at = batch.schema.get_field_index(text)
            old = batch.column(at).to_pylist()
            new = clean(old)
            keep = pa.array([v is None or n is not None for v, n in zip(old, new)], pa.bool_())
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars in names:
                c = batch.schema.get_field_index(chars)
                sizes = [k if n is None or n == v else len(n) for v, n, k in zip(old, new, batch.column(c).to_pylist())]
                columns[c] = pa.array(sizes, batch.schema.field(c).type)
            yield pa.record_batch(columns, schema=batch.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT k FROM wins),
dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k),
dg AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM dw),
hit AS (SELECT dg.doc_id, dg.p, dg.k, wins.item_id FROM dg JOIN wins USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query(OP1_SQL)
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate(F.col("found.ranges"), F.lit(0).cast("bigint"), lambda s, r: s + r[1] - r[0])
    return found.select(
        F.col("key").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
