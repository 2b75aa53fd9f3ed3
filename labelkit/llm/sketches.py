"""Near duplicates by bottom-k sketches: the k smallest values of one hash function over a set's shingles.

1. Every text gives its set size, a digest of the whole set and its sketch.  Equal sets fold by digest.
2. Inverted lists of retained values: a value that one set alone retains pairs nothing.  Of two similar
   sets the k smallest values of the union are shared with probability of the similarity, so both retain
   at least ``least_shared`` values in common (exactly, where the union fits a sketch; else but for a
   chance of ``MISS``).  Sets that share fewer values with all others together leave here.
3. Stars: every set is compared with one pivot per list, and once more with the best linked one.  A group of
   thousands of copies costs a row per copy and list, and becomes one component.
4. What is left are lists that several components hold.  For each set in them, its shingles that sets
   of other components hold too are counted exactly, in ``CLASSES`` classes by hash; two sets share at
   most the sum of the smaller counts.  Sets meet in the lists of their rarest values, as many as leave fewer
   than ``least_shared`` of the others, and a pair becomes a row only if sizes and counts allow it.
5. Pairs of 3 and 4 are estimated on the sketch of the union, and those that can be similar are verified by
   exact Jaccard similarity on whole sets.

Defined results: null or blank text has the empty set and links with nothing; fewer words than a shingle
make one shingle of the whole sequence; rows of one id are one node; rows without id have no component
and are kept.  Repeated rows change nothing.  Empty tables give none.  Extra columns pass through
``deduplicated`` whatever they are named, as long as no two share a name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.llm.graph import components
from labelkit.llm.jaccard import shingle_set
from labelkit.llm.registry import query
from labelkit.operators.bounded import join_small
from labelkit.plans.registry import table
from labelkit.session import written

WORDS = 4
PERCENT = 80
K = 128
CLASSES = 32
MISS = 1e-9
FEW = 64
BLOCK = 1_000
"""Lists longer than FEW are compared in groups of two blocks of about BLOCK sets each."""
FLUSH = 200_000
MAX_IDS = 2_000_000
"""Largest number of 8-byte values or ids that is broadcast; beyond it a shuffle join is taken."""


def tail_bound(k: int, percent: int, miss: float = MISS) -> int:
    """The largest m for which fewer than m of k draws succeed with a chance of at most ``miss``."""
    p, total = percent / 100, 0.0
    for m in range(k + 1):
        total += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if total > miss:
            return m
    return k


def least_shared(n: str, k: int, percent: int) -> Column:
    """Retained values that a set of size ``n`` has in common with any similar set, at least."""
    return F.expr(f"if(100 * {n} <= {k * percent}, ({percent} * {n} + 99) div 100, {tail_bound(k, percent)})")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))


def sketched(rows: DataFrame, words: int, k: int) -> DataFrame:
    """(id, n, digest, sketch) of (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            made = [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _lists([s[:k] for s in sets])]
            yield pa.record_batch(made, ["id", "n", "digest", "sketch"])

    return rows.mapInArrow(run, "id long, n long, digest binary, sketch array<long>")


def whole_sets(rows: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, tokens) of the (id, text) rows whose id is in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("id"), _lists([shingle_set(t.as_py(), words) for t in batch.column("text")])], ["id", "tokens"])

    return join_small(rows, ids, "id", "left_semi", MAX_IDS).mapInArrow(run, "id long, tokens array<long>")


def _kept_pairs(pairs: DataFrame, lists: DataFrame, column: str, keep) -> DataFrame:
    """The pairs (a, b) for which ``keep(list of a, list of b)`` holds; ``lists`` is (id, column)."""
    ends = [lists.select(F.col("id").alias(e), F.col(column).alias(f"list_{e}")) for e in "ab"]
    both = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "list_a", "list_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("list_a", "list_b")]
            values, offsets = [c.values.to_numpy() for c in columns], [c.offsets.to_numpy() for c in columns]
            good = [keep(*(v[o[i] : o[i + 1]] for v, o in zip(values, offsets))) for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def union_estimate(x: np.ndarray, y: np.ndarray, k: int) -> tuple[int, int]:
    """(shared, size) of the sketch of the union of two sets, from their sorted sketches."""
    shared, union = np.intersect1d(x, y, assume_unique=True), np.union1d(x, y)[:k]
    return int(np.searchsorted(shared, union[-1], "right")) if len(union) else 0, len(union)


def verified(pairs: DataFrame, base: DataFrame, rows: DataFrame, words: int, percent: int, k: int) -> DataFrame:
    """The similar ones of the pairs (a, b): estimated on union sketches, then decided on whole sets."""
    bound = tail_bound(k, percent)

    def likely(x: np.ndarray, y: np.ndarray) -> bool:
        shared, size = union_estimate(x, y, k)
        return shared >= bound if size == k else 100 * shared >= percent * size

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * shared >= percent * (len(x) + len(y) - shared) > 0

    pairs = written(pairs, "sketch-pairs")
    ids = lambda p: p.select(F.col("a").alias("id")).union(p.select("b")).distinct()
    held = join_small(base.select("id", "sketch"), ids(pairs), "id", "left_semi", MAX_IDS)
    close = written(_kept_pairs(pairs, held, "sketch", likely), "likely-pairs")
    return _kept_pairs(close, whole_sets(rows, ids(close), words), "tokens", similar)


def _placed(values: DataFrame, linked: DataFrame) -> DataFrame:
    """``values`` with the component of each id, only values that several components hold."""
    rows = join_small(values, linked.select("id", "component"), "id", "left", MAX_IDS).withColumn("component", F.coalesce("component", "id"))
    spread = rows.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("value")
    return join_small(rows, written(spread, "spread"), "value", "left_semi", MAX_IDS)


def _stars(index: DataFrame, pivot: Column) -> DataFrame:
    """(a, b): sets and the pivots that a quarter of their needed values point to; which are tried decides speed, never the result."""
    pivots = index.groupBy("value").agg(pivot.alias("pivot"))
    tried = index.select("value", "id", "need").join(pivots, "value").where("id <> pivot")
    often = tried.groupBy("id", "pivot").agg(F.count("*").alias("c"), F.max("need").alias("need")).where("4 * c >= need")
    return often.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _outside_counts(rows: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(id, outside): of each member (id, component), its shingles that another component holds, counted by class."""
    each = whole_sets(rows, members.select("id"), words).select("id", F.explode("tokens").alias("value"))
    each = written(join_small(each, members, "id", "inner", MAX_IDS).distinct(), "member-shingles")
    spread = each.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("value")
    held = join_small(each, spread, "value", "left_semi", MAX_IDS).select("id", F.pmod("value", F.lit(CLASSES)).alias("class"))
    return held.groupBy("id").agg(F.array(*[F.sum((F.col("class") == c).cast("int")).cast("int") for c in range(CLASSES)]).alias("outside"))


def _across(index: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): pairs of different components that can be similar; ``index`` is (value, c, id, digest, n, need, component)."""
    own = ["id", "digest", "n", "need", "component"]
    by = index.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("by"))
    by = by.withColumn("room", (F.size("by") - F.col("need") + 1).cast("int")).where("room > 0")
    by = written(by.select("id", "n", "component", F.slice("by", F.lit(1), F.col("room"))["value"].alias("values")), "rare-values")
    outside = _outside_counts(rows, by.select("id", "component").distinct(), words)
    total = F.aggregate("outside", F.lit(0), lambda s, x: s + x)
    # a set shares no more than all it has in common with other components
    able = by.join(outside.withColumn("total", total), "id").where(100 * F.col("total") >= percent * F.col("n"))
    lists = written(able.select("id", "n", "component", "total", "outside", F.explode("values").alias("value")), "rare-lists")
    held = written(lists.groupBy("value").agg(F.count("*").alias("count")).where("count > 1"), "held")
    dealt = join_small(lists, held, "value", "inner", MAX_IDS)
    names = {"value": "v", "id": "", "n": "n", "component": "c", "total": "t", "outside": "o"}
    few = dealt.where(F.col("count") <= FEW)
    ends = [few.select(*[F.col(name).alias(f"{short}{e}") for name, short in names.items()]) for e in "ab"]
    most = sum(F.least(F.get("oa", F.lit(c)), F.get("ob", F.lit(c))) for c in range(CLASSES))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    enough = lambda common: (100 + percent) * common >= percent * (F.col("na") + F.col("nb"))
    apart = (F.col("va") == F.col("vb")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    met = ends[0].join(ends[1], apart & fits & enough(F.least("ta", "tb")) & enough(most)).select("a", "b")
    return met.union(_met_in_blocks(dealt.where(F.col("count") > FEW), percent)).distinct()


def _met_in_blocks(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of long lists that sizes and counts allow; ``lists`` is (value, count, id, n, component, total, outside).

    A list is dealt to blocks, and each two blocks meet in one group, where the bounds are compared as matrices;
    only pairs that pass become rows.
    """
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    each = lists.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))
    rows = each.select("value", F.inline(other), "block", "id", "n", "component", "total", "outside")

    def pairs(group: list[tuple]) -> list[tuple[int, int]]:
        lo, hi = group[0][1], group[0][2]
        sides = [[r for r in group if r[3] == block] for block in (lo, hi)]
        if not sides[0] or not sides[1]:
            return []
        (ia, na, ca, ta), (ib, nb, cb, tb) = (np.array([r[4:8] for r in side], np.int64).T for side in sides)
        oa, ob = (np.array([r[8] for r in side], np.int32) for side in sides)
        need = percent * (na[:, None] + nb)
        can = (ca[:, None] != cb) & (100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb))
        can &= (100 + percent) * np.minimum(ta[:, None], tb) >= need
        x, y = np.nonzero(can & (ia[:, None] < ib) if lo == hi else can)
        out = []
        for k in range(0, len(x), 1 << 16):  # bounded memory
            i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            good = (100 + percent) * np.minimum(oa[i], ob[j]).sum(1, dtype=np.int64) >= need[i, j]
            i, j = ia[i[good]], ib[j[good]]
            out += zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = list(zip(*found)) or ((), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        group: list[tuple] = []
        found: set[tuple[int, int]] = set()  # a pair meets in many lists
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:3] != group[0][:3]:
                    found.update(pairs(group))
                    group = []
                group.append(row)
            if len(found) > FLUSH:
                yield made(list(found))
                found.clear()
        if group:
            found.update(pairs(group))
        yield made(list(found))

    return rows.repartition("value", "lo", "hi").sortWithinPartitions("value", "lo", "hi").mapInArrow(run, "a long, b long")


def linked_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, k: int = K
) -> tuple[DataFrame, DataFrame]:
    """((id, n) of every row, (id, component) of the linked ids)."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    base = written(sketched(rows, words, k), "sketches")
    known, sized = rows.where("id IS NOT NULL"), base.where("id IS NOT NULL AND n > 0")

    firsts = sized.groupBy("digest").agg(F.min("id").alias("lead"), F.count("*").alias("times")).where("times > 1").select("digest", "lead")
    equal = written(join_small(sized.select("id", "digest"), written(firsts, "equal-sets"), "digest", "inner", MAX_IDS).where("id <> lead").distinct(), "equal")
    alone = join_small(sized, equal.select("id", "digest"), ["id", "digest"], "left_anti", MAX_IDS)
    each = alone.select("id", "digest", "n", F.explode("sketch").alias("value"))

    lists = written(each.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), "lists")
    held = join_small(each, lists, "value", "inner", MAX_IDS)
    enough = held.groupBy("id", "digest", "n").agg(F.collect_list(F.struct("c", "value")).alias("by")).withColumn("need", least_shared("n", k, percent))
    index = written(enough.where("size(by) >= need").select("id", "digest", "n", "need", F.inline("by")), "inverted-lists")

    check = lambda pairs: written(verified(pairs, base, known, words, percent, k), "sketch-links")
    links = check(_stars(index, F.min("id")))
    linked = written(components(links), "sketch-components")
    index = written(_placed(index, linked), "inverted-lists")
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("degree"))
    ranked = join_small(index, written(degree, "degrees"), "id", "left", MAX_IDS).na.fill(0, ["degree"])
    place = index.select("id", "component").distinct()
    apart = _stars(ranked, F.max_by("id", F.struct("degree", "id")))
    for end in "ab":
        apart = join_small(apart, place.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")), end, "inner", MAX_IDS)
    links = links.unionByName(check(apart.where("ca <> cb").select("a", "b")))
    linked = written(components(links), "sketch-components")

    left = written(_placed(index.drop("component"), linked), "inverted-lists")
    links = links.unionByName(check(_across(left, known, words, percent)))
    links = links.unionByName(equal.select(F.col("id").alias("a"), F.col("lead").alias("b")))
    return base.select("id", "n"), written(components(links), "sketch-components")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of similar ones: the smallest id (every row of it)."""
    _, linked = linked_components(docs, key, text, words, percent)
    gone = linked.where("id <> component").select(F.col("id").alias(key))
    return join_small(docs, gone, key, "left_anti", MAX_IDS)


@query(
    r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM split),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS whole FROM shingles GROUP BY doc_id),
leads AS (SELECT min(doc_id) AS doc_id, any_value(n) AS n, whole FROM sizes GROUP BY whole),
shared AS (SELECT hash(s) AS s, doc_id, n FROM shingles JOIN leads USING (doc_id)
           WHERE s IN (SELECT s FROM shingles JOIN leads USING (doc_id) GROUP BY s HAVING count(*) > 1)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b
          ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
          UNION ALL SELECT l.doc_id, s.doc_id FROM sizes s JOIN leads l USING (whole) WHERE s.doc_id <> l.doc_id
          UNION ALL SELECT s.doc_id, l.doc_id FROM sizes s JOIN leads l USING (whole) WHERE s.doc_id <> l.doc_id),
reached AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(other, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
)
def op12_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    sizes, linked = linked_components(table(spark, folder, "documents"))
    found = join_small(sizes, linked, "id", "left", MAX_IDS)
    component = F.coalesce("component", "id")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
