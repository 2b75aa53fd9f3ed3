"""Documents whose word shingle sets have a Jaccard similarity of at least a threshold.

Tokens (hashed shingles) have one global order: rare ones by hash, then frequent ones.  Two similar sets
share a token among the first ``size - overlap + 1`` rare ones of each, or all they share is frequent
and then they share a combination of frequent tokens in an extended prefix.  So rare tokens are
indexed singly and frequent ones, for the few documents made mostly of them, in pairs of one class.

1. Every text gives its set size and the tokens with the smallest hashes: the prefix and a reserve.
   Equal sets (by a 128-bit digest) fold into the document with the smallest id.
2. Tokens in two or more prefixes make buckets.  Stars first: each document is compared with one pivot
   per bucket, exactly, and what is linked becomes one component.  A group of thousands of copies costs
   a row per copy here and disappears, since buckets inside one component are dropped.
3. A token is frequent when more than ``FEW`` documents outside its largest component hold it (a passage
   that many documents share).  A document with more frequent tokens than its reserve gets its whole set
   indexed; counting is repeated until every document has a full prefix of rare tokens or is whole.
4. Left are rare buckets with several components and the combinations.  Pairs across components become
   rows only where sizes and parity bits allow a link (bits that differ are tokens that differ), and are
   verified on the whole sets.  Buckets longer than ``SHORT`` are dealt to blocks that are compared as
   matrices: comparisons, not rows, grow with the square of a group of variants that do not link.  Near
   copies meet in most of their buckets, so each row carries its ``FIRSTS`` most frequent ones and a pair
   that shares one of them is given out by the first such bucket alone.  In buckets bits grow with the set
   up to ``MOST_WORDS`` words; beyond some 1,500 shingles they tell less apart, which makes more rows and
   changes no result.

No link between different components is lost, and no pair within one is looked at again.  All counts
cover all documents; no bucket is capped.

Defined results: null or blank text has the empty set and links with nothing; fewer words than a
shingle make one shingle of the whole sequence; rows of one id are one node; rows without id have no
component.  A repeated row links as often as it occurs, which changes nothing.  Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.llm.graph import components
from labelkit.llm.registry import query
from labelkit.llm.words import space_words
from labelkit.operators.bounded import join_small
from labelkit.plans.registry import table
from labelkit.session import written

WORDS = 5
PERCENT = 75
FEW = 20
SHORT = 8
BLOCK = 1_000
FLUSH = 200_000
SHARE, LEAST_WORDS, MOST_WORDS = 4, 4, 16
FIRSTS = 4
MAX_IDS = 2_000_000
"""Largest number of 8-byte ids that is broadcast; beyond it a shuffle join is taken."""

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    listed = space_words(text)
    n = len(listed)
    if not n:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, listed), np.uint64, n)
    width = min(words, n)
    factor = [_FACTORS[k % len(_FACTORS)] + np.uint64(2 * (k // len(_FACTORS))) for k in range(width)]
    total = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = total + h[k : n - width + 1 + k] * factor[k]
        return np.unique(_mixed(total).view(np.int64))


def least_overlap(size: int, percent: int = PERCENT) -> int:
    """Tokens a set of this size shares with any similar one, at least."""
    return -(-percent * size // 100)


def _prefix(size: int, percent: int) -> tuple[int, int]:
    """(rare tokens needed, reserve)."""
    need = size - least_overlap(size, percent) + 1
    return need, need // 16 + 2


def _mapped(rows: DataFrame, schema: str, build) -> DataFrame:
    """``build(set, id) -> tuple of column values`` over (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            yield build(batch.column("id"), sets)

    return rows.mapInArrow(run, schema)


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))


def parity_bits(tokens: np.ndarray, share: int = SHARE, most: int | None = MOST_WORDS) -> bytes:
    """For each class of hashes (about ``share`` for each token, 64 * ``most`` at most) whether it holds an odd number of tokens."""
    words = max(LEAST_WORDS, 1 << max(0, (share * len(tokens) - 1).bit_length() - 6))
    size = 64 * (words if most is None else min(most, words))
    odd = np.bincount((tokens & (size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """The bits of half as many classes, and so on, until each row has ``width`` words."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(id, n, digest, bits, tokens): set size, digest and parity bits of the set, and the tokens with the smallest hashes."""

    def build(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        take = [sum(_prefix(len(s), percent)) if len(s) else 0 for s in sets]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.record_batch(
            [
                ids,
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([parity_bits(s) for s in sets], pa.binary()),
                _arrays([s[:t] for t, s in zip(take, sets)]),
            ],
            ["id", "n", "digest", "bits", "tokens"],
        )

    return _mapped(rows, "id long, n long, digest binary, bits binary, tokens array<long>", build)


def whole_sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tokens, bits) of the rows whose id is in ``ids``; these bits grow with the set."""
    chosen = join_small(rows, ids, "id", "left_semi", MAX_IDS)

    def build(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([ids, _arrays(sets), pa.array([parity_bits(s, 2, None) for s in sets], pa.binary())], ["id", "tokens", "bits"])

    return _mapped(chosen, "id long, tokens array<long>, bits binary", build)


def verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: parity bits rule most others out, whole sets decide the rest."""
    pairs = written(pairs, "pairs")
    sets = written(whole_sets(rows, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), "sets")
    sized = sets.select("id", F.size("tokens").cast("long").alias("n"), "bits")
    ends = [sized.select(F.col("id").alias(e), F.col("n").alias(f"n{e}"), F.col("bits").alias(f"bits{e}")) for e in "ab"]
    close = written(_bits_fit(pairs.join(ends[0], "a").join(ends[1], "b"), percent).distinct(), "close-pairs")
    both = close.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            lists = [batch.column(c) for c in ("ta", "tb")]
            values = [x.values.to_numpy() for x in lists]
            offsets = [x.offsets.to_numpy() for x in lists]
            for i in range(batch.num_rows):
                x, y = (v[o[i] : o[i + 1]] for v, o in zip(values, offsets))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(common) and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _bits_fit(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the (a, b, na, nb, bitsa, bitsb) rows whose bits differ no more than those of similar sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.add(*(batch.column(c).to_numpy() for c in ("na", "nb")))
            by: dict[tuple[int, int], list[int]] = {}
            bits = [batch.column(c).to_pylist() for c in ("bitsa", "bitsb")]
            for k, (x, y) in enumerate(zip(*bits)):
                by.setdefault((len(x) // 8, len(y) // 8), []).append(k)
            good = np.zeros(batch.num_rows, bool)
            for widths, at in by.items():
                x, y = (_folded(np.frombuffer(b"".join(side[k] for k in at), np.uint64).reshape(-1, w), min(widths)) for side, w in zip(bits, widths))
                good[at] = (100 + percent) * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (100 - percent) * total[at]
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return pairs.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")


def _as_links(linked: DataFrame) -> DataFrame:
    """(a, b): the components known so far, a link for each member, in place of all links that made them."""
    return linked.select(F.col("id").alias("a"), F.col("component").alias("b"))


def _across(buckets: DataFrame) -> DataFrame:
    """Rows (token, id, n, component) of tokens that more than one component holds."""
    spread = buckets.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    return buckets.join(spread, "token", "left_semi")


def _in_components(buckets: DataFrame, linked: DataFrame) -> DataFrame:
    rows = buckets.select("token", "id", "n")
    return join_small(rows, linked.select("id", "component"), "id", "left", MAX_IDS).select("token", "id", "n", F.coalesce("component", "id").alias("component"))


def _fits(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _stars(buckets: DataFrame, pivot: F.Column) -> DataFrame:
    """(a, b): documents and the pivots they share many tokens with; which pairs are tried here decides speed, never the result."""
    pivots = buckets.groupBy("token").agg(pivot.alias("pivot"))
    tried = buckets.select("token", "id", "n").join(pivots, "token").where("id <> pivot")
    shared = tried.groupBy("id", "pivot").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    return shared.where("c * 10 >= n").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs (a, b) that are not in one component yet."""
    for end in ("a", "b"):
        pairs = join_small(pairs, linked.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")), end, "left", MAX_IDS)
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _frequent(buckets: DataFrame) -> DataFrame:
    """(token, times): tokens that more than FEW documents outside the token's largest component hold."""
    many = buckets.groupBy("token").count().where(F.col("count") > FEW).select("token")
    sizes = join_small(buckets, written(many, "many"), "token", "left_semi", MAX_IDS).groupBy("token", "component").agg(F.count("*").alias("c"))
    return sizes.groupBy("token").agg(F.sum("c").alias("times"), F.max("c").alias("most")).where(F.col("times") - F.col("most") > FEW).select("token", "times")


def _combined(held: DataFrame, percent: int) -> DataFrame:
    """(token, id, n): pairs of frequent tokens of documents made mostly of them.

    ``held`` is (id, n, f, tokens): all their frequent tokens, rarest first.  Two such documents that
    are similar share ``overlap`` of them, so the first ``classes + 1`` shared ones lie in both extended
    prefixes, and two of those fall into one class.  The number of classes follows the size, so that
    combinations grow in proportion to it; neighbouring size levels are both indexed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, sizes = [], [], []
            for doc, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "tokens"))):
                level = n.bit_length()
                for at in (level, level + 1):
                    classes = max(1, (1 << at) // 64)
                    extended = tokens[: len(tokens) - least_overlap(n, percent) + classes + 1]
                    by: dict[int, list[int]] = {}
                    for t in extended:
                        by.setdefault(t % classes, []).append(t)
                    single = least_overlap(n, percent) < classes + 1
                    for group in by.values():
                        for i, x in enumerate(group):
                            if single:  # too few shared tokens for a pair to be sure of: index them singly
                                keys.append(xxhash.xxh3_64_intdigest(b"%d,%d" % (at, x)) - (1 << 63))
                                ids.append(doc)
                                sizes.append(n)
                            for y in group[i + 1 :]:
                                keys.append(xxhash.xxh3_64_intdigest(b"%d,%d,%d" % (at, *sorted((x, y)))) - (1 << 63))
                                ids.append(doc)
                                sizes.append(n)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["token", "id", "n"])

    return held.select("id", "n", "tokens").mapInArrow(run, "token long, id long, n long")


def _close(a: list[tuple], b: list[tuple], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in two lists of (id, n, component, bits, ...) of the pairs across components that can be similar.

    Similar sets differ in at most ``(100 - percent) / (100 + percent)`` of the sum of their sizes, and each
    parity bit that differs stands for a token that does.
    """
    sides = []
    for rows in (a, b):
        by: dict[int, list[int]] = {}
        for i, row in enumerate(rows):
            by.setdefault(len(row[3]) // 8, []).append(i)
        sides.append(
            {
                width: (np.array(at), np.array([rows[i][1:3] for i in at], np.int64), np.frombuffer(b"".join(rows[i][3] for i in at), np.uint64).reshape(-1, width))
                for width, at in by.items()
            }
        )
    for wa, (at_a, known_a, bits_a) in sides[0].items():
        for wb, (at_b, known_b, bits_b) in sides[1].items():
            width = min(wa, wb)
            x, y = _folded(bits_a, width), _folded(bits_b, width)
            low = min(width, max(LEAST_WORDS, width // SHARE))
            short_x, short_y = _folded(x, low), np.ascontiguousarray(_folded(y, low).T)
            for k in range(0, len(x), 64):  # bounded memory
                na, ca = known_a[k : k + 64, :1], known_a[k : k + 64, 1:]
                nb, cb = known_b[:, 0], known_b[:, 1]
                can = (ca != cb) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                if not can.any():
                    continue
                most = ((100 - percent) / (100 + percent)) * (na + nb) + 1e-6
                differ = np.zeros(can.shape, np.uint16)
                for w in range(low):
                    differ += np.bitwise_count(short_x[k : k + 64, w, None] ^ short_y[w])
                i, j = np.nonzero(can & (differ <= most))
                if low < width:  # few are left for all bits
                    fit = np.bitwise_count(x[k + i] ^ y[j]).sum(1, dtype=np.int64) <= most[i, j]
                    i, j = i[fit], j[fit]
                yield at_a[k + i], at_b[j]


def _met(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that can be similar of the blocks ``lo`` and ``hi`` of a bucket.

    ``groups`` is (token, lo, hi, block, id, n, component, bits, firsts).  All lists of ``firsts`` follow one order of
    buckets, so the first one that two rows share is the same seen from both, and they meet there: other buckets
    leave the pair to it.
    """

    def pairs(group: list[tuple]) -> Iterator[tuple[int, int]]:
        token, lo, hi = group[0][:3]
        sides = [[r[4:] for r in group if r[3] == block] for block in (lo, hi)]
        for i, j in _close(*sides, percent):
            for x, y in zip(i.tolist(), j.tolist()):
                (a, *_, ours), (b, *_, theirs) = sides[0][x], sides[1][y]
                if (a < b or a > b and lo != hi) and next((t for t in ours if t in theirs), token) == token:
                    yield min(a, b), max(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: set[tuple[int, int]]) -> pa.RecordBatch:
            a, b = list(zip(*found)) or ((), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        group: list[tuple] = []
        found: set[tuple[int, int]] = set()  # a pair meets in many buckets
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:3] != group[0][:3]:
                    found.update(pairs(group))
                    group = []
                    if len(found) > FLUSH:
                        yield made(found)
                        found.clear()
                group.append(row)
        if group:
            found.update(pairs(group))
        yield made(found)

    dealt = groups.select("token", "lo", "hi", "block", "id", "n", "component", "bits", "firsts").repartition("token", "lo", "hi")
    return dealt.sortWithinPartitions("token", "lo", "hi").mapInArrow(run, "a long, b long")


def _met_in_rows(few: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that can be similar of short buckets, at most ``SHORT`` for each row of one."""
    names = {"token": "t", "id": "", "n": "n", "component": "c", "bits": "bits"}
    ends = [few.select(*[F.col(name).alias(short + e) for name, short in names.items()]) for e in "ab"]
    apart = (F.col("ta") == F.col("tb")) & (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & _fits("na", "nb", percent)
    return _bits_fit(ends[0].join(ends[1], apart), percent)


def _rarest(rare: DataFrame, frequent_in: DataFrame, percent: int) -> DataFrame:
    """(id, n, component, by): of each document its rarest buckets, as many as a link needs.

    Similar sets of sizes na and nb share at least ``o`` tokens, so of the smallest hashes of the set whose list
    ends first (``L`` of ``size``) at least ``L - (size - o)`` are shared and stand in both lists; all of them are
    in buckets but the frequent ones.  Over all sizes that fit, this is at least ``need``.  Documents with fewer
    buckets leave.  The rarest shared bucket is not among the ``need - 1`` most frequent of either document.
    """
    by = rare.groupBy("id", "n", "component").agg(F.array_sort(F.collect_set(F.struct("times", "token"))).alias("by"))
    by = join_small(by, frequent_in.select("id", "f"), "id", "left", MAX_IDS)
    fewest = f"least(ceil({percent} * n / 100.0), 3 + floor((floor({percent * (100 - percent)} * n / 10000.0) + 1) / 16))"
    need = F.greatest(F.lit(1), F.expr(f"{fewest} - coalesce(f, 0)"))
    room = (F.size("by") - need + 1).cast("int")
    return by.withColumn("room", room).where("room > 0").select("id", "n", "component", F.slice("by", F.lit(1), F.col("room")).alias("by"))


def _alike(rare: DataFrame, combined: DataFrame, frequent_in: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs in different components that share a bucket and can be similar by size and parity bits."""
    buckets = rare.select("token", "id", "n", "component").unionByName(combined.select("token", "id", "n", "component"))
    times = written(buckets.groupBy("token").agg(F.count("*").alias("times")), "times")
    counted = [join_small(b, times, "token", "inner", MAX_IDS) for b in (rare, combined)]
    pairs_of_tokens = counted[1].groupBy("id", "n", "component").agg(F.array_sort(F.collect_set(F.struct("times", "token"))).alias("by"))
    firsts = F.slice(F.reverse("by.token"), 1, FIRSTS).alias("firsts")  # both lists stand in one order
    chosen = written(_rarest(counted[0], frequent_in, percent).unionByName(pairs_of_tokens).select("*", firsts), "chosen")
    held = written(chosen.select(F.explode("by.token").alias("token")).groupBy("token").agg(F.count("*").alias("times")).where("times > 1"), "held")
    bits = join_small(base.select("id", "n", "bits"), chosen.select("id", "n").distinct(), ["id", "n"], "left_semi", MAX_IDS).distinct()
    lists = chosen.join(bits, ["id", "n"]).select("id", "n", "component", "bits", "firsts", F.explode("by.token").alias("token"))
    lists = written(join_small(lists, held, "token", "inner", MAX_IDS), "lists")
    blocks = F.ceil(F.col("times") / BLOCK).cast("int")
    each = lists.where(F.col("times") > SHORT).withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))
    groups = each.select("token", F.inline(other), "block", "id", "n", "component", "bits", "firsts")
    return _met_in_rows(lists.where(F.col("times") <= SHORT), percent).union(_met(groups, percent)).distinct()


def linked_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """((id, n) of every row, (id, component) of the linked ids)."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    known = rows.where("id IS NOT NULL")
    base = written(prefixes(rows, percent), "prefixes")
    sized = base.where("id IS NOT NULL AND n > 0")
    firsts = sized.groupBy("digest").agg(F.min("id").alias("lead"), F.count("*").alias("times")).where("times > 1").select("digest", "lead")
    folded = written(join_small(sized.select("id", "digest"), written(firsts, "equal-sets"), "digest", "inner", MAX_IDS).where("id <> lead").select("id", "digest", "lead"), "equal")
    equal = folded.select(F.col("id").alias("a"), F.col("lead").alias("b"))
    # only the row whose set is the lead's leaves the index: other texts of its id stay
    entries = join_small(sized, folded.select("id", "digest").distinct(), ["id", "digest"], "left_anti", MAX_IDS).select("id", "n", F.explode("tokens").alias("token"))
    shared = entries.groupBy("token").count().where("count > 1").select("token")
    buckets = written(join_small(entries, written(shared, "shared"), "token", "left_semi", MAX_IDS), "buckets")

    links = written(verified(_stars(buckets, F.min("id")), known, percent), "star-links")
    linked = written(components(links), "components")
    # the second pivot is the best linked document of a bucket, which is near the middle of its group
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("degree"))
    ranked = join_small(buckets, written(degree, "degrees"), "id", "left", MAX_IDS).na.fill(0, ["degree"])
    more = written(verified(_apart(_stars(ranked, F.max_by("id", "degree")), linked), known, percent), "star-links")
    linked = written(components(_as_links(linked).unionByName(more)), "components")
    buckets = written(_across(_in_components(buckets, linked)), "buckets")

    need, first = F.expr(f"n - ceil({percent} * n / 100.0) + 1"), f"n - ceil({percent} * n / 100.0) + 1"
    listed = F.expr(f"least(n, {first} + floor(({first}) / 16) + 2)")
    longer, extra = None, None  # (id, n, size) of longer lists, and their tokens beyond the base list
    while True:
        frequent = written(_frequent(buckets), "frequent")
        marked = join_small(buckets, frequent, "token", "inner", MAX_IDS)
        count = written(marked.groupBy("id").agg(F.count_distinct("token").alias("f"), F.max("n").alias("n")), "frequent-in")
        state = count if longer is None else join_small(count, longer.select("id", "size"), "id", "left", MAX_IDS)
        size = listed if longer is None else F.coalesce("size", listed)
        short = state.select("id", "n", "f", size.cast("long").alias("size")).where((F.col("size") < F.col("n")) & (F.col("size") - F.col("f") < need))
        short = written(short.select("id", "n", F.col("size").alias("have"), F.least("n", F.col("size") + 2 * F.col("f") + 8).alias("size")).distinct(), "short")
        if short.isEmpty():
            break
        # tokens stand in hash order, so a longer list is the next slice of the whole set
        sets = join_small(whole_sets(known, short.select("id")), short, "id", "inner", MAX_IDS)
        added = written(sets.select("id", "n", F.explode(F.slice("tokens", F.col("have").cast("int") + 1, (F.col("size") - F.col("have")).cast("int"))).alias("token")), "added")
        tokens = written(added.select("token").distinct(), "added-tokens")
        grown = short.select("id", "n", "size")
        longer = grown if longer is None else written(join_small(longer, short.select("id"), "id", "left_anti", MAX_IDS).unionByName(grown), "longer")
        extra = added if extra is None else extra.unionByName(added)
        touched = join_small(entries.unionByName(extra), tokens, "token", "left_semi", MAX_IDS)
        kept = join_small(buckets, tokens, "token", "left_anti", MAX_IDS).select("token", "id", "n", "component")
        buckets = written(kept.unionByName(_across(_in_components(touched, linked))), "buckets")

    rare = join_small(buckets, frequent, "token", "left_anti", MAX_IDS)
    held = marked.groupBy("id", "n").agg(F.array_sort(F.collect_set(F.struct("times", "token"))).alias("by"), F.count_distinct("token").alias("f"))
    held = held.where(F.col("f") >= F.expr(f"ceil({percent} * n / 100.0)")).select("id", "n", "f", F.transform("by", lambda x: x.token).alias("tokens"))
    combined = written(_across(_in_components(_combined(held, percent), linked)), "combined")
    alike = _alike(rare, combined, count, base, percent)
    last = written(verified(alike, known, percent), "links")
    return base.select("id", "n"), written(components(_as_links(linked).unionByName(last).unionByName(equal)), "components")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of similar ones: the smallest id (every row of it)."""
    _, linked = linked_components(docs, key, text, percent)
    gone = linked.where("id <> component").select(F.col("id").alias(key))
    return join_small(docs, gone, key, "left_anti", MAX_IDS)


@query(
    r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM split),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS whole FROM shingles GROUP BY doc_id),
leads AS (SELECT min(doc_id) AS doc_id, any_value(n) AS n, whole FROM sizes GROUP BY whole),
shared AS (SELECT hash(s) AS s, doc_id, n FROM shingles JOIN leads USING (doc_id)
           WHERE s IN (SELECT s FROM shingles JOIN leads USING (doc_id) GROUP BY s HAVING count(*) > 1)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b
          ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
          UNION ALL SELECT l.doc_id, s.doc_id FROM sizes s JOIN leads l USING (whole) WHERE s.doc_id <> l.doc_id
          UNION ALL SELECT s.doc_id, l.doc_id FROM sizes s JOIN leads l USING (whole) WHERE s.doc_id <> l.doc_id),
reached AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
)
def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    sizes, linked = linked_components(table(spark, folder, "documents"))
    return join_small(sizes, linked, "id", "left", MAX_IDS).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
