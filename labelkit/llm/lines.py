"""Lines that repeat across a corpus, exactly or within a few edits.

1. Every line gets a 128-bit identity; equal lines fold into one row, with their first place and the
   hashes of their segments, in one aggregation (combined before the shuffle).
2. Segment-partition join: a line is cut into ``edits + 1`` even segments.  Of two lines within
   ``edits`` edits, one segment of the shorter occurs in the longer near its own place, so each line
   probes the index (length, segment, substring) for its own and the ``edits`` smaller lengths, at
   the few starts that the matches left and right of a segment allow.
3. Candidates whose letter counts differ by more than the edits can explain fall out inside the join,
   those with too many words of their own before the verification.
4. The rest is verified by banded bit-parallel edit distance: one step of bit operations per
   character on a window of ``2 * edits + 1`` rows that moves along the diagonal.

Classes are connected components.  Of each class the first line by (document, position) stays.
Everything is DataFrame functions.

Defined results: lines are cut at ``\\n`` and compared without white space around them; lines
without a word are left alone; lines under ``min_chars`` characters are compared exactly; a null text
stays null; a document that loses all its words is dropped (its content stands elsewhere), one that
had none stays; rows of a repeated id are one document and lose the same positions; documents without
id are only compared with others, never cleaned; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.functions.binding import let
from labelkit.llm.graph import components
from labelkit.llm.registry import query
from labelkit.operators.bounded import join_small
from labelkit.plans.registry import table
from labelkit.session import written

EDITS = 2
MIN_CHARS = 16
LETTERS = ("eantiors", "hldbcmwf")
MAX_IDS = 1_000_000
"""Largest number of 8-byte ids that is broadcast."""


def _segment(length: Column, k: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment k: the last ``length % (edits + 1)`` segments are one longer."""
    base, rest = F.call_function("div", length, F.lit(edits + 1)).cast("int"), length % (edits + 1)
    long_before = F.greatest(F.lit(0), F.lit(k) - (edits + 1 - rest))
    return (base * k + long_before).cast("int"), (base + (F.lit(k) >= (edits + 1 - rest)).cast("int")).cast("int")


def _index_keys(line: Column, n: Column, edits: int) -> list[Column]:
    out = []
    for k in range(edits + 1):
        start, size = _segment(n, k, edits)
        out.append(F.xxhash64(F.substring(line, start + 1, size), F.lit(k), n))
    return out


def _probe_keys(line: Column, n: Column, edits: int) -> list[Column]:
    out = []
    for less in range(edits + 1):
        for k in range(edits + 1):
            start, size = _segment(n - less, k, edits)
            for shift in range(max(-k, less - (edits - k)), min(k, less + edits - k) + 1):
                out.append(F.xxhash64(F.substring(line, start + 1 + shift, size), F.lit(k), n - less))
    return out


def _letter_counts(line: Column) -> list[Column]:
    """Counts (modulo 256) of sixteen letters in two longs."""
    size, out = F.octet_length(line), []
    for letters in LETTERS:
        packed = F.lit(0).cast("bigint")
        for k, letter in enumerate(letters):
            count = (size - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).cast("bigint").bitwiseAND(F.lit(255).cast("bigint"))
            packed = packed.bitwiseOR(F.shiftleft(count, 8 * k))
        out.append(packed)
    return out


def _counts_differ(a: list[str], b: list[str]) -> Column:
    """Sum of differences of the letter counts: an edit changes it by two at most."""
    total = F.lit(0).cast("bigint")
    for x, y in zip(a, b):
        for k in range(8):
            part = lambda c: F.shiftright(F.col(c), 8 * k).bitwiseAND(F.lit(255).cast("bigint"))  # noqa: B023, E731
            gap = F.abs(part(x) - part(y))
            total = total + F.least(gap, 256 - gap)
    return total


def _words_allow(a: Column, b: Column, edits: int) -> Column:
    """Whether few enough words stand in one line only.

    An edit takes one word from a line, or two where it removes the blank between them; the difference
    in the number of words bounds how many edits can be of that kind.
    """

    def body(x: Column) -> Column:
        less = F.size(x.a) - F.size(x.b)
        lost = lambda u, v, gap: F.size(F.array_except(u, v)) <= edits + F.floor((edits + gap) / 2)
        return (F.abs(less) <= edits) & lost(x.a, x.b, less) & lost(x.b, x.a, -less)

    return let(F.struct(F.split(a, " ").alias("a"), F.split(b, " ").alias("b")), body)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of ``a`` and ``b`` (``a`` not the longer, both longer than ``edits``) is at most ``edits``.

    Bit t of a word stands for row ``j - edits + t`` of column j.  D0 marks diagonal steps that cost
    nothing, HP and HN horizontal steps of +1 and -1, VP and VN vertical ones.  The score follows the
    lowest diagonal of the band to the last row and then that row to the last column.
    """
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (2 * edits)
    word = lambda x: F.lit(x).cast("bigint")
    inverse = lambda x: x.bitwiseXOR(word(mask))

    def run(pair: Column) -> Column:
        p, t, m = pair.p, pair.t, F.size(pair.p) - 2 * edits  # the pattern has ``edits`` places that match nothing at both ends

        def step(s: Column, j: Column) -> Column:
            char = F.get(t, j - 1)
            match = word(0)
            for bit in range(width):
                match = match + F.when(F.get(p, j + (bit - 1)) == char, word(1 << bit)).otherwise(word(0))

            def moved(x: Column) -> Column:
                d0 = ((x.bitwiseAND(s.vp) + s.vp).bitwiseXOR(s.vp)).bitwiseOR(x).bitwiseOR(s.vn).bitwiseAND(word(mask))

                def more(d0: Column) -> Column:
                    hp, hn = s.vn.bitwiseOR(inverse(d0.bitwiseOR(s.vp))), d0.bitwiseAND(s.vp)
                    row = F.call_function("shiftleft", word(1), F.greatest(m - j + edits, F.lit(0)))
                    along = F.when(hp.bitwiseAND(row) != 0, 1).when(hn.bitwiseAND(row) != 0, -1).otherwise(0)
                    score = s.score + F.when(j + edits <= m, F.when(d0.bitwiseAND(word(top)) != 0, 0).otherwise(1)).otherwise(along)
                    half = F.shiftright(d0, 1)
                    return F.struct(hn.bitwiseOR(inverse(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"), score.cast("int").alias("score"))

                return let(d0, more)

            return let(match, moved)

        first = F.struct(word(mask ^ ((1 << edits) - 1)).alias("vp"), word(0).alias("vn"), F.lit(edits).alias("score"))
        return F.aggregate(F.sequence(F.lit(1), F.size(t)), first, step, lambda s: s.score <= edits)

    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    beyond = F.array_repeat(F.lit(""), edits)
    return (F.length(b) - F.length(a) <= edits) & let(F.struct(F.concat(beyond, chars(a), beyond).alias("p"), chars(b).alias("t")), run)


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line, h1, h2, place): every line with a word, white space around it taken off.

    ``place`` orders lines by (key, pos), those of unknown documents last, as one number, which keeps
    its minimum in the hash aggregate.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.posexplode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")).alias("pos", "raw"))
    rows = rows.select("key", "pos", F.btrim("raw", F.lit(" \t\x0b\x0c\r")).alias("line")).where("line <> ''")
    place = F.expr(f"cast(coalesce(cast(key as decimal(20,0)), {2**63}) as decimal(20,0)) * cast({2**31} as decimal(10,0)) + pos").cast("decimal(38,0)")
    return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), place.alias("place"))


def folded(found: DataFrame) -> DataFrame:
    """(h1, h2, first, times): one narrow row per distinct line."""
    return found.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("times"))


def first_lines(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """Each distinct line once, at its first place; ``repeated`` has the lines with more than one."""
    marked = join_small(found, repeated.select("h1", "h2", "first"), ["h1", "h2"], "left", MAX_IDS)
    return marked.where(F.col("first").isNull() | (F.col("first") == F.col("place"))).select("h1", "h2", "line")


def near_lines(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Verified links (a, b) between the identities of distinct ``lines`` (h1, h2, line)."""
    n = F.col("n")
    sized = lines.select("h1", "h2", "line", F.length("line").alias("n")).where(n >= min_chars)
    keyed = sized.select("h1", F.array(*_index_keys(F.col("line"), n, edits)).alias("index"), F.array(*_probe_keys(F.col("line"), n, edits)).alias("probe"))
    keyed = written(keyed, "line-keys")
    sides = F.array(F.struct(F.lit(True).alias("held"), F.col("index").alias("keys")), F.struct(F.lit(False).alias("held"), F.col("probe").alias("keys")))
    rows = keyed.select("h1", F.inline(sides)).select("h1", "held", F.explode("keys").alias("k"))
    # most substrings stand in one line: what is compared are keys that one line holds and another probes
    met = rows.groupBy("k").agg(F.max("held").alias("held"), F.min("held").alias("all_held"), F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    met = written(met.where("held AND NOT all_held AND lo <> hi").select("k"), "line-met")
    rows = written(join_small(rows, met, "k", "left_semi", MAX_IDS), "line-rows")
    ids = rows.select("h1").distinct()
    found = join_small(sized.select("h1", "h2", "line"), ids, "h1", "left_semi", MAX_IDS)
    one, two = _letter_counts(F.col("line"))
    texts = written(found.select("h1", "h2", "line", one.alias("l1"), two.alias("l2")), "line-texts")
    lettered = rows.join(texts.select("h1", "l1", "l2"), "h1")
    indexed = lettered.where("held").select("k", F.col("h1").alias("i"), F.col("l1").alias("i1"), F.col("l2").alias("i2"))
    probing = lettered.where("NOT held").select("k", F.col("h1").alias("p"), F.col("l1").alias("p1"), F.col("l2").alias("p2"))
    close = (F.col("i") != F.col("p")) & (_counts_differ(["i1", "i2"], ["p1", "p2"]) <= 2 * edits)
    pairs = indexed.join(probing, (indexed.k == probing.k) & close).select(F.least("i", "p").alias("x"), F.greatest("i", "p").alias("y")).distinct()
    pairs = written(pairs, "line-pairs")
    x = texts.select(F.col("h1").alias("x"), F.struct("h1", "h2").alias("a"), F.col("line").alias("la"))
    y = texts.select(F.col("h1").alias("y"), F.struct("h1", "h2").alias("b"), F.col("line").alias("lb"))
    both = pairs.join(x, "x").join(y, "y")
    shorter = F.length("la") <= F.length("lb")
    ordered = both.select("a", "b", F.when(shorter, F.struct(F.col("la").alias("s"), F.col("lb").alias("l"))).otherwise(F.struct(F.col("lb").alias("s"), F.col("la").alias("l"))).alias("o"))
    return ordered.where(_words_allow(F.col("o.s"), F.col("o.l"), edits)).where(within_edits(F.col("o.s"), F.col("o.l"), edits)).select("a", "b")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, first, near): each repeated line with the first place of its class; ``near`` where that is another line's."""
    found = occurrences(docs, key, text)
    lines = written(folded(found), "lines")
    links = written(near_lines(first_lines(found, lines.where("times > 1")), edits, min_chars), "line-links")
    place = lines.select(F.struct("h1", "h2").alias("id"), "first", "times")
    joined = join_small(place, components(links), "id", "left", MAX_IDS)
    lead = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("lead"))
    whole = joined.where("component IS NOT NULL").join(lead, "component").select("id", "first", "lead")
    alone = joined.where("component IS NULL AND times > 1").select("id", "first", F.col("first").alias("lead"))
    return whole.union(alone).select("id.h1", "id.h2", F.col("lead").alias("first"), (F.col("first") != F.col("lead")).alias("near"))


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, cut, n_near): per document the positions to remove, ascending, and how many are near copies only."""
    repeated = written(classes(docs, key, text, edits, min_chars), "line-classes")
    found = occurrences(docs, key, text).select("key", "pos", "h1", "h2", "place").where("key IS NOT NULL")
    extra = join_small(found, repeated, ["h1", "h2"], "inner", MAX_IDS).where("first <> place")
    return extra.groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("cut"), F.count_distinct(F.when(F.col("near"), F.col("pos"))).alias("n_near"))


def _without(text: Column, cut: Column) -> Column:
    def body(pair: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(pair.lines) - 1), pair.cut)
        return F.array_join(F.transform(kept, lambda i: F.get(pair.lines, i)), "\n")

    return let(F.struct(F.split(text, "\n").alias("lines"), cut.alias("cut")), body)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without repeated lines."""
    gone = removed(docs, key, text, edits, min_chars).select(F.col("key").alias("key_"), F.col("cut").alias("cut_"))
    joined = docs.join(gone, docs[key] == F.col("key_"), "left")
    cleaned = joined.withColumn("new_", F.when(F.col("cut_").isNull(), F.col(text)).otherwise(_without(F.col(text), F.col("cut_"))))
    kept = cleaned.where(F.col("cut_").isNull() | F.col("new_").rlike(r"[^\x20\x09-\x0D]"))
    changed = {text: F.col("new_"), chars: F.when(F.col("cut_").isNull(), F.col(chars)).otherwise(F.length("new_")).cast(docs.schema[chars].dataType) if chars in docs.columns else None}
    return kept.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


@query()
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: lines with a word, repeated ones removed, those that are near copies only, and the positions removed."""
    docs = table(spark, folder, "documents")
    gone = removed(docs).select(F.col("key").alias("doc_id"), "cut", "n_near")
    counted = docs.select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")).cast("bigint").alias("n_lines"))
    return counted.join(gone, "doc_id", "left").select(
        "doc_id", "n_lines",
        F.coalesce(F.size("cut"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.coalesce(F.array_join(F.transform("cut", lambda p: p.cast("string")), ","), F.lit("")).alias("removed"),
    )
