"""Quality rules whose cutoffs carry an exact bound on the share of good documents they reject.

Each rule is a number per document, larger is worse.  For every stratum (language) and rule, the
cutoffs of a fixed grid are tested from the most lenient one on: with ``k`` of ``n`` good labelled
documents rejected, the exact binomial tail ``P(Bin(n, risk) <= k)`` is the p-value of "the rule
rejects more than ``risk`` of the good documents".  Testing stops at the first cutoff that is not
certified (fixed sequence), and the level is divided among strata and rules (Bonferroni), so that all
certified cutoffs hold together with the stated confidence.  Among certified cutoffs the one that
catches most bad labelled documents is taken, a lost good one weighing as ``good_weight`` bad ones.
A rule that catches nothing, or a stratum with too few labels, rejects nothing.

Everything is DataFrame functions.  All documents are measured; all labelled rows are counted.

Defined results: null text has no words and fails the base rule; a null stratum is a stratum of its
own; documents without label are judged like the others; of several labels of one document the best
counts; labels of unknown documents are ignored; repeated documents are judged one by one (each
counts in calibration); extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labelkit.functions.binding import let
from labelkit.llm.registry import query
from labelkit.plans.registry import table
from labelkit.session import written

SYMBOLS = "#*$%&|<>"
GRID = [2**k * m // 4 for k in range(13, 4, -1) for m in (7, 6, 5, 4)]
"""Cutoffs in thousandths, lenient to strict."""
RULES = ("symbols", "marks", "capitals", "bars", "dup_lines", "repeats", "long_words")
RISK = 0.05
CONFIDENCE = 0.95
GOOD_WEIGHT = 10
MIN_WORDS = 50


def _repeated_words(words: Column) -> Column:
    """Words inside a three-word window that occurs twice or more.

    Windows are hashed with their position in the low bits, sorted as plain longs, and neighbours
    with equal hashes are compared again by their words, so the count is exact.
    """

    def body(words: Column) -> Column:
        n = F.size(words)

        def with_bits(bits: Column) -> Column:
            # shiftleft takes a plain int in Python; the SQL function takes a column
            shl = lambda x: F.call_function("shiftleft", x, bits)
            shr = lambda x: F.call_function("shiftright", x, bits)
            place = lambda x: x.bitwiseAND(shl(F.lit(1).cast("bigint")) - 1).cast("int")

            def keyed(h: Column) -> Column:
                return F.sort_array(
                    F.transform(
                        F.sequence(F.lit(0), n - 3),
                        lambda i: shl(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))).bitwiseOR(i.cast("bigint")),
                    )
                )

            def likely(s: Column) -> Column:
                same = lambda x, j: shr(x.bitwiseXOR(F.get(s, j))) == 0  # noqa: E731  null beyond the ends, which a filter drops
                return F.transform(F.filter(s, lambda x, j: same(x, j + 1) | same(x, j - 1)), place)

            def proven(p: Column) -> Column:
                return F.sort_array(
                    F.transform(p, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")))
                )

            def equal(s: Column) -> Column:
                def same(x: Column, y: Column) -> Column:
                    return F.coalesce((x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.lit(False))

                kept = F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1)))
                return F.sort_array(F.transform(kept, lambda x: x.i))

            def covered(p: Column) -> Column:
                gaps = F.transform(p, lambda i, j: F.coalesce(F.least(F.get(p, j + 1) - i, F.lit(3)), F.lit(3)))
                return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)

            hashes = F.transform(words, lambda w: F.xxhash64(w))
            sorted_keys = let(hashes, keyed)
            return let(let(let(let(sorted_keys, likely), proven), equal), covered)

        bits = F.length(F.bin(n.cast("bigint")))
        return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(let(bits, with_bits))

    return let(words, body)


def measures(text: Column) -> dict[str, Column]:
    """Counts over the whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    spaced = t
    for space in "\t\n\x0b\x0c\r":  # plain replacements and a split at one character are far cheaper than a pattern
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    words = F.array_remove(F.split(spaced, " "), "")
    plain = t
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    return {
        "counted": let(
            words,
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                _repeated_words(w).alias("n_repeat_words"),
            ),
        ),
        "lined": let(
            lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))
        ),
        "n_symbols": (F.length(t) - F.length(plain)).cast("bigint"),
        "n_bars": (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))).cast("bigint"),
        "n_marks": (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("bigint"),
        "n_capitals": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("bigint"),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ALL_COUNTS = (*COUNTS, "n_lines", "n_bars", "n_marks", "n_capitals")


def _thousandths(part: Column, whole: Column) -> Column:
    return F.coalesce(F.call_function("div", part * 1000, F.nullif(whole, F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"))


def measured(docs: DataFrame, text: str = "text", stratum: str = "lang", name: str = "quality_") -> DataFrame:
    """``docs`` with one struct column ``name`` of counts, rule values, base verdict and stratum."""
    raw, got = f"{name}raw", F.col(f"{name}raw")
    at = {c: got.counted[c] for c in ("n_words", "word_chars", "n_repeat_words")}
    at |= {"n_lines": got.lined.n_lines, "n_dup_lines": got.lined.n_dup_lines}
    at |= {c: got[c] for c in ALL_COUNTS if c not in at}
    rules = {
        "symbols": _thousandths(at["n_symbols"], at["n_words"]),
        "marks": _thousandths(at["n_marks"], at["n_words"]),
        "capitals": _thousandths(at["n_capitals"], at["word_chars"]),
        "bars": _thousandths(at["n_bars"], at["n_words"]),
        "dup_lines": _thousandths(at["n_dup_lines"], at["n_lines"]),
        "repeats": _thousandths(at["n_repeat_words"], at["n_words"]),
        "long_words": _thousandths(at["word_chars"], at["n_words"] * 10),
    }
    failed = (at["n_words"] < MIN_WORDS) | (100 * at["n_repeat_words"] > 50 * at["n_words"])
    return docs.withColumn(raw, F.struct(*[c.alias(n) for n, c in measures(F.col(text)).items()])).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(
            *[at[c].alias(c) for c in COUNTS],
            *[c.alias(n) for n, c in rules.items()],
            failed.alias("base_failed"),
            F.coalesce(F.col(stratum), F.lit("")).alias("stratum"),
        ).alias(name),
    )


def _log_factorial(x: Column) -> Column:
    x = x.cast("double")
    series = x * F.log(x) - x + F.log(x * F.lit(6.283185307179586)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20.0)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """``P(Bin(n, risk) <= k)``, summed downwards from ``k``; 1 where ``k`` is within a standard deviation below the mean or above.

    Terms fall at least geometrically there, and as many are summed as double precision can tell.
    """
    k, n = k.cast("bigint"), n.cast("bigint")
    sigma = F.sqrt(n * F.lit(risk * (1 - risk)))
    below = n * F.lit(risk) - k
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(risk)) + (n - k) * F.log(F.lit(1 - risk)))
    steps = F.least(k, (40 * sigma * sigma / F.greatest(below, F.lit(1.0)) + 60).cast("bigint"))
    odds = (1 - risk) / risk
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    ratio_sum = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), steps),
        start,
        lambda s, j: F.struct((s.term * (k - j) / (n - k + j + 1) * odds).alias("term"), (s.total + s.term).alias("total")),
        lambda s: s.total,
    )
    return F.when(below >= F.greatest(sigma, F.lit(1e-9)), F.least(first * ratio_sum, F.lit(1.0))).otherwise(F.lit(1.0))


def cutoffs(
    rows: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality",
    risk: float = RISK, confidence: float = CONFIDENCE, good_weight: int = GOOD_WEIGHT,
) -> DataFrame:
    """(stratum, rule -> cutoff map) of the certified rules.

    ``rows`` holds ``key`` and the struct of ``measured``.  Only narrow rows are joined; counts are
    pre-aggregated per (stratum, rule, grid step).
    """
    known = labels.select(F.col(key).alias("k"), F.col(good).alias("q")).where("k IS NOT NULL AND q IS NOT NULL").groupBy("k").agg(F.max("q").alias("q"))
    step = lambda c: F.coalesce(F.array_min(F.array(*[F.when(c >= cut, F.lit(i)) for i, cut in enumerate(GRID)])), F.lit(len(GRID)))
    value = F.col("quality_")
    narrow = rows.select(F.col(key).alias("k"), "quality_").where(~value.base_failed & F.col("k").isNotNull())
    per_rule = F.array(*[F.struct(F.lit(r).alias("rule"), step(value[r]).alias("step")) for r in RULES])
    seen = (
        narrow.join(known, "k")
        .select(value.stratum.alias("stratum"), F.col("q"), F.inline(per_rule))
        .groupBy("stratum", "rule", "step")
        .agg(F.sum((F.col("q") > 0).cast("bigint")).alias("good"), F.sum((F.col("q") <= 0).cast("bigint")).alias("bad"))
    )
    seen = written(seen, "cutoff-counts")  # a row per stratum, rule and step; used three times
    group = W.partitionBy("stratum", "rule")
    filled = (
        seen.select("stratum", "rule").distinct().withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(len(GRID) + 1)])))
        .join(seen, ["stratum", "rule", "step"], "left").na.fill(0, ["good", "bad"])
    )
    upto = group.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    tested = filled.select(
        "stratum", "rule", "step",
        F.sum("good").over(upto).alias("lost"), F.sum("bad").over(upto).alias("caught"), F.sum("good").over(group).alias("n"),
    ).where(F.col("step") < len(GRID))
    share = risk / len(RULES)
    level = F.lit((1 - confidence) / len(RULES)) / F.col("strata")
    strata = seen.agg(F.countDistinct("stratum").alias("strata"))
    certified = (
        tested.crossJoin(strata)  # one row: the number of strata
        .withColumn("open", F.max((binomial_tail(F.col("lost"), F.col("n"), share) > level).cast("int")).over(upto))
        .where("open = 0")
    )
    gain = F.col("caught") - good_weight * F.col("lost")
    return (
        certified.where(gain > 0).groupBy("stratum", "rule")
        .agg(F.max_by(F.element_at(F.array(*[F.lit(g) for g in GRID]), F.col("step") + 1), F.struct(gain, -F.col("step"))).alias("cut"))
        .groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))
    )


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` of ``measured`` with a boolean ``kept_``.  The cuts have one row per stratum; Catalyst broadcasts them by size."""
    value = F.col("quality_")
    named = cuts.select(F.col("stratum").alias("stratum_"), F.col("cuts").alias("cuts_"))
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(value[rule] >= F.col("cuts_")[rule], F.lit(False))
    joined = rows.join(named, F.col("quality_.stratum") == F.col("stratum_"), "left")
    return joined.withColumn("kept_", ~value.base_failed & ~over).drop("stratum_", "cuts_")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, all columns as they came.

    Measured twice, once for the narrow calibration table and once on the way out, so that no text
    is shuffled or stored.
    """
    rows = written(measured(docs).select("doc_id", "quality_"), "quality")
    cuts = written(cutoffs(rows, labels), "cutoffs")
    return judged(measured(docs), cuts).where("kept_").select(*[F.col(f"`{c}`") for c in docs.columns])


@query()
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = written(measured(docs).select("doc_id", "quality_"), "quality")
    out = judged(rows, written(cutoffs(rows, labels), "cutoffs"))
    return out.select("doc_id", *[F.col(f"quality_.{c}").alias(c) for c in COUNTS], "quality_.base_failed", F.col("kept_").alias("kept"))
