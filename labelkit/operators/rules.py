"""Spam and advertisement rules over message tables.

Messages have the columns (msg_id, author_id, channel, thread_id, ts, text).  Pattern rules are rows
of a table, so wording is changed as data.  The rule rows are read once and become columns of a
single pass over the messages: no join, and no message is copied per rule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelkit.functions.text import squeeze
from labelkit.operators.bounded import join_small, local_copy, local_table, spread
from labelkit.operators.ranking import order_range
from labelkit.session import written

MESSAGE_SCHEMA = "msg_id bigint, author_id bigint, channel string, thread_id bigint, ts timestamp, text string"
RULE_SCHEMA = "rule_id string, kind string, pattern string, weight double"

LINK = r"(?i)(https?://|www\.)[^\s<>\"]+"
MENTION = r"(^|[^\w.])@(\w+)"
EVERYONE = r"(^|[^\w.])@(everyone|here)([^\w]|$)"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"

MAX_GRAMS = 2_000_000  # largest number of rows of 8-byte n-grams or keys that is broadcast
MAX_COPIES = 500_000  # the same for rows of a key and a digest

# Default wording. kind "hit" counts towards spam, kind "allow" is an exclusion that overrides hits.
DEFAULT_RULES = [
    ("commercial", "hit", r"(?i)\b(coupons?|vouchers?|rabatt|clearance|wholesale|free shipping)\b|\bprices? (cut|drop|slashed)\w*", 1.0),
    ("clickbait", "hit", r"(?i)\bthis one (trick|secret)\b|\bguaranteed results\b|\bact fast\b|\bbefore it is gone\b", 1.0),
    ("referral", "hit", r"(?i)\brefer a friend\b|\bpassive income\b|\bjoin under (me|us)\b|\bbonus for every signup\b", 1.0),
    ("bait", "hit", r"(?i)\b(repost|retweet|reshare) (this|for)\b|\btag (three|3|five|5) friends\b|\bcomment yes\b", 1.0),
    ("self_promotion", "hit", r"(?i)\b(my|our) (newsletter|podcast|blog|portfolio|boutique)\b", 0.5),
    ("item_talk", "allow", r"(?i)\b(craft|smelt|mine|loot)(ing|ed|s)? (ore|potions?|armou?r|swords?)\b", 0.0),
    ("team_up", "allow", r"(?i)\b(one|two|three) slots? (open|left) in (the|our) (raid|party|squad)\b", 0.0),
    ("achievement", "allow", r"(?i)\bpersonal best\b|\bfirst clear\b|\bmaxed out\b", 0.0),
    ("help_request", "allow", r"(?i)\bhow do i fix\b|\bis it broken for you\b|\bstuck (on|at) (level|stage)\b", 0.0),
    ("free_event", "allow", r"(?i)\b(community|charity) (night|cup|day)\b.{0,40}\bno entry fee\b", 0.0),
    ("context_share", "allow", r"(?i)\bwalkthrough (of|for)\b|\bnotes from the patch\b", 0.0),
]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str
    pattern: str
    weight: float


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str, float]] = DEFAULT_RULES) -> DataFrame:
    ids, kinds, patterns, weights = zip(*rules)
    return local_table(
        spark, {"rule_id": ids, "kind": kinds, "pattern": patterns, "weight": weights}, RULE_SCHEMA
    )


def load_rules(table: DataFrame) -> list[Rule]:
    """Rule rows as the input of expressions. Rules are code kept as data: each becomes a column, however many there are."""
    return [Rule(r.rule_id, r.kind, r.pattern, r.weight) for r in table.select("rule_id", "kind", "pattern", "weight").collect()]


def rule_hits(rules: Sequence[Rule], text: str | Column) -> Column:
    """Array of (rule_id, weight, evidence) for the rules whose pattern occurs in the text."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.coalesce(text, F.lit(""))
    entries = [
        F.when(
            text.rlike(r.pattern),
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(float(r.weight)).alias("weight"),
                F.regexp_extract(text, r.pattern, 0).alias("evidence"),
            ),
        )
        for r in rules
    ]
    return F.array_compact(F.array(*entries)) if entries else F.array().cast(
        "array<struct<rule_id:string,weight:double,evidence:string>>"
    )


def pattern_hits(df: DataFrame, rules: Sequence[Rule], key: str = "msg_id", text: str = "text") -> DataFrame:
    """One row (key, rule_id, evidence) per message and pattern rule that hits."""
    return df.select(key, F.inline(rule_hits([r for r in rules if r.kind == "hit"], text))).select(
        key, "rule_id", "evidence"
    )


def _excluded(rules: Sequence[Rule], text: str) -> Column:
    allow = [F.col(text).rlike(r.pattern) for r in rules if r.kind == "allow"]
    return F.coalesce(reduce(lambda a, b: a | b, allow, F.lit(False)), F.lit(False))


def without_excluded(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """Messages that no exclusion covers."""
    return df.where(~_excluded(rules, text))


def verdicts(
    df: DataFrame,
    rules: Sequence[Rule],
    key: str = "msg_id",
    text: str = "text",
    threshold: float = 1.0,
    extra: dict[str, tuple[Column, float]] | None = None,
) -> DataFrame:
    """Per message: weight of its hits, rule list, and is_spam. An exclusion clears every hit.

    ``extra`` adds rules that are columns already, as name -> (condition, weight).  Everything is
    computed on the message's own row; there is no shuffle.
    """
    hits = rule_hits([r for r in rules if r.kind == "hit"], text)
    for name, (condition, weight) in (extra or {}).items():
        more = F.when(
            condition,
            F.array(
                F.struct(F.lit(name).alias("rule_id"), F.lit(float(weight)).alias("weight"), F.lit("").alias("evidence"))
            ),
        )
        hits = F.concat(hits, F.coalesce(more, F.slice(hits, 1, 0)))
    kept = df.withColumn("hits", F.when(_excluded(rules, text), F.slice(hits, 1, 0)).otherwise(hits))
    return kept.select(
        key,
        F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + h["weight"]).alias("score"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["rule_id"]))).alias("rule_ids"),
    ).withColumn("is_spam", F.col("score") >= threshold)


# -- links, mentions, direct messages ---------------------------------------------------------


def link_count(text: str | Column, link: str = LINK) -> Column:
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(link))


def words_outside_links(text: str | Column, link: str = LINK) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.regexp_replace(text, link, " "), F.lit(r"\w+"))


def bare_links(text: str | Column, min_words: int = 5, link: str = LINK) -> Column:
    """A link with fewer than ``min_words`` words around it."""
    return (link_count(text, link) > 0) & (words_outside_links(text, link) < min_words)


def mentions(text: str | Column) -> Column:
    """Distinct names tagged with ``@``; the part after ``@`` of an e-mail address is no tag."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(MENTION), F.lit(2)))
    # most texts hold no @ at all, and a plain search is much cheaper than the pattern
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast("array<string>"))


def email_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.contains(text, F.lit("@")), F.regexp_count(text, F.lit(EMAIL))).otherwise(0)


def mass_mention(text: str | Column, at_least: int = 10) -> Column:
    """Everyone is tagged, or at least ten different names."""
    column = F.col(text) if isinstance(text, str) else text
    tagged = column.rlike(EVERYONE) | (F.size(mentions(column)) >= at_least)
    return F.contains(column, F.lit("@")) & tagged


def dm_promotion(rules: Sequence[Rule], channel: str = "channel", text: str = "text") -> Column:
    """A commercial pattern inside a direct message."""
    hits = rule_hits([r for r in rules if r.kind == "hit" and r.rule_id == "commercial"], text)
    return (F.col(channel) == "dm") & (F.size(hits) > 0)


def always_authors(df: DataFrame, author: str, condition: Column, at_least: int = 2) -> DataFrame:
    """Authors of at least ``at_least`` posts all of which meet the condition (link-only authors)."""
    met = F.coalesce(condition, F.lit(False)).cast("int")
    return (
        df.groupBy(author)
        .agg(F.count("*").alias("n_posts"), F.min(met).alias("always"))
        .where((F.col("always") == 1) & (F.col("n_posts") >= at_least))
        .drop("always")
    )


def off_topic(
    df: DataFrame, promo: Column, lexicon: DataFrame, key: str = "msg_id", text: str = "text"
) -> DataFrame:
    """Promotional messages that hold no word of the topic lexicon (column ``word``).

    Only the promotional messages' distinct words are exploded; the lexicon is broadcast if its
    checked size allows, otherwise both sides are joined by word.
    """
    promoted = df.where(promo)
    words = promoted.select(
        key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word")
    )
    on_topic = join_small(words, lexicon.select("word").distinct(), "word", "left_semi").select(key).distinct()
    return promoted.select(key).join(on_topic, key, "left_anti")


# -- repetition -------------------------------------------------------------------------------


def message_key(text: str | Column) -> Column:
    """md5 of a message up to case and white space."""
    return F.md5(squeeze(text))


class _HotRanges:
    """Finer time cells for the (group, range) pairs that hold more than ``most`` rows.

    The pairs are counted once, narrowly.  One of n rows is cut into 64 n / ``most`` even cells, so that
    posts may lie unevenly in it; all others are one cell, 0.  A hash collision of two pairs only cuts
    both alike.
    """

    def __init__(self, rows: DataFrame, group: Sequence[str], span: int, most: int) -> None:
        self.key, self.group, self.span = F.xxhash64(*group), list(group), span
        counted = rows.groupBy(self.key.alias("hot_")).agg(F.count("*").alias("n")).where(F.col("n") > most)
        cells = F.least(F.ceil(64 * F.col("n") / most), F.lit(min(span, 1 << 20))).cast("bigint")
        table = counted.select("hot_", cells.alias("cells_"))
        self.table = local_copy(table)
        self.found = self.table is None or not self.table.isEmpty()
        self.table = table if self.table is None else self.table

    def cut(self, rows: DataFrame, at: str, start: str, how: str = "left") -> DataFrame:
        """``rows`` with their ``cell``; ``how="inner"`` keeps those of pairs that are cut."""
        if not self.found:
            return rows.withColumn("cell", F.lit(0).cast("bigint"))
        cell = F.floor((F.col(at) - F.col(start)) * F.col("cells_") / self.span).cast("bigint")
        joined = rows.withColumn("hot_", self.key).join(self.table, "hot_", how)
        return joined.withColumn("cell", F.coalesce(cell, F.lit(0).cast("bigint"))).drop("hot_", "cells_")


def repeats_within(
    df: DataFrame,
    author: str,
    message: str,
    ts: str,
    key: str,
    seconds: int = 3600,
    thread: str | None = None,
    column: str = "n_recent",
    most: int = 200_000,
) -> DataFrame:
    """Per post, how often its author sent this message in the last ``seconds``, itself included.

    With ``thread`` the number of distinct threads is given instead.  A post counts from its own
    time until ``seconds`` later (or until the thread's next post), so the count at any moment is a
    running sum of starts and ends, which stays linear where a sliding window frame is re-read for
    every row.  Time is cut into ranges of that length and a post that is still counted in the next
    range is carried there once, so a single author's posts do not end up in one task.

    A range of one author and message with more than ``most`` rows is cut further: finer cells are
    summed first, the sums of the cells before are added up per range, and each cell starts from what
    it is handed, so neither a burst nor a hot author is one window.  Only rows of the same microsecond
    stay together.  The result does not depend on ``most``.
    """
    us = 1_000_000
    span = seconds * us
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    posts = df.select(author, message, *([thread] if thread else []), F.col(key).alias("post"), at.alias("at"))
    posts = posts.withColumn("range", order_range("at", span))
    until = F.col("at") + span + 1
    if thread:
        # the next post of the thread, at least as late; found within this range or the next one
        own = F.struct(F.lit(True).alias("own"), F.col("range").alias("range"))
        back = F.struct(F.lit(False).alias("own"), (F.col("range") - span).alias("range"))
        seen = posts.select(
            author, message, thread, "post", "at", F.inline(F.array(own, back).cast("array<struct<own:boolean,seen_range:bigint>>"))
        )
        group = [author, message, thread, "seen_range"]
        # a range is seen together with the next one, so it is two spans long
        hot = _HotRanges(seen, group, 2 * span, most)
        parts = hot.cut(seen, "at", "seen_range")
        if hot.found:
            # each cell is shown the first post of the next cell that has any
            starts = hot.cut(seen, "at", "seen_range", "inner").groupBy(*group, "cell").agg(F.min("at").alias("at"))
            shown = starts.withColumn("at", F.lead("at").over(Window.partitionBy(*group).orderBy("cell")))
            shown = shown.where(F.col("at").isNotNull()).withColumn("own", F.lit(False))
            parts = parts.unionByName(shown.withColumn("post", F.lit(None).cast(df.schema[key].dataType)))
        order = Window.partitionBy(*group, "cell").orderBy("at", "post")
        posts = (
            parts.withColumn("later", F.lead("at").over(order))
            .where("own")
            .withColumnRenamed("seen_range", "range")
            .drop("cell")
        )
        until = F.least(until, F.coalesce(F.col("later"), until))
    posts = posts.withColumn("until", until)
    start = F.struct(F.col("range").alias("r"), F.col("at").alias("t"), F.lit(1).cast("bigint").alias("d"), F.col("post").alias("p"))
    none = F.lit(None).cast(df.schema[key].dataType)
    edge = F.col("range") + span
    stop_here = F.when(
        F.col("until") < edge,
        F.struct(F.col("range").alias("r"), F.col("until").alias("t"), F.lit(-1).cast("bigint").alias("d"), none.alias("p")),
    )
    stop_next = F.when(
        F.col("until") > edge,
        F.struct(edge.alias("r"), F.col("until").alias("t"), F.lit(-1).cast("bigint").alias("d"), none.alias("p")),
    )
    steps = posts.select(author, message, F.inline(F.array_compact(F.array(start, stop_here, stop_next))))
    # posts carried over a range edge all start at that edge, so they travel as one count
    carried = (
        posts.where(F.col("until") > edge)
        .groupBy(author, message, edge.alias("r"))
        .agg(F.count("*").alias("d"))
        .select(author, message, "r", F.col("r").alias("t"), "d", none.alias("p"))
    )
    steps = steps.unionByName(carried)
    hot = _HotRanges(steps, [author, message, "r"], span, most)
    parts = hot.cut(steps, "t", "r")
    if hot.found:
        # what a cell starts from: the sum of the cells before it
        sums = hot.cut(steps, "t", "r", "inner").groupBy(author, message, "r", "cell").agg(F.sum("d").alias("d"))
        before = Window.partitionBy(author, message, "r").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        handed = sums.withColumn("d", F.sum("d").over(before)).where(F.col("d").isNotNull())
        parts = parts.unionByName(handed.withColumn("t", F.col("r")).withColumn("p", none))
    running = Window.partitionBy(author, message, "r", "cell").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    return (
        parts.withColumn(column, F.sum("d").over(running).cast("bigint"))
        .where(F.col("p").isNotNull())
        .select(F.col("p").alias(key), author, message, column)
    )


def copies_across(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Texts posted word for word in more than one source: (text_md5, n_posts, n_sources).

    Posts are first counted per (text, source), so a text with very many copies travels as one row
    per task and source.
    """
    per_source = df.groupBy(F.md5(F.col(text)).alias("text_md5"), source).agg(F.count("*").alias("n"))
    return (
        per_source.groupBy("text_md5")
        .agg(F.sum("n").alias("n_posts"), F.count("*").alias("n_sources"))
        .where(F.col("n_sources") > 1)
    )


CLASSES = 16  # words of 64 parity bits
LENGTH_BITS = 6  # of the length of an n-gram, above the bits of its hash
MARK_BITS = 44  # of an n-gram's hash that travel in the first filter, where equal marks only keep more texts


def _each_gram(words: int, value: Callable[[list[Column]], Column]) -> Column:
    """Distinct ``value`` of every n-gram of the words ``w``; fewer words are one."""

    def gram(i: Column) -> Column:
        return value([F.get("w", i + j) for j in range(words)])

    count = F.size("w") - words
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), gram))
    return F.when(count >= 0, some).otherwise(F.array(value([F.array_join("w", " ")])))


def _grams(words: int) -> Column:
    return _each_gram(words, lambda w: F.xxhash64(*w))


def _long_grams(words: int) -> Column:
    """Hashes of the n-grams, those with the most letters first: they are rarer, and no count is needed to order them."""
    bits = 63 - LENGTH_BITS

    def value(w: list[Column]) -> Column:
        length = F.least(reduce(lambda a, b: a + b, [F.length(x) for x in w]), F.lit((1 << LENGTH_BITS) - 1))
        return F.shiftleft(length.cast("bigint"), bits) + F.xxhash64(*w).bitwiseAND(F.lit((1 << bits) - 1))

    return F.sort_array(_each_gram(words, value), asc=False)


def _may_have_partner(texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """(m): the texts of ``texts`` (m, lo, hi, w) that some text of another source may be similar to.

    Of n n-grams a text can lack ``room`` = n - ceil(threshold n) in a partner.  Each text sends its 2 ``room`` + 1 longest ones, or
    all if it has fewer.  The same order holds for all texts, so two similar ones have at least as many of the sent ones in common
    as the shorter text sends beyond its ``room``; a partner has ceil(threshold n) n-grams at least, which bounds this from
    below.  A text with fewer sent ones that another source sent too has no partner.
    """

    def need(n: Column) -> Column:
        return F.ceil(threshold * n - 1e-9).cast("int")

    def beyond(n: Column) -> Column:
        return F.least(n - need(n) + 1, need(n))

    sets = texts.select("m", "lo", "hi", _long_grams(words).alias("g"))
    n = F.size("g")
    sent = F.slice("g", F.lit(1), n - need(n) + beyond(n))
    marks = sets.select("m", beyond(need(n)).alias("least"), "lo", "hi", F.explode(sent).alias("g"))
    marks = marks.withColumn("g", F.col("g").bitwiseAND(F.lit((1 << MARK_BITS) - 1)))
    of_gram = Window.partitionBy("g")
    seen = marks.select("m", "least", F.min("lo").over(of_gram).alias("lo"), F.max("hi").over(of_gram).alias("hi"), F.count("*").over(of_gram).alias("c"))
    shared = seen.where("c > 1 AND lo <> hi").groupBy("m").agg(F.count("*").alias("shared"), F.max("least").alias("least"))
    return shared.where("shared >= least").select("m")


def _likeness(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, j): exact Jaccard similarity of each pair; ``sets`` is (m, g). Only sets of pairs travel."""
    pairs = written(pairs, "gram-pairs")
    mine = join_small(sets.select(F.col("m").alias("x"), F.col("g").alias("gx")), pairs, "x", "inner", MAX_GRAMS)
    theirs = join_small(sets.select(F.col("m").alias("y"), F.col("g").alias("gy")), pairs.select("y").distinct(), "y", "left_semi", MAX_GRAMS)
    common = F.size(F.array_intersect("gx", "gy"))
    return mine.join(theirs, "y").select("x", "y", (common / (F.size("gx") + F.size("gy") - common)).alias("j"))


def similar_across(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", threshold: float = 0.8, words: int = 3
) -> DataFrame:
    """Posts that have an exact or near copy in another source: (key, likeness).

    ``likeness`` is the largest Jaccard similarity of word n-grams with a text of another source, computed
    exactly; exact copies have 1, texts without words and posts without source have none.  A key is one post.  Equal texts
    fold into the one with the smallest key first.

    Only n-grams that texts of two sources hold can be shared, and a text with fewer of them than ``threshold``
    of its n-grams has no partner.  Most such texts leave by their longest n-grams alone (``_may_have_partner``), so the whole
    sets of few texts are shuffled.  The others are indexed by their rarest such n-grams, as many as leave
    less than the threshold.  Each text first tries the richest text of another source in its lists.  What two texts can
    share at most follows from 64 ``CLASSES`` parity bits of such n-grams by hash: each bit that differs is one n-gram that is
    not common.  A pair becomes a row only if this bound is above the best that one of the two has found.  So a
    large group of near copies costs a few rows per copy, unless its members are nearer to each other than to the richest in ways the bound cannot tell.
    """
    posts = df.select(F.col(key).alias("key"), F.xxhash64(source).alias("s"), F.md5(F.col(text)).alias("m"), F.col(text).alias("t"))
    posts = posts.where(F.col(source).isNotNull() & F.col("t").rlike(r"[\p{L}\p{N}_]"))
    held = posts.groupBy("m").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.min("key").alias("lead"), F.count("*").alias("times"))
    twice = written(held.where("times > 1").select("m", "lo", "hi", "lead"), "equal-texts")
    # (key, lead): rows whose text has a row with a smaller key
    copies = written(join_small(posts.select("key", "m"), twice, "m").select("key", "m", "lead", "lo", "hi"), "copies")
    tokens = F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    marks = copies.where("key = lead").select("key", "lo", "hi").distinct()
    others = copies.where("key <> lead").select("key", "m").distinct()

    def worded(rows: DataFrame) -> DataFrame:
        leads = join_small(rows, others, ["key", "m"], "left_anti", MAX_COPIES)
        marked = join_small(leads.select("key", "s", "t"), marks, "key", "left", MAX_GRAMS)
        return marked.select(F.col("key").alias("m"), F.coalesce("lo", "s").alias("lo"), F.coalesce("hi", "s").alias("hi"), tokens.alias("w"))

    maybe = written(_may_have_partner(worded(spread(posts, "key")), words, threshold), "maybe-similar")
    sets = worded(join_small(posts, maybe.withColumnRenamed("m", "key"), "key", "left_semi", MAX_GRAMS))
    sets = written(sets.select("m", "lo", "hi", _grams(words).alias("g")), "gram-sets")
    of_gram = Window.partitionBy("g")
    each = sets.select("m", "lo", "hi", F.size("g").alias("n"), F.explode("g").alias("g"))
    known = each.select("*", F.min("lo").over(of_gram).alias("from"), F.max("hi").over(of_gram).alias("to"), F.count("*").over(of_gram).alias("c"))
    shared = known.where(F.col("c") > 1).where(F.col("from") != F.col("to"))

    need = F.ceil(threshold * F.col("n") - 1e-9)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright("g", CLASSES.bit_length() - 1), F.lit(64)).cast("int"))
    parity = [F.coalesce(F.bit_xor(F.when(F.pmod("g", F.lit(CLASSES)) == c, bit)), F.lit(0).cast("bigint")) for c in range(CLASSES)]
    listed = shared.groupBy("m", "lo", "hi", "n").agg(
        F.array_sort(F.collect_list(F.struct("c", "g"))).alias("by"), F.count("*").alias("total"), F.array(*parity).alias("bits")
    )
    room = (F.col("total") - need + 1).cast("int")
    able = listed.where(room > 0).select("m", "lo", "hi", "n", "total", "bits", F.slice("by", F.lit(1), room)["g"].alias("grams"))
    able = written(able, "able-texts")
    index = able.select("m", "lo", "hi", "n", "total", F.explode("grams").alias("g"))

    # the richest text of each list, and the richest of another source than that one
    rich = F.struct((F.col("total") / F.col("n")).alias("share"), "m", "lo", "hi")
    first = index.groupBy("g").agg(F.max(rich).alias("first"))
    told = index.join(first, "g").withColumn("apart", (F.col("lo") != F.col("first.lo")) | (F.col("hi") != F.col("first.hi")))
    second = told.where("apart").groupBy("g").agg(F.max(rich).alias("second"))
    tried = told.join(second, "g", "left").select("m", F.inline(F.array_compact(F.array("first", "second"))).alias("share", "y", "ylo", "yhi"), "lo", "hi")
    alone = (F.col("lo") == F.col("hi")) & ~((F.col("ylo") == F.col("lo")) & (F.col("yhi") == F.col("lo")))
    counted = tried.where(alone & (F.col("m") != F.col("y"))).groupBy("m", "y").agg(F.struct(F.count("*").alias("c"), F.max("share").alias("share"), "y").alias("best"))
    start = counted.groupBy("m").agg(F.max("best").alias("best")).select(F.least("m", "best.y").alias("x"), F.greatest("m", "best.y").alias("y"))
    seen = written(_likeness(start.distinct(), sets), "first-likeness")
    ends = seen.select(F.col("x").alias("m"), "j").union(seen.select("y", "j")).groupBy("m").agg(F.max("j").alias("best"))
    # a text of several sources has a copy already, and seeks none
    best = F.when(F.col("lo") != F.col("hi"), F.lit(1.0)).otherwise(F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(threshold) - 1e-6))
    full = able.join(ends, "m", "left").withColumn("best", best).select("m", "lo", "hi", "n", "total", "bits", "best", F.explode("grams").alias("g"))
    full = written(full, "gram-lists")

    sides = [full.select(*[F.col(c).alias(f"{c}_{e}") for c in full.columns]) for e in "xy"]
    other = (F.col("lo_x") != F.col("lo_y")) | (F.col("hi_x") != F.col("hi_y")) | (F.col("lo_x") != F.col("hi_x"))
    least = F.least("best_x", "best_y")
    # common / (n_x + n_y - common) > least, by more than rounding
    better = lambda common: common * (1 + least) > least * (F.col("n_x") + F.col("n_y")) + 1e-9
    # an odd number of n-grams of one text in a bit, and an even one of the other: at least one is not common
    apart = sum(F.bit_count(F.get("bits_x", F.lit(c)).bitwiseXOR(F.get("bits_y", F.lit(c)))) for c in range(CLASSES))
    most = (F.col("total_x") + F.col("total_y") - apart) / 2
    met = sides[0].join(
        sides[1],
        (F.col("g_x") == F.col("g_y")) & (F.col("m_x") < F.col("m_y")) & other & better(F.least("total_x", "total_y")) & better(most),
    )
    new = join_small(met.select(F.col("m_x").alias("x"), F.col("m_y").alias("y")).distinct(), seen.select("x", "y"), ["x", "y"], "left_anti", MAX_GRAMS)
    found = _likeness(new, sets).unionByName(seen)
    found = found.where(F.col("j") >= threshold)
    links = found.select(F.col("x").alias("m"), "j").union(found.select("y", "j")).groupBy("m").agg(F.max("j").alias("j"))
    copied = copies.where("key <> lead").join(links.withColumnRenamed("m", "lead"), "lead").select("key", "j")
    # a text of several sources has a copy in another one
    exact = copies.where("lo <> hi").select("key", F.lit(1.0).alias("j"))
    all_rows = links.withColumnRenamed("m", "key").unionByName(copied).unionByName(exact)
    return all_rows.groupBy("key").agg(F.max("j").alias("likeness")).select(F.col("key").alias(key), "likeness")
