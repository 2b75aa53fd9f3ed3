from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from labelkit.operators import rules as r

T0 = datetime.datetime(2024, 1, 1, 10, 0, 0)


@pytest.fixture(scope="module")
def default_rules(spark):
    return r.load_rules(r.rules_table(spark))


HITS = {
    "commercial": ("every VOUCHER works until Sunday", "the price tag fell off the shelf"),
    "clickbait": ("this one trick saves your lawn", "a magician showed us a trick"),
    "referral": ("refer a friend and both are happy", "my friend referred to the manual"),
    "bait": ("tag five friends below", "five friends came along"),
    "self_promotion": ("read my newsletter tonight", "the newsletter was late"),
}
ALLOWED = {
    "item_talk": "smelting ore all day, then voucher hunting",
    "team_up": "two slots open in our raid, tag three friends",
    "achievement": "new personal best, details on my blog",
    "help_request": "how do I fix the voucher screen?",
    "free_event": "charity cup on Friday with no entry fee, repost this",
    "context_share": "walkthrough of the swamp on my podcast",
}


def test_each_pattern_rule_hits_and_nearly_misses(spark, default_rules):
    rows = [(i, text) for i, text in enumerate(t for pair in HITS.values() for t in pair)]
    df = spark.createDataFrame(rows, "msg_id int, text string")
    got = {(x.msg_id, x.rule_id) for x in r.pattern_hits(df, default_rules).collect()}
    assert got == {(2 * i, name) for i, name in enumerate(HITS)}
    evidence = {x.rule_id: x.evidence for x in r.pattern_hits(df, default_rules).collect()}
    assert evidence["commercial"] == "VOUCHER"


def test_exclusions_clear_hits(spark, default_rules):
    df = spark.createDataFrame(list(enumerate(ALLOWED.values())) + [(99, HITS["bait"][0])], "msg_id int, text string")
    assert {x.msg_id for x in r.pattern_hits(df, default_rules).collect()} >= set(range(len(ALLOWED)))
    assert [x.msg_id for x in r.without_excluded(df, default_rules).collect()] == [99]
    verdicts = {x.msg_id: x for x in r.verdicts(df, default_rules).collect()}
    assert verdicts[99].is_spam and verdicts[99].rule_ids == ["bait"]
    assert not any(verdicts[i].is_spam or verdicts[i].rule_ids for i in range(len(ALLOWED)))


def test_verdict_sums_weights_and_takes_column_rules(spark, default_rules):
    text = "my blog: wholesale boxes, see https://x.example"
    df = spark.createDataFrame([(1, text), (2, None), (3, "my podcast")], "msg_id int, text string")
    extra = {"bare_link": (r.bare_links("text", 20), 0.25)}
    got = {x.msg_id: (x.score, x.rule_ids, x.is_spam) for x in r.verdicts(df, default_rules, extra=extra).collect()}
    assert got[1] == (1.75, ["bare_link", "commercial", "self_promotion"], True)
    assert got[2] == (0.0, [], False)
    assert got[3] == (0.5, ["self_promotion"], False)


def test_rule_tables_have_no_limit(spark):
    table = spark.range(1500).select(F.col("id").cast("string").alias("rule_id"), F.lit("hit").alias("kind"), F.lit("x").alias("pattern"), F.lit(1.0).alias("weight"))
    assert len(r.load_rules(table)) == 1500


@pytest.mark.parametrize(
    "text, links, words, bare",
    [
        ("see https://a.example/x?y=1 now", 1, 2, True),
        ("www.a.example and http://b.example", 2, 1, True),
        ("five words are enough here https://a.example", 1, 5, False),
        ("no link", 0, 2, False),
    ],
)
def test_links(one, text, links, words, bare):
    args = {"t": (text, "string")}
    assert one(r.link_count("t"), **args) == links
    assert one(r.words_outside_links("t"), **args) == words
    assert one(r.bare_links("t"), **args) is bare


TEN = " ".join(f"@user{i}" for i in range(10))


@pytest.mark.parametrize(
    "text, n, mass",
    [
        (TEN, 10, True),
        (TEN.replace("@user9", "@user8"), 9, False),
        ("hi @everyone!", 1, True),
        ("@here", 1, True),
        ("@hereafter", 1, False),
        ("mail me@here.example", 0, False),
        ("none", 0, False),
    ],
)
def test_mentions(one, text, n, mass):
    assert one(F.size(r.mentions("t")), t=(text, "string")) == n
    assert one(r.mass_mention("t"), t=(text, "string")) is mass


def test_email_count(one):
    assert one(r.email_count("t"), t=("a@b.example, c.d@e.example and @f", "string")) == 2
    assert one(r.email_count("t"), t=("nothing", "string")) == 0


def test_promotion_in_direct_messages(spark, default_rules):
    promo = HITS["commercial"][0]
    df = spark.createDataFrame([("dm", promo), ("forum", promo), ("dm", "hello")], "channel string, text string")
    assert [x.c for x in df.select(r.dm_promotion(default_rules).alias("c")).collect()] == [True, False, False]


def test_link_only_authors(spark):
    rows = [(1, "http://a.b"), (1, "http://c.d x"), (2, "http://a.b"), (2, "talk"), (3, "http://a.b"), (4, None), (4, "http://a.b")]
    df = spark.createDataFrame(rows, "author_id int, text string")
    got = r.always_authors(df, "author_id", r.link_count("text") > 0)
    assert [tuple(x) for x in got.collect()] == [(1, 2)]


def test_off_topic(spark):
    df = spark.createDataFrame([(1, "buy coins, great Ranked games"), (2, "buy crypto"), (3, "talk")], "msg_id int, text string")
    lexicon = spark.createDataFrame([("ranked",), ("boss",)], "word string")
    assert [x.msg_id for x in r.off_topic(df, F.col("text").contains("buy"), lexicon).collect()] == [2]


def _posts(spark, rows):
    made = [(i, a, m, T0 + datetime.timedelta(seconds=s), t) for i, (a, m, s, t) in enumerate(rows)]
    return spark.createDataFrame(made, "id bigint, author bigint, message string, ts timestamp, thread string")


def test_repeats_within_the_hour(spark):
    df = _posts(
        spark,
        [(1, "x", 0, "a"), (1, "x", 59 * 60, "b"), (1, "x", 3600, "a"), (1, "x", 3600 + 61 * 60, "c"), (1, "x", 3600 + 61 * 60, "c"), (2, "x", 0, "a"), (1, "y", 1, "a")],
    )
    got = {x.id: x.n_recent for x in r.repeats_within(df, "author", "message", "ts", "id").collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 2, 4: 2, 5: 1, 6: 1}


@pytest.mark.parametrize("seconds, most", [(60, 200_000), (3600, 200_000), (5000, 200_000), (3600, 20), (5000, 3)])
def test_repeats_equal_brute_force_on_a_hot_author(spark, seconds, most):
    import random

    rng = random.Random(seconds)
    rows = [(rng.choice([1, 1, 1, 2]), "m", rng.randrange(20000), rng.choice("abc")) for _ in range(400)]
    df = _posts(spark, rows)
    counts = {x.id: x.n_recent for x in r.repeats_within(df, "author", "message", "ts", "id", seconds, most=most).collect()}
    threads = {x.id: x.n for x in r.repeats_within(df, "author", "message", "ts", "id", seconds, "thread", "n", most).collect()}
    assert len(counts) == len(threads) == 400
    for i, (a, m, s, t) in enumerate(rows):
        near = [x for x in rows if x[0] == a and s - seconds <= x[2] <= s]
        assert counts[i] == len(near)
        assert threads[i] == len({x[3] for x in near})


@pytest.mark.parametrize("thread", [None, "thread"])
def test_one_author_in_one_hour_is_spread_over_tasks(spark, thread):
    """Half of the rows are one author's, of one message and one hour, most of them within a minute."""
    n = 40_000
    burst = F.when(F.col("id") % 4 == 0, F.col("id") * 80_000 % 3_600_000_000).otherwise(F.col("id") * 1_499)
    hot = F.col("id") % 2 == 0
    df = spark.range(n).select(
        "id",
        F.when(~hot, F.col("id")).alias("author"),  # the hot author is null
        F.lit("m").alias("message"),
        (F.col("id") % 3).cast("string").alias("thread"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.when(hot, burst).otherwise(F.col("id"))).alias("ts"),
    )
    plain = r.repeats_within(df, "author", "message", "ts", "id", thread=thread, column="n")
    cut = r.repeats_within(df, "author", "message", "ts", "id", thread=thread, column="n", most=2_000)
    assert sorted(plain.select("id", "n").collect()) == sorted(cut.select("id", "n").collect())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        cut = r.repeats_within(df, "author", "message", "ts", "id", thread=thread, column="n", most=2_000)
        tasks = cut.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows"), F.sum("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sum(t["rows"] for t in tasks) == n and max(t["rows"] for t in tasks) <= n / 10


def test_exact_copies(spark):
    rows = [("t", "a"), ("t", "b"), ("t", "b"), ("u", "a"), ("u", "a")]
    got = r.copies_across(spark.createDataFrame(rows, "text string, source string")).collect()
    assert [(x.n_posts, x.n_sources) for x in got] == [(3, 2)]


def _brute_force_likeness(rows, words=3):
    """Largest true Jaccard similarity with a post of another source."""
    import re

    def grams(text):
        w = re.findall(r"\w+", text.lower())
        return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = [(key, source, grams(text)) for key, text, source in rows]
    return {
        key: max((len(mine & x) / len(mine | x) for _, s, x in sets if s != source and mine and x), default=0.0) for key, source, mine in sets
    }


def test_similar_posts_equal_brute_force_over_all_pairs(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(40):  # hot group: copies with 0 to 9 words changed, spread over three sources
        words = list(base)
        for _ in range(i % 10):
            words[rng.randrange(60)] = word()
        rows.append((i, " ".join(words), f"s{i % 3}"))
    rows += [(100 + i, " ".join(word() for _ in range(60)), f"s{i % 3}") for i in range(20)]
    alone = " ".join(word() for _ in range(50))
    rows += [(300, alone, "s0"), (301, alone, "s0")]  # copies in one source only
    rows += [(400, "two words", "s0"), (401, "TWO  words", "s1"), (402, "", "s0")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = {k: v for k, v in _brute_force_likeness(rows).items() if v >= 0.8}
    found = {x.doc_id: x.likeness for x in r.similar_across(df).collect()}
    assert found == pytest.approx(want)
    assert found[0] == found[400] == found[401] == 1.0
    assert not {300, 301, 402} & set(found) and not any(100 <= k < 120 for k in found)
    assert len(found) > 10


def test_a_group_of_near_copies_costs_rows_in_proportion(spark, monkeypatch):
    rng = random.Random(2)
    origin = [f"w{k}" for k in range(150)]
    rows = [(0, "s0", " ".join(origin)), (1, "s1", " ".join(origin + ["end"]))]
    for k in range(2, 400):
        words = list(origin)
        for at in rng.sample(range(150), rng.choice((1, 2, 3))):
            words[at] = f"own{rng.randrange(10**9)}"
        rows.append((k, f"s{k % 5}", " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    seen = []
    likeness = r._likeness

    def counted(pairs, sets):
        seen.append(pairs.count())
        return likeness(pairs, sets)

    monkeypatch.setattr(r, "_likeness", counted)
    got = {row["doc_id"]: row["likeness"] for row in r.similar_across(docs).collect()}
    assert len(got) == len(rows) and sum(seen) < 20 * len(rows)
    grams = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, _, t in rows}
    for k, source, _ in rng.sample(rows, 25):
        best = max(len(grams[k] & grams[o]) / len(grams[k] | grams[o]) for o, s, _ in rows if s != source)
        assert abs(got[k] - best) < 1e-12


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_posts_of_all_lengths_near_the_threshold(spark, threshold):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9)))
    rows = []
    for n in [*range(1, 24), 31, 40, 57, 82, 102, 127]:
        origin = [word() for _ in range(n)]
        rows.append((len(rows), " ".join(origin), "s0"))
        for cut in (round(n * 0.8), n - 1, n - 2, n // 2 + 1):  # the whole of a shorter text is common
            rows.append((len(rows), " ".join(origin[: max(cut, 1)]), f"s{rng.randrange(3)}"))
        changed = [w if rng.random() < 0.95 else word() for w in origin]
        rows.append((len(rows), " ".join(changed + [word()]), f"s{rng.randrange(3)}"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {x.doc_id: x.likeness for x in r.similar_across(df, threshold=threshold).collect()}
    assert found == pytest.approx({k: v for k, v in _brute_force_likeness(rows).items() if v >= threshold - 1e-9})


def test_sets_of_texts_without_a_near_copy_are_not_carried(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(k, f"s{k % 3}", text()) for k in range(300)]
    rows += [(300 + k, f"s{(k + 1) % 3}", [*rows[k][2], "end"]) for k in range(10)]
    docs = spark.createDataFrame([(k, s, " ".join(t)) for k, s, t in rows], "doc_id long, source string, text string")
    carried = []
    likeness = r._likeness

    def counted(pairs, sets):
        carried.append(sets.count())
        return likeness(pairs, sets)

    monkeypatch.setattr(r, "_likeness", counted)
    assert {row["doc_id"] for row in r.similar_across(docs).collect()} == {*range(10), *range(300, 310)}
    assert carried and max(carried) == 20
