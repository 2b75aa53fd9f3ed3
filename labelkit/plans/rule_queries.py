"""Message rules and their streaming forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.operators import rules, scoring
from labelkit.plans.registry import query, table
from labelkit.session import shared_dir
from labelkit.streaming import jobs

# Wording that occurs in the driver's documents, in the place of the default rules.
DOCUMENT_RULES = [
    ("commercial", "hit", r"(?i)licen[cs]ed? under", 1.0),
    ("clickbait", "hit", r"\+\d[\d -]+", 0.75),
    ("referral", "hit", r"token = ", 0.5),
    ("bait", "hit", r"#{3}", 0.5),
    ("self_promotion", "hit", r"(?i)the for ", 0.25),
    ("free_event", "allow", r"(?i)version 3|nicht", 0.0),
    ("help_request", "allow", r"(?i)with the", 0.0),
]
HIT_RULES = [r for r in DOCUMENT_RULES if r[1] == "hit"]
EXCLUDED_SQL = " OR ".join(f"regexp_matches(text, '{p}')" for _, kind, p, _ in DOCUMENT_RULES if kind == "allow")
HITS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{r}' AS rule_id, {w}::DOUBLE AS weight, regexp_extract(text, '{p}') AS evidence, ({EXCLUDED_SQL}) AS excluded "
    f"FROM documents WHERE regexp_matches(text, '{p}')"
    for r, _, p, w in HIT_RULES
)


def _rules(spark: SparkSession) -> list[rules.Rule]:
    return rules.load_rules(rules.rules_table(spark, DOCUMENT_RULES))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, rule_id, evidence FROM ({HITS_SQL})")
def rule_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return rules.pattern_hits(_docs(spark, folder), _rules(spark), "doc_id")


@query(f"SELECT DISTINCT doc_id FROM ({HITS_SQL}) WHERE NOT excluded")
def rule_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a hit that no exclusion covers."""
    kept = rules.without_excluded(_docs(spark, folder), _rules(spark))
    hits = rules.rule_hits([r for r in _rules(spark) if r.kind == "hit"], "text")
    return kept.where(F.size(hits) > 0).select("doc_id")


@query(
    f"""
WITH h AS (SELECT * FROM ({HITS_SQL}) WHERE NOT excluded),
s AS (SELECT doc_id, sum(weight) AS score, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(score, 0)::DOUBLE AS score, coalesce(rule_ids, '') AS rule_ids, coalesce(score, 0) >= 1 AS is_spam
FROM documents d LEFT JOIN s USING (doc_id)
"""
)
def rule_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, rule list and verdict of every document."""
    judged = rules.verdicts(_docs(spark, folder), _rules(spark), "doc_id")
    return judged.withColumn("rule_ids", F.array_join("rule_ids", ","))


@query(
    """
SELECT event_id, user_id, event_type, count(*) OVER (
         PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_recent
FROM events
"""
)
def rule_repeat_hour(spark: SparkSession, folder: str) -> DataFrame:
    """How often the author sent this message in the last hour."""
    events = table(spark, folder, "events")
    return rules.repeats_within(events, "user_id", "event_type", "ts", "event_id")


@query(
    """
SELECT event_id, user_id, event_type, count(DISTINCT thread) OVER (
         PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS n_threads
FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT % 4 AS thread FROM events)
"""
)
def rule_repeat_threads(spark: SparkSession, folder: str) -> DataFrame:
    """In how many threads the author sent this message in the last twelve hours."""
    thread = F.get_json_object("props", "$.k").cast("bigint") % 4
    events = table(spark, folder, "events").withColumn("thread", thread)
    return rules.repeats_within(
        events, "user_id", "event_type", "ts", "event_id", 12 * 3600, "thread", "n_threads"
    )


@query(
    """
SELECT md5(text) AS text_md5, count(*) AS n_posts, count(DISTINCT source) AS n_sources FROM documents
GROUP BY text HAVING count(DISTINCT source) > 1
"""
)
def dup_exact_across(spark: SparkSession, folder: str) -> DataFrame:
    """Texts found word for word in several sources."""
    return rules.copies_across(table(spark, folder, "documents"))


@query(
    r"""
WITH t AS (SELECT DISTINCT text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT DISTINCT text, array_to_string(w[p : p + least(len(w), 3) - 1], ' ') AS g
      FROM (SELECT text, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM t WHERE len(w) > 0)),
n AS (SELECT text, count(*) AS n FROM g GROUP BY text),
c AS (SELECT a.text AS x, b.text AS y, count(*) AS c FROM g a JOIN g b USING (g) GROUP BY ALL),
j AS (SELECT x, y, CASE WHEN x = y THEN 1.0::DOUBLE ELSE c / (nx.n + ny.n - c)::DOUBLE END AS j
      FROM c JOIN n nx ON nx.text = x JOIN n ny ON ny.text = y),
s AS (SELECT DISTINCT text, source FROM documents)
SELECT d.doc_id, max(j) AS likeness FROM documents d JOIN j ON d.text = x JOIN s ON s.text = y AND s.source <> d.source
WHERE j >= 0.8 GROUP BY d.doc_id
"""
)
def dup_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an exact or near copy in another source."""
    return rules.similar_across(table(spark, folder, "documents").select("doc_id", "source", "text"))


@query(
    """
SELECT o_custkey, count(*) AS n_posts FROM orders GROUP BY o_custkey
HAVING count(*) >= 2 AND count(*) FILTER (WHERE o_orderstatus = 'F') = count(*)
"""
)
def rule_only_x_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of two or more orders that all have status F."""
    return rules.always_authors(table(spark, folder, "orders"), "o_custkey", F.col("o_orderstatus") == "F")


PAGE_LINK = "<a [^>]*>[^<]*</a>"


@query(
    rf"""
WITH c AS (SELECT page_id, len(regexp_extract_all(html, '{PAGE_LINK}')) AS n_links,
                  len(regexp_extract_all(regexp_replace(html, '{PAGE_LINK}', ' ', 'g'), '\w+')) AS n_words FROM pages)
SELECT page_id, n_links::INTEGER AS n_links, n_words::INTEGER AS n_words, n_links > 0 AND n_words < 300 AS bare FROM c
"""
)
def rule_link_density(spark: SparkSession, folder: str) -> DataFrame:
    """Links of each page, words outside them, and whether there is too little text around."""
    return table(spark, folder, "pages").select(
        "page_id",
        rules.link_count("html", PAGE_LINK).alias("n_links"),
        rules.words_outside_links("html", PAGE_LINK).alias("n_words"),
        rules.bare_links("html", 300, PAGE_LINK).alias("bare"),
    )


@query(
    r"""
SELECT doc_id, len(list_distinct(regexp_extract_all(text, '(^|[^\w.])@(\w+)', 2)))::INTEGER AS n_mentions,
       len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+'))::INTEGER AS n_emails,
       len(list_distinct(regexp_extract_all(text, '(^|[^\w.])@(\w+)', 2))) >= 10
       OR regexp_matches(text, '(^|[^\w.])@(everyone|here)([^\w]|$)') AS is_mass
FROM documents
"""
)
def rule_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Tags and e-mail addresses, which are not tags."""
    return _docs(spark, folder).select(
        "doc_id",
        F.size(rules.mentions("text")).alias("n_mentions"),
        rules.email_count("text").alias("n_emails"),
        rules.mass_mention("text").alias("is_mass"),
    )


PROMO = r"#|\$|token"


@query(
    rf"""
WITH lexicon AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{10,}}')) AS word FROM benchmark),
promo AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '{PROMO}')),
words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS word FROM promo)
SELECT doc_id FROM promo WHERE doc_id NOT IN (SELECT doc_id FROM words JOIN lexicon USING (word))
"""
)
def rule_offtopic(spark: SparkSession, folder: str) -> DataFrame:
    """Promotional documents without a long word of the benchmark, which plays the topic lexicon."""
    bench = table(spark, folder, "benchmark")
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{10,}"), F.lit(0))
    lexicon = bench.select(F.explode(found).alias("word"))
    return rules.off_topic(_docs(spark, folder), F.col("text").rlike(PROMO), lexicon, "doc_id")


# -- streams -----------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, folder: str, closing: str | None = None) -> DataFrame:
    return jobs.read_files(spark, f"{folder.rstrip('/')}/events.parquet", table(spark, folder, "events").schema, closing)


def _closed(spark: SparkSession, folder: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The job's whole result over the table as a bounded stream."""
    closing = shared_dir(spark, "closing")
    return jobs.run_available(job(_event_stream(spark, folder, closing)), "append", closing=closing)


def _ntz(*names: str) -> list[Column]:
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


@query(
    """
WITH w AS (SELECT user_id, event_type, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(10 * k) AS start
           FROM events, range(6) AS r(k)),
n AS (SELECT user_id, md5(event_type) AS message_key, start, start + INTERVAL 1 HOUR AS "end", count(*) AS n FROM w GROUP BY ALL)
SELECT * FROM n WHERE n >= 2
"""
)
def stream_repeat_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Repeats in sliding hours."""
    done = _closed(spark, folder, lambda df: jobs.repeats_sliding(df, "user_id", "event_type", "ts"))
    return done.select("user_id", "message_key", *_ntz("start", "end"), "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Live label counts per hour."""
    done = _closed(spark, folder, lambda df: jobs.label_counts(df, "event_type", "ts"))
    return done.select(*_ntz("start"), "event_type", "n")


@query(
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new_one
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new_one) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, sid
"""
)
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of an author's posts."""
    done = _closed(spark, folder, lambda df: jobs.bursts(df, "user_id", "ts"))
    return done.select("user_id", *_ntz("start", "end"), "n")


@query(
    """
SELECT user_id::VARCHAR AS author, event_id AS post,
       coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 1 HOUR, false) AS is_repeat
FROM events
"""
)
def stream_repeat_state(spark: SparkSession, folder: str) -> DataFrame:
    """First posts and repeats within the hour, with keyed state."""
    done = _closed(spark, folder, lambda df: jobs.first_and_repeats(df, "user_id", "event_type", "ts", "event_id"))
    return done.select("author", "post", "is_repeat")


@query(
    """
SELECT event_id, round(value * 0.1 + 0.5, 6) AS score, event_type IN ('error', 'purchase') AS flagged FROM events
"""
)
def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    """Model score and rule check of every message of a stream."""
    base = shared_dir(spark, "scored")
    flags = rules.load_rules(rules.rules_table(spark, [("kind", "hit", "^(error|purchase)$", 1.0)]))

    def factory():
        return lambda batch: batch[["value"]].rename(columns={"value": "score"}) * 0.1 + 0.5

    def steps(batch: DataFrame) -> DataFrame:
        scored = scoring.score(batch.select("event_id", "event_type", "value"), factory, "score double")
        return scored.select(
            "event_id",
            F.round("score", 6).alias("score"),
            (F.size(rules.rule_hits(flags, "event_type")) > 0).alias("flagged"),
        )

    jobs.score_stream(_event_stream(spark, folder), steps, f"{base}/data", f"{base}/checkpoint").trigger(
        availableNow=True
    ).start().awaitTermination()
    schema = "event_id bigint, score double, flagged boolean"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/data")
