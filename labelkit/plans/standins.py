"""Columns that give the driver tables the roles of the toolkit's inputs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.functions.binding import let
from labelkit.operators import audio
from labelkit.operators.bounded import local_table
from labelkit.operators.sft import to_triples
from labelkit.plans.registry import table

SEED = 42

# -- moderation category of a labelled document ------------------------------------------------

CATEGORIES = ["toxic", "junk", "safe"]


def category() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").otherwise("safe")


CATEGORY_SQL = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'junk' ELSE 'safe' END"


def categorised(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select("doc_id", category().alias("category"))


# -- language by frequent words ----------------------------------------------------------------

# Frequent words of four languages, most telling first.
FREQUENT_WORDS = {
    "en": ["the", "and", "of", "in", "that"],
    "fr": ["le", "la", "les", "des", "que", "un"],
    "de": ["der", "die", "und", "das", "ist"],
    "es": ["el", "los", "que", "en", "la"],
}


LANGUAGE_NAMES = list(FREQUENT_WORDS)
ALL_FREQUENT = sorted({w for words in FREQUENT_WORDS.values() for w in words})


def frequent_hits(text: str) -> Column:
    """The frequent words of any language in a text, repeats kept; the text is read once."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(ALL_FREQUENT))


def word_counts(hits: str | Column, words: int | None = None) -> Column:
    """Hits per language, of its first ``words`` words."""

    def count(chosen: list[str]) -> Column:
        return F.size(F.filter(hits, lambda w: w.isin(chosen)))

    return F.array(*[count(list_[:words]) for list_ in FREQUENT_WORDS.values()])


def language_of(counts: str | Column, nothing: str = "others") -> Column:
    """Language with most hits; list order wins ties, ``nothing`` if there is no hit."""
    top = F.array_max(counts)
    names = F.array(*[F.lit(name) for name in LANGUAGE_NAMES])
    return F.when(top > 0, F.element_at(names, F.array_position(counts, top).cast("int"))).otherwise(F.lit(nothing))


def predict_language(text: str, words: int | None = None, nothing: str = "others") -> Column:
    """The whole rule as one expression that reads the text once, also when a filter takes it over."""
    return let(frequent_hits(text), lambda hits: let(word_counts(hits, words), lambda n: language_of(n, nothing)))


def _word_count_sql(words: list[str]) -> str:
    return f"len(regexp_extract_all(w, ' ({'|'.join(words)}) '))"


def word_rule_sql(words: int | None = None, nothing: str = "others") -> str:
    n = {lang: _word_count_sql(list_[:words]) for lang, list_ in FREQUENT_WORDS.items()}
    top = f"greatest({', '.join(n.values())})"
    cases = " ".join(f"WHEN {c} = {top} THEN '{lang}'" for lang, c in n.items())
    return f"CASE WHEN {top} = 0 THEN '{nothing}' {cases} END"


SPACED_SQL = (
    "SELECT doc_id, lang, source, text, "
    r"' ' || regexp_replace(lower(text), '[^\p{L}]+', '  ', 'g') || ' ' AS w FROM documents"
)
PREDICTED_SQL = f"SELECT doc_id, lang, source, {word_rule_sql()} AS pred FROM ({SPACED_SQL})"


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return docs.select("doc_id", "lang", "source", predict_language("text").alias("pred"))


# -- logits and waveforms from embeddings ------------------------------------------------------

N_CLASSES = 64
OTHERS_INDEX = 9


def logits() -> Column:
    return F.slice("embedding", 1, N_CLASSES).cast("array<double>")


def class_names() -> Column:
    """Names in class order; the class at ``OTHERS_INDEX`` is "others"."""
    return F.array(*[F.lit("others" if i == OTHERS_INDEX else f"class_{i}") for i in range(N_CLASSES)])


LOGITS_SQL = "SELECT vec_id, label, embedding::DOUBLE[] AS z FROM embeddings"
WAVE_SQL = "SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings"


def checksum(arr: Column) -> Column:
    """Sum of value times position: changes when a value or its place does."""
    return F.round(
        F.aggregate(
            F.transform(arr.cast("array<double>"), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
        ),
        6,
    )


def checksum_sql(arr: str) -> str:
    return f"round(list_sum(list_transform({arr}, lambda x, i: x::DOUBLE * i)), 6)"


# -- noise ---------------------------------------------------------------------------------------


def _mixed_sql(rows: str, value: str) -> str:
    """``rows`` with ``value`` in column ``a``, sent through the mixing steps of the noise generator."""
    p, (m1, m2) = audio.NOISE_PRIME, audio.NOISE_MIX
    started = f"SELECT * EXCLUDE (a), ({value})::BIGINT AS a FROM ({rows})"
    once = f"SELECT * REPLACE (xor(a, a >> 15) * {m1} % {p} AS a) FROM ({started})"
    twice = f"SELECT * REPLACE (xor(a, a >> 13) * {m2} % {p} AS a) FROM ({once})"
    return f"SELECT * REPLACE (xor(a, a >> 16) AS a) FROM ({twice})"


def noise_sql(rows: str, key: str, n_samples: int, seed: int = SEED) -> str:
    """Columns of ``rows`` and ``noise``: the unit normal samples of each key."""
    p, step, knots = audio.NOISE_PRIME, audio.NOISE_STEP, audio.NOISE_KNOTS
    low = 31 - (knots.bit_length() - 1)
    made = _mixed_sql(f"SELECT *, 0 AS a FROM ({rows})", str(seed % p))
    made = _mixed_sql(made, f"(a + {key} // {p}) % {p}")
    made = _mixed_sql(made, f"(a + {key} % {p}) % {p}")
    made = _mixed_sql(f"SELECT *, a AS first_ FROM ({made})", f"(a + 1) % {p}")
    made = f"SELECT *, a AS second_, unnest(range({n_samples})) AS i_ FROM ({made})"
    made = _mixed_sql(made, f"(first_ + i_ * {step}) % {p}")
    made = _mixed_sql(made, f"(a + second_) % {p}")
    table = "[" + ", ".join(f"{q:.6f}" for q in audio.normal_table()) + "]::DOUBLE[]"
    knot = f"t[(a >> {low}) + 1]"
    drawn = (
        f"SELECT {key}, i_, {knot} + (t[(a >> {low}) + 2] - {knot}) * ((a & {(1 << low) - 1}) / {1 << low}::DOUBLE) AS z "
        f"FROM ({made}), (SELECT {table} AS t)"
    )
    return f"SELECT * FROM ({rows}) JOIN (SELECT {key}, list(z ORDER BY i_) AS noise FROM ({drawn}) GROUP BY {key}) USING ({key})"


# -- raw answers -------------------------------------------------------------------------------


def response() -> Column:
    pair = F.concat(
        F.lit("["), F.col("quality").cast("string"), F.lit(", "), F.col("toxic").cast("string"), F.lit("]@ confidence 90%")
    )
    return (
        F.when(F.col("doc_id") % 5 == 0, "all safe here").when(F.col("doc_id") % 5 == 1, "no label").otherwise(pair)
    )


RESPONSE_SQL = (
    "SELECT doc_id, quality, toxic, CASE WHEN doc_id % 5 = 0 THEN 'all safe here' WHEN doc_id % 5 = 1 THEN 'no label' "
    "ELSE '[' || quality || ', ' || toxic || ']@ confidence 90%' END AS response FROM labels"
)

# -- taxonomy over part types ------------------------------------------------------------------

PART_TAXONOMY = {"STANDARD": "A", "ECONOMY": "A", "MEDIUM": "B", "SMALL": "C"}
PART_CATEGORIES = ["A", "B", "C", "D"]
PART_SKIP = ["LARGE"]


def part_dim(spark: SparkSession) -> DataFrame:
    return local_table(
        spark, {"folder": PART_TAXONOMY.keys(), "category": PART_TAXONOMY.values()}, "folder string, category string"
    )


PART_DIM_SQL = "(VALUES " + ", ".join(f"('{f}', '{c}')" for f, c in PART_TAXONOMY.items()) + ") AS dim(p_type, category)"
MAPPED_SQL = f"SELECT p_partkey, p_type, category FROM part JOIN {PART_DIM_SQL} USING (p_type)"

# -- conversation triples ----------------------------------------------------------------------

TRIPLES_SQL = """
SELECT c.conv_id, c.turn, coalesce(s.system, '') AS system, c.text AS question, c.next_text AS response
FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations) c
LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id) s
  ON s.conv_id = c.conv_id
WHERE c.role = 'user' AND c.next_role = 'assistant'
"""


def triples(spark: SparkSession, folder: str) -> DataFrame:
    return to_triples(table(spark, folder, "conversations"))
