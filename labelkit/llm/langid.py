"""Language of texts: known words first, then ever shorter character n-grams.

Per language the model holds log frequencies of words and, for words it has not seen, of their
character n-grams.  A word of a text scores by its own frequencies; an unknown word by its longest
n-grams that the model knows, trying five characters down to one.  The language with the greatest sum
wins, ties go to the name that sorts first; ``score`` is its share after a softmax of mean scores.

Words are lower-cased runs of letters.  An unknown run of more than ``RUN`` letters, as in scripts
without blanks, is read to its end in slices of that size that overlap, each scored like a word, so no
n-gram is left out and a long run weighs more than a short one.  Word counts are summed by Spark over a
seeded sample of about ``sample_docs`` labelled documents of each language (all of a language that has
fewer); the model keeps the ``vocabulary`` most frequent words and n-grams of each length of each
language, so what is broadcast is bounded by the number of languages.

Defined results: null text or text without a letter is ``und`` with score 0; without any training row
everything is ``und``; rows with null language or null text do not train; repeated documents are
predicted one by one; extra columns do not matter.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.functions.hashing import unit_draw
from labelkit.llm.registry import query
from labelkit.operators.bounded import join_small, local_table
from labelkit.plans.registry import table
from labelkit.session import written

SAMPLE_DOCS = 8000
VOCABULARY = 60_000
LONGEST = 5
RUN = 64
STEP = RUN - LONGEST + 1  # every n-gram that starts in the first STEP letters of a slice ends in it
UNKNOWN = "und"
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def slices(run: str) -> list[str]:
    """A long run with its marks, in slices: the n-grams that start in their first STEP letters are all of the run's."""
    padded = f"^{run}$"
    return [padded[at : at + RUN] for at in range(0, len(padded), STEP)]


Counts = tuple[list[str], np.ndarray]
"""Units, and a row of counts per unit with a column per language."""


class Model:
    """Languages, a row of log frequencies per known word, and one per known n-gram."""

    def __init__(self, langs: list[str], counts: Counts, grams: list[Counts]) -> None:
        self.langs = langs
        self.words, self.word_logs = self._table([counts])
        self.grams, self.gram_logs = self._table(grams)
        self.cache: dict[str, np.ndarray] = {}

    def _table(self, tables: list[Counts]) -> tuple[dict[str, int], np.ndarray]:
        """Row number of each unit, and the rows; each table has its own totals."""
        names, logs = [], [np.empty((0, len(self.langs)))]
        for units, matrix in tables:
            names += units
            logs.append(np.log((matrix + 0.5) / (matrix.sum(0, keepdims=True) + 0.5 * max(1, len(units)))))
        return {name: i for i, name in enumerate(names)}, np.concatenate(logs)

    def of_word(self, word: str) -> np.ndarray | None:
        """Log frequencies of one word in each language; None where even its letters are unknown."""
        found = self.words.get(word)
        if found is not None:
            return self.word_logs[found]
        if word in self.cache:
            return self.cache[word]
        if len(self.cache) > 200_000:
            self.cache.clear()
        score = self._of_grams(f"^{word}$")
        self.cache[word] = score
        return score

    def _of_grams(self, padded: str) -> np.ndarray | None:
        for size in range(min(LONGEST, len(padded)), 0, -1):
            hits = [g for i in range(len(padded) - size + 1) if (g := self.grams.get(padded[i : i + size])) is not None]
            if hits:
                return self.gram_logs[hits].mean(0)
        return None

    def _scores(self, listed: list[str]) -> Iterator[np.ndarray | None]:
        for word in listed:
            if len(word) <= RUN or word in self.words:
                yield self.of_word(word)
            else:  # a last slice that lies within the one before has nothing new
                yield from (self._of_grams(s) for s in slices(word) if len(s) >= LONGEST)

    def predict(self, text: str | None) -> tuple[str, float]:
        listed = words(text) if text else []
        if not listed or not self.langs or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        scored = [s for s in self._scores(listed) if s is not None]
        if not scored:
            return self.langs[0], 1.0 / len(self.langs)
        mean = np.sum(scored, axis=0) / len(scored)
        best = int(mean.argmax())
        return self.langs[best], 1.0 / float(np.exp(np.minimum((mean - mean[best]) * min(len(scored), 50), 0)).sum())


def cut_off(levels: list[tuple[int, int]], limit: int) -> tuple[int, float]:
    """Frequency above which all units stay, given (frequency, units), and the share of the units at it for which there is room."""
    for n, units in sorted(levels, reverse=True):
        if units > limit:
            return n, limit / units
        limit -= units
    return 0, 0.0


def train(rows: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY) -> Model:
    """Model of the labelled ``rows``.  About ``vocabulary`` words of each language and as many n-grams per length reach the driver at most, with a count per language."""
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    shares = known.groupBy("lang").agg((F.lit(float(sample_docs)) / F.count("*")).alias("share"))
    drawn = unit_draw("langid", "sample", F.coalesce(F.col("key").cast("string"), F.lit("")), F.xxhash64("text")) < F.col("share")
    chosen = join_small(known, shares, "lang").where(drawn).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        totals: dict[str, Counter] = {}
        for batch in batches:
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                totals.setdefault(name, Counter()).update(words(value))
        for name, c in totals.items():
            rows = []
            for w, n in c.items():
                rows.append((name, w, None, n))
                if len(w) > RUN:
                    rows += [(name, None, s, n) for s in slices(w)]
                if len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = {"lang": pa.string(), "word": pa.string(), "slice": pa.string(), "n": pa.int64()}
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], list(types))

    # a row per word, and per slice of the words longer than RUN
    per_word = written(chosen.mapInArrow(counted, "lang string, word string, slice string, n long").groupBy("lang", "word", "slice").agg(F.sum("n").alias("n")), "langid-words")
    langs = sorted(r["lang"] for r in per_word.select("lang").distinct().collect())

    def top(counts: DataFrame) -> Counts:
        if not langs:
            return [], np.zeros((0, 0))
        counts = written(counts, "langid-units")
        levels = counts.groupBy("lang", "n").agg(F.count("*").alias("units")).collect()  # a row per language and frequency
        cuts = [cut_off([(r["n"], r["units"]) for r in levels if r["lang"] == name], vocabulary) for name in langs]
        floors = local_table(rows.sparkSession, {"lang": langs, "floor": [c[0] for c in cuts], "share": [c[1] for c in cuts]}, "lang string, floor long, share double")
        in_share = F.crc32(F.col("unit").cast("binary")) / F.lit(4294967296.0) < F.col("share")
        best = join_small(counts, floors, "lang").where((F.col("n") > F.col("floor")) | (F.col("n") == F.col("floor")) & in_share).select("unit").distinct()
        by = counts.join(best, "unit", "left_semi").groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))  # an entry per language
        row = F.transform(F.array(*map(F.lit, langs)), lambda name: F.coalesce(F.col("by")[name], F.lit(0).cast("bigint")))
        kept = by.select("unit", row.alias("row")).toArrow()  # not as rows, which take many times the memory
        return kept["unit"].to_pylist(), kept["row"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(langs))

    grams: list[Counts] = []
    padded = F.coalesce("slice", F.when(F.length("word") <= RUN, F.concat(F.lit("^"), "word", F.lit("$"))))
    starts = F.when(F.col("slice").isNotNull(), F.lit(STEP)).otherwise(F.length(padded))
    for size in range(1, LONGEST + 1):
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length(padded) - size + 1, starts), F.lit(1))), lambda i: F.substring(padded, i, F.lit(size)))  # noqa: B023
        units = per_word.select("lang", "n", F.explode(pieces).alias("unit")).where(F.length("unit") == size)
        grams.append(top(units.groupBy("unit", "lang").agg(F.sum("n").alias("n"))))
    return Model(langs, top(per_word.where("word IS NOT NULL").select("lang", F.col("word").alias("unit"), "n")), grams)


_LOADED: dict[bytes, Model] = {}


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; only the text is read by the model."""
    shared = docs.sparkSession.sparkContext.broadcast({"token": os.urandom(8), "model": model})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value["token"]
        if at not in _LOADED:
            _LOADED.clear()
            _LOADED[at] = shared.value["model"]
        for batch in batches:
            found = [_LOADED[at].predict(v) for v in batch.column(text).to_pylist()]
            kept = [c for c in batch.schema.names if c != text]
            yield pa.record_batch(
                [*[batch.column(c) for c in kept], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*kept, "lang_pred", "score"]
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    return docs.mapInArrow(run, ", ".join([*kept, "lang_pred string", "score double"]))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query()
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
