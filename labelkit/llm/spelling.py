"""Words one edit apart, grouped under the most frequent spelling.

1. Occurrences are counted per batch in tasks, then summed.
2. A word is described by how many of its letters fall in each of ``GROUPS`` letter groups (code point modulo
   the number of groups).  One inserted, deleted or replaced letter adds at most one to the counts (surplus) and
   takes at most one away (deficit).
3. A trie over these vectors, one group per level, is cut at a depth that leaves few words below each
   node; such a subtree is a shard.  Every word goes to its own shard as an entry, and as a question to all
   shards whose upper levels are within the budget.  A shard that still has many words is dealt to
   several pieces, all of which are asked.
4. A task builds the subtree of one shard at a time and searches it depth first with what is left of the
   budget of one surplus and one deficit; words at the leaves reached are verified.  Each pair is found from
   one side: the shorter word asks for longer ones, and a surplus is spent before a deficit.
5. Every word has at most one form, with a larger count, so forms are trees and their roots come by pointer jumping.

Defined results: null or blank text has no words; rows without id count unchanged; repeated rows count as often
as they occur.  Empty tables give no words.  Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.llm.registry import query
from labelkit.operators.bounded import join_small
from labelkit.plans.registry import table
from labelkit.session import written

GROUPS = 8
SHARD = 20_000
"""Words of a shard beyond which it is cut at a deeper level, or into pieces at the last one."""
LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
FLUSH = 200_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")

Change = Callable[[object, str], str]


def word_counts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    letters: int = LEAST_LETTERS,
    change: Change | None = None,
) -> DataFrame:
    """(word, n): lower-cased (A-Z) runs of letters and how often they occur.  ``change`` maps (id, word) to another spelling."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                own = Counter(RUN.findall((value.as_py() or b"").lower().decode()))
                for word, n in own.items():
                    spelled = change(doc, word) if change else word
                    if len(spelled) >= letters:
                        total[spelled] += n
                if len(total) > FLUSH:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(word: str, groups: int = GROUPS) -> list[int]:
    counts = [0] * groups
    for c in word:
        counts[ord(c) % groups] += 1
    return counts


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from one word to the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def reachable(prefix: list[int]) -> Iterator[tuple[list[int], int]]:
    """Upper levels within the budget, with what is spent on them (see ``Subtrie.near``)."""
    yield prefix, 0
    for up in range(len(prefix)):
        more = [*prefix[:up], prefix[up] + 1, *prefix[up + 1 :]]
        yield more, 1
        for down in range(up + 1, len(prefix)):
            if more[down]:
                yield [*more[:down], more[down] - 1, *more[down + 1 :]], 2


class Subtrie:
    """Words below one node, by the successive counts of the levels beneath it.

    The words of a leaf, which are equally long, are kept by their first and by their last letters: a word
    of 2h or 2h + 1 letters has its first or its last h in common with any word one edit away that is not shorter.
    """

    def __init__(self, depth: int) -> None:
        self.root: dict = {}
        self.depth = depth

    def add(self, word: str, n: int) -> None:
        node = self.root
        for count in letter_counts(word)[self.depth :]:
            node = node.setdefault(count, {})
        for half in {len(word) // 2, (len(word) - 1) // 2}:
            node.setdefault(("first", word[:half]), []).append((word, n))
            node.setdefault(("last", word[len(word) - half :]), []).append((word, n))

    def near(self, word: str, spent: int) -> Iterator[tuple[str, int]]:
        """Words one edit away, depth first, each pair from one side only.

        A search spends nothing (0: a letter replaced within its group, asked by the smaller word), then one
        surplus (1: a letter more, asked by the shorter word), then one deficit at a later level (2: a letter
        replaced by one of an earlier group).
        """
        wanted = letter_counts(word)[self.depth :]
        half = len(word) // 2
        first, last = ("first", word[:half]), ("last", word[len(word) - half :])
        open_nodes = [(self.root, 0, spent)]
        while open_nodes:
            node, level, spent = open_nodes.pop()
            if level == len(wanted):
                for w, n in node.get(first, ()):
                    if one_edit(word, w) and (spent or w > word):
                        yield w, n
                for w, n in node.get(last, ()):
                    if w[:half] != first[1] and one_edit(word, w) and (spent or w > word):
                        yield w, n
                continue
            count = wanted[level]
            if (child := node.get(count)) is not None:
                open_nodes.append((child, level + 1, spent))
            if spent == 0 and (child := node.get(count + 1)) is not None:
                open_nodes.append((child, level + 1, 1))
            if spent == 1 and (child := node.get(count - 1)) is not None:
                open_nodes.append((child, level + 1, 2))


def _cut_depth(words: DataFrame, shard: int) -> tuple[int, DataFrame]:
    """The depth at which shards are cut, and (shard, pieces) of every shard."""
    for depth in range(1, GROUPS + 1):
        sizes = words.groupBy(F.array_join(F.slice("counts", 1, depth), ",").alias("shard")).agg(F.count("*").alias("size"))
        if depth == GROUPS or (sizes.agg(F.max("size")).first()[0] or 0) <= shard:
            break
    return depth, sizes.select("shard", F.ceil(F.col("size") / shard).cast("int").alias("pieces"))


def near_words(counts: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, near, near_n): every pair of words one edit apart, in both directions; ``counts`` is (word, n)."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [letter_counts(w) for w in batch.column("word").to_pylist()]
            yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array(vectors, pa.list_(pa.int32()))], ["word", "n", "counts"])

    words = written(counts.mapInArrow(described, "word string, n long, counts array<int>"), "spellings")
    depth, sizes = _cut_depth(words, shard)
    sizes = written(sizes, "spelling-shards")

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (",".join(map(str, to)), word, n, spent)
                for word, n, counts in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "counts")))
                for to, spent in reachable(counts[:depth])
            ]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "word", "n", "spent"])

    asked = join_small(words.mapInArrow(questions, "shard string, word string, n long, spent int"), sizes, "shard")
    asked = asked.select("shard", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("asks"), "word", "n", "spent")
    own = join_small(words.select(F.array_join(F.slice("counts", 1, depth), ",").alias("shard"), "word", "n"), sizes, "shard")
    entries = own.select("shard", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int").alias("piece"), F.lit(0).alias("asks"), "word", "n", F.lit(0).alias("spent"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie = None, Subtrie(depth)
        for batch in batches:
            found: list[tuple[str, str, int]] = []
            for shard, piece, asks, word, n, spent in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, piece) != at:
                    at, trie = (shard, piece), Subtrie(depth)
                if not asks:
                    trie.add(word, n)
                    continue
                for near, near_n in trie.near(word, spent):
                    found += [(word, near, near_n), (near, word, n)]
            columns = list(zip(*found)) or [()] * 3
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

    rows = entries.unionByName(asked).repartition("shard", "piece").sortWithinPartitions("shard", "piece", "asks")
    return rows.mapInArrow(search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by pointer jumping; ``forms`` is (word, form) without circles."""
    to = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if to.join(further, "root", "left_semi").isEmpty():
            return to
        to = written(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(counts: DataFrame, times: int = TIMES, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``counts`` (word, n)."""
    near = near_words(counts, shard).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    judged = counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.less")).alias("best_n"), F.col("best.near").alias("best")
    )
    has_form = F.col("best_n") >= times * F.col("n")
    judged = written(judged.select("word", "n", "n_near", F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _letter_lost(doc: object, word: str) -> str:
    """The misspelling that the query's contract fixes: one letter goes from one in 199 words of a document."""
    if doc is None:
        return word
    h = zlib.crc32(f"{doc}:{word}".encode())
    at = h % len(word)
    return word if h % 199 else word[:at] + word[at + 1 :]


@query()
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    counts = word_counts(table(spark, folder, "documents"), change=_letter_lost).where(F.col("n") >= LEAST_COUNT)
    return spelling_variants(written(counts, "word-counts"))
