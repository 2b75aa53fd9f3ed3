"""Licence notices and identifier tags, with the expressions they hold evaluated.

An Aho-Corasick automaton over the words of a text finds notice phrases (every place); another finds
``SPDX-License-Identifier`` tags in the text itself.  The expression behind a tag is read by a
shunting-yard parser: ``with`` binds tighter than ``and``, that tighter than ``or``, brackets group.
It is evaluated twice: to the set of licences it names, and to the freedom it leaves, where ``or``
takes the freer side, ``and`` the stricter one, and ``with`` lifts a copyleft licence half way.

``score`` is the freedom of the strictest notice or tag in a text (1: permissive, 0: reserved or none).

Defined results: null text is empty; a tag whose expression does not parse gives the licences that can
be read from it and the freedom of the strictest; unknown licences weigh as reserved; repeated
documents are scanned one by one; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.llm.registry import query
from labelkit.llm.words import lower_words
from labelkit.plans.registry import table

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "mit license": "mit",
    "apache license version 2 0": "apache-2.0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0-1.0",
    "public domain": "public-domain",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "mozilla public license": "mpl",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
}
FREEDOM = (
    (("cc-by-nc", "cc-by-nd"), 0.2),
    (("cc-by-sa", "gpl", "agpl", "eupl"), 0.4),
    (("lgpl", "mpl", "epl", "cddl"), 0.6),
    (("mit", "apache", "bsd", "isc", "cc-by", "cc0", "public-domain", "unlicense", "zlib", "0bsd", "boost", "bsl"), 1.0),
)
TAG = "spdx-license-identifier:"
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_LEXEME = re.compile(r"[()]|[A-Za-z0-9.+:-]+")


def freedom(license: str) -> float:
    for prefixes, value in FREEDOM:
        if license.startswith(prefixes):
            return value
    return 0.0


def postfix(expression: str) -> list[str]:
    """Shunting-yard: operands in order, each operator after its two operands. Raises ValueError where that fails."""
    out, held, operand = [], [], True
    for token in _LEXEME.findall(expression.lower()):
        if token == "(":
            if not operand:
                raise ValueError("bracket after an operand")
            held.append(token)
        elif token == ")":
            if operand:
                raise ValueError("operand missing")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("bracket not opened")
            held.pop()
        elif token in PRECEDENCE:
            if operand:
                raise ValueError("operand missing")
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            if not operand:
                raise ValueError("operator missing")
            out.append(token)
            operand = False
    if operand or "(" in held:
        raise ValueError("not closed")
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """Licences named, and the freedom left."""
    try:
        order = postfix(expression)
    except ValueError:
        named = {t for t in _LEXEME.findall(expression.lower()) if t not in PRECEDENCE and t not in "()"}
        return named, min(map(freedom, named), default=0.0)
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token not in PRECEDENCE:
            stack.append(({token}, freedom(token)))
            continue
        (right, right_free), (left, left_free) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, left_free if left_free in (0.0, 1.0) else (1 + left_free) / 2))
        else:
            stack.append((left | right, max(left_free, right_free) if token == "or" else min(left_free, right_free)))
    return stack[0]


def leading_expression(line: str) -> str:
    """The longest start of a line that reads as an expression: operands joined by operators, brackets balanced."""
    taken, depth, operand = [], 0, True
    for m in _LEXEME.finditer(line):
        token = m.group().lower()
        if token == ")" and depth == 0 or not operand and token not in PRECEDENCE and token != ")":
            break
        depth += (token == "(") - (token == ")")
        operand = token in PRECEDENCE or token == "("
        taken.append(m.group())
    return " ".join(taken)


class Scanner:
    def __init__(self) -> None:
        self.phrases = ahocorasick.Automaton()
        for phrase, label in {**NOTICES, **BASE}.items():
            self.phrases.add_word(f" {phrase} ", (phrase, label))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        self.tags.add_word(TAG, len(TAG))
        self.tags.make_automaton()

    def scan(self, text: str) -> tuple[int, list[int], set[str], set[str], float | None]:
        """Words, word places of base phrases, base labels, all labels, freedom of the strictest."""
        words = lower_words(text.encode("utf-8", "surrogatepass"))
        line = " " + b" ".join(words).decode("utf-8", "replace") + " "
        places, base, labels, free = [], set(), set(), []
        done, count = 0, 0
        for end, (phrase, label) in self.phrases.iter(line):
            start = end - len(phrase) - 1
            if phrase in BASE:
                if start < done:
                    done, count = 0, 0
                count += line.count(" ", done, start)
                done = start
                places.append(count)
                base.add(label)
            labels.add(label)
            free.append(freedom(label))
        lowered = text.lower()
        for end, _ in self.tags.iter(lowered):
            stop = lowered.find("\n", end)
            found, value = evaluate(leading_expression(lowered[end + 1 : stop if stop >= 0 else len(lowered)]))
            if found:
                labels |= found
                free.append(value)
        return len(words), places, base, labels, min(free) if free else None


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_SCANNER: list[Scanner] = []


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and what was found in each whole text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in batches:
            rows = []
            for value in batch.column("text").to_pylist():
                n, places, base, labels, free = _SCANNER[0].scan(value or "")
                rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), free or 0.0))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.record_batch([batch.column("key"), *columns], ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


@query()
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
