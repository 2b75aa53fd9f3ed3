"""Secrets in texts: known shapes, and strings that look random.

Known shapes (assignments, access keys, hex runs) are patterns.  Beyond them, two character Markov
models of order one are trained, of random strings and of ordinary identifiers; a run of key
characters is a secret where the mean log-likelihood ratio per character favours random clearly.
The random model learns from the values of known shapes (the labelled samples), the ordinary one
from words around them, both from a bounded, seeded sample of documents.

Defined results: null text is empty; without labelled samples of both kinds no run is added; spans are
code points, end exclusive; a run inside a known span is not added again; repeated documents are
scanned one by one; very long runs are scored whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.functions.hashing import hash_order
from labelkit.llm.registry import query
from labelkit.plans.registry import table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # as AKIA[A-Z0-9]+ of 16 characters or more: a run is taken whole
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_RATIO = 1.0
"""Mean log-likelihood ratio (nats per character) from which a run counts as random."""
SAMPLE_DOCS = 4000
"""Documents with known secrets, and as many others, that the models learn from."""
MIN_SAMPLES = 20
BACKOFF = 5.0
"""Weight of single-character frequencies in the transition probabilities."""
_CODES = np.full(128, 64, np.int64)
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    _CODES[ord(_c)] = _i
STATES = 65


def known(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the known shapes."""
    found = []
    if "=" in text or ":" in text:
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text)]
    return found + [(2, *m.span()) for m in HEX.finditer(text)]


def transitions(run: str) -> np.ndarray:
    codes = _CODES[np.frombuffer(run.encode("ascii"), np.uint8)]
    return codes[:-1] * STATES + codes[1:]


def samples(text: str) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers) that the known shapes label."""
    spans = known(text)
    values = [re.sub(r"^.*[:=\x20\"']", "", text[a:b], flags=re.S) for _, a, b in spans]
    plain, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans) + [(len(text), len(text))]:
        plain += re.findall(r"[A-Za-z_]{4,}", text[at:a]) if a > at else []
        at = max(at, b)
    return [v for v in values if len(v) >= 8], plain


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> np.ndarray | None:
    """Log-likelihood ratio of each character pair, random against ordinary; None without enough samples.

    Pair counts are summed by Spark; at most ``65 * 65`` of each kind reach the driver.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = t.rlike(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    rows = docs.select(F.col(f"`{key}`").alias("key"), t.alias("text"), marked.alias("marked"))
    picked = None
    for flag in (True, False):
        part = rows.where(F.col("marked") == flag).select("key", hash_order("secrets", "key").alias("o")).orderBy("o", "key").limit(sample_docs)
        picked = part if picked is None else picked.union(part)
    chosen = rows.join(F.broadcast(picked.select("key").distinct()), "key", "left_semi")  # at most 2 * sample_docs keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, strings = np.zeros((2, STATES * STATES), np.int64), [0, 0]
        for batch in batches:
            for value in batch.column("text").to_pylist():
                for kind, group in enumerate(samples(value)):
                    strings[kind] += len(group)
                    for s in group:
                        np.add.at(totals[kind], transitions(s), 1)
        kind, pair = np.nonzero(totals)
        yield pa.record_batch(
            [pa.array(np.append(kind, [0, 1])), pa.array(np.append(pair, [-1, -1])), pa.array(np.append(totals[kind, pair], strings))], ["kind", "pair", "n"]
        )

    counts = np.zeros((2, STATES * STATES))
    strings = [0, 0]
    for row in chosen.select("text").mapInArrow(run, "kind long, pair long, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        if row["pair"] < 0:
            strings[row["kind"]] = row["n"]
        else:
            counts[row["kind"], row["pair"]] = row["n"]
    if min(strings) < MIN_SAMPLES:
        return None
    logs = []
    for one in counts:
        square = one.reshape(STATES, STATES)
        alone = (square.sum(0) + 0.5) / (square.sum() + 0.5 * STATES)  # what follows where the character before was not seen
        logs.append(np.log((square + BACKOFF * alone) / (square.sum(1, keepdims=True) + BACKOFF)))
    return (logs[0] - logs[1]).ravel()


def random_runs(text: str, ratios: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if any(a < y and x < b for _, x, y in spans):
            continue
        run = m.group()
        if float(ratios[transitions(run)].mean()) >= LEAST_RATIO:
            out.append((a, b))
    return out


def _listed(spans: list[tuple[int, int, int]], names: tuple[str, ...]) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])))


def find_secrets(docs: DataFrame, ratios: np.ndarray | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per known kind, digest of the known spans, and all spans (kind ``random`` for the model's)."""
    kind_of = docs.schema[key].dataType.simpleString()
    names = (*KINDS, "random")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, listed = [[], [], []], [], []
            for value in batch.column("text").to_pylist():
                value = value or ""
                base = known(value)
                for k in range(3):
                    counts[k].append(sum(s[0] == k for s in base))
                every = base + ([(3, a, b) for a, b in random_runs(value, ratios, base)] if ratios is not None else [])
                digests.append(hashlib.sha256(_listed(base, names).encode()).hexdigest())
                listed.append(_listed(every, names))
            columns = [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(listed, pa.string())]
            yield pa.record_batch([batch.column("key"), *columns], ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"key {kind_of}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("key", key)


@query()
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return find_secrets(docs, train(docs))
