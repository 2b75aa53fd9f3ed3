"""WARC archives written and read back by Spark, records found by boundary-chain verification.

Writing: a row is a record, and the text sink ends each row with the two line breaks that end a record,
so every task writes an archive of its own.  Of equal payloads of ``min_bytes`` or more, the one with
the smallest id is a response and the others are revisits that refer to it, without payload.

Reading: archives are split at every ``WARC/1.0`` line wherever it stands, also inside payloads, so large
files are read by many tasks.  Each piece is a candidate record with a successor: its own place plus
what its header says.  A task follows its candidates to where each chain leaves the split; pointer
jumping over splits then tells, from the start of each file, the entry of every split, and a second
local walk gives out the records that are reachable.  A marker inside a payload is never reached; the
pieces behind it are joined to the record they belong to.  Payloads are not shuffled, but for records
that hold a marker and cross a split.

Defined results: a null payload is empty; a null id gives a record without id, always a response, never
referred to; repeated rows are written as often as they occur, those with the smallest id all as
responses; characters that would break a header are percent-encoded; a file that stops inside a record
loses that record only; an empty table gives empty archives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labelkit.llm.registry import query
from labelkit.operators.bounded import is_small, join_small
from labelkit.plans.registry import table
from labelkit.session import shared_dir, written

MIN_BYTES = 100
MAX_SPLITS = 200_000
"""Largest number of splits whose entries are broadcast."""
BREAK = "\r\n"
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"


def _header(fields: dict[str, Column]) -> Column:
    return F.concat(*[F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)) for name, value in fields.items()])


def records(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """(record): each row as the text of a WARC record, without the two line breaks at its end."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    rows = rows.select("*", F.octet_length("body").cast("long").alias("size"), F.sha2(F.col("body").cast("binary"), 256).alias("digest"))
    shared = (
        rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    )
    known = join_small(rows, written(shared, "payloads"), "digest", "left")
    revisit = F.coalesce((F.col("id") > F.col("first")) & (F.col("size") >= min_bytes), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    http = _header({"Content-Type": F.lit("text/html; charset=utf-8"), "Content-Length": F.col("size").cast("string")})
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), http, F.lit(BREAK), F.when(revisit, F.lit("")).otherwise(F.col("body")))
    head = F.concat(
        F.lit(MAGIC),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(BREAK)),
        F.when(F.col("id").isNotNull(), F.concat(F.lit("WARC-Record-ID: "), name(F.col("id")), F.lit(BREAK))).otherwise(F.lit("")),
        F.when(clean != "", F.concat(F.lit("WARC-Target-URI: "), clean, F.lit(BREAK))).otherwise(F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit(BREAK), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        _header({"WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest")), "Content-Type": F.lit("application/http; msgtype=response")}),
    )
    return known.select(head.alias("head"), block.alias("block")).select(
        F.concat("head", _header({"Content-Length": F.octet_length("block").cast("string")}), F.lit(BREAK), "block").alias("record")
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> None:
    records(pages, key, url, payload, min_bytes).write.mode("overwrite").option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, piece): what stands between markers, in file order within a task."""
    return (
        spark.read.option("lineSep", MAGIC).text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    )


def _successor(piece: bytes) -> int | None:
    """Bytes from a marker to the next record by the header that follows the marker; None without a valid header."""
    stop = piece.find(b"\r\n\r\n")
    if stop < 0:
        return None
    for line in piece[:stop].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return len(MAGIC) + stop + 4 + int(value.strip()) + len(END)
    return None


def _offset_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, place, piece): place counts from the first marker-ended piece of the split."""
    at, last = 0, None
    for batch in batches:
        for file, block, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "piece"))):
            if (file, block) != last:
                at, last = 0, (file, block)
            yield file, block, at, piece
            at += len(piece) + len(MAGIC)


def _candidates(pieces: DataFrame) -> DataFrame:
    """(file, block, place, successor, bytes) for every piece; places and successors count from the split's first piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = ["file", "block", "place", "successor", "bytes"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
            rows.clear()
            return out

        for file, block, at, piece in _offset_pieces(batches):
            step = _successor(piece)
            # the marker stands before the piece, so a record starts len(MAGIC) earlier
            rows.append((file, block, at, None if step is None else at + step, len(piece) + len(MAGIC)))
            if len(rows) >= 10_000:
                yield flush()
        if rows:
            yield flush()

    return pieces.mapInArrow(run, "file string, block long, place long, successor long, bytes long")


def entries(candidates: DataFrame) -> DataFrame:
    """(file, block, base, entry): where each split begins in its file, and the place of its first reachable record (null without one)."""
    splits = candidates.groupBy("file", "block").agg(F.sum("bytes").alias("bytes"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    based = splits.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), "bytes")
    placed = written(
        candidates.drop("bytes").join(based, ["file", "block"]).select(
            "file", "block", "place", (F.col("place") + F.col("base")).alias("start"), (F.col("successor") + F.col("base")).alias("next"), (F.col("base") + F.col("bytes")).alias("until")
        ),
        "warc-candidates",
    )

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the chain of each candidate leaves its split; candidates of a split stand together in ascending order."""
        for table_ in _by_split(batches):
            file, starts, nexts, until = table_
            out: dict[int, int | None] = {}
            for s, n in zip(reversed(starts), reversed(nexts)):
                out[s] = n if n is None or n >= until else out.get(n)
            kept = [(s, e) for s, e in out.items() if e is not None]
            yield pa.record_batch([pa.array([file] * len(kept), pa.string()), pa.array([s for s, _ in kept], pa.int64()), pa.array([e for _, e in kept], pa.int64())], ["file", "at", "to"])

    together = placed.select("file", "block", "start", "next", "until").repartition("file", "block").sortWithinPartitions("file", "block", "start")
    jump = written(together.mapInArrow(exits, "file string, at long, to long"), "warc-jumps")
    # a file begins with an empty piece before its first marker; its first record is the second piece
    seen = placed.where("place > 0 OR block > 0").groupBy("file").agg(F.min("start").alias("at"))
    seen = written(seen, "warc-entries")
    count = seen.count()
    while True:  # doubling: what is reached grows by the jumps so far, then jumps are joined with themselves
        step = seen.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        grown = written(seen.union(step).distinct(), "warc-entries")
        total = grown.count()
        if total == count:
            break
        seen, count = grown, total
        hop = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = written(jump.join(hop, ["file", "to"], "left").select("file", "at", F.coalesce("then", "to").alias("to")), "warc-jumps")

    first = placed.join(grown.select("file", F.col("at").alias("start")), ["file", "start"]).groupBy("file", "block").agg(F.min("place").alias("entry"))
    return based.select("file", "block", "base").join(first, ["file", "block"], "left")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of each (file, block) together: file, starts, successors, end of the split."""
    key, starts, nexts, until = None, [], [], 0
    for batch in batches:
        for file, block, s, n, u in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "start", "next", "until"))):
            if (file, block) != key:
                if key is not None:
                    yield key[0], starts, nexts, until
                key, starts, nexts = (file, block), [], []
            starts.append(s)
            nexts.append(n)
            until = u
    if key is not None:
        yield key[0], starts, nexts, until


def _assembled(batches: Iterator[pa.RecordBatch], limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """(file, start, head, whole, piece): records that end in their split, glued, and the pieces of those that do not.

    Rows come in file order with ``base`` and ``entry`` of their split.  From the entry on, each record's
    header tells where the next one starts; what stands in between is part of it.
    """
    names, types = ["file", "start", "head", "whole", "piece"], [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    out: list[tuple] = []
    volume = 0
    key, held, expected, end = None, [], None, 0

    def close(reached: bool) -> None:
        """Give out what is held: glued if the record is known to end here, else piece by piece."""
        nonlocal volume
        if held:
            if reached:
                out.append((key[0], held[0][0], True, True, MAGIC.encode().join(h[2] for h in held)))
            else:
                out.extend((key[0], start, head, False, piece) for start, head, piece in held)
            volume += sum(len(h[2]) for h in held)
            held.clear()

    for batch in batches:
        for file, block, at, piece, base, entry in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "place", "piece", "base", "entry"))):
            if (file, block) != key:
                close(expected is not None and expected == end)
                key, expected = (file, block), entry
                inside = False
            if expected is not None and at == expected:
                close(inside)
                step = _successor(piece)
                expected, inside = None if step is None else at + step, True
                held.append((base + at, True, piece))
            elif at > 0 or block > 0:
                if not inside:
                    close(False)
                held.append((base + at, False, piece))
            end = at + len(piece) + len(MAGIC)
            if volume >= limit:
                yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
                out.clear()
                volume = 0
    close(expected is not None and expected == end)
    if out:
        yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(header map, payload binary, start, file) of every record in the archives below ``path``."""
    pieces = _pieces(spark, path)
    splits = written(entries(_candidates(pieces)), "warc-splits")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rebatched(_offset_pieces(batches))

    parts = pieces.mapInArrow(placed, "file string, block long, place long, piece binary")
    if is_small(splits, MAX_SPLITS):
        known = parts.join(F.broadcast(splits), ["file", "block"])  # rows keep their order
    else:
        known = parts.join(splits, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "place")
    rows = known.mapInArrow(_assembled, "file string, start long, head boolean, whole boolean, piece binary")
    # records cut by the end of a split: few, and only those that hold a marker or end a file early
    owner = F.max(F.when(F.col("head"), F.col("start"))).over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, 0))
    cut = rows.where("NOT whole").select("file", "start", "piece", owner.alias("owner")).where("owner IS NOT NULL")
    joined = cut.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))
    glued = joined.select("file", "owner", F.aggregate("p", F.lit(b""), lambda s, x: F.when(F.length(s) == 0, x.piece).otherwise(F.concat(s, F.lit(MAGIC.encode()), x.piece))).alias("piece"))
    single = rows.where("whole").select("file", F.col("start").alias("owner"), "piece")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers, payloads, there = [], [], []
            for piece in batch.column("piece").to_pylist():
                stop = piece.find(b"\r\n\r\n")
                header = {}
                for line in piece[:stop].decode("utf-8", "replace").split(BREAK):
                    name, _, value = line.partition(":")
                    header[name.strip()] = value.strip()
                size = int(header.get("Content-Length", 0))
                block = piece[stop + 4 : stop + 4 + size]
                there.append(len(block) == size)
                cut = block.find(b"\r\n\r\n")
                headers.append(list(header.items()))
                payloads.append(block[cut + 4 :] if cut >= 0 else block)
            yield pa.record_batch(
                [batch.column("file"), batch.column("owner"), pa.array(headers, pa.map_(pa.string(), pa.string())), pa.array(payloads, pa.binary())], ["file", "start", "header", "payload"]
            ).filter(pa.array(there, pa.bool_()))

    return single.union(glued).mapInArrow(parsed, "file string, start long, header map<string,string>, payload binary")


def _rebatched(rows: Iterator[tuple[str, int, int, bytes]], limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= limit:
            yield pa.record_batch([pa.array([r[k] for r in held], t) for k, t in enumerate(types)], ["file", "block", "place", "piece"])
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array([r[k] for r in held], t) for k, t in enumerate(types)], ["file", "block", "place", "piece"])


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query(OP9_SQL)
def op9_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    found = read_archives(spark, path)
    number = lambda name: F.expr(f"try_cast(regexp_extract(header['{name}'], '<urn:page:(-?[0-9]+)>', 1) AS long)")
    rows = found.select(
        number("WARC-Record-ID").alias("page_id"), F.col("header")["WARC-Type"].alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"), F.substring(F.col("header")["WARC-Payload-Digest"], 8, 64).alias("said"),
    )
    rows = written(rows, "warc-rows")
    # ids may repeat with other payloads, so a revisit meets the record that has its id and its digest
    first = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("said"), F.col("size").alias("full_size")).distinct()
    again = rows.where("refers_to IS NOT NULL").drop("size", "digest").join(first, ["refers_to", "said"], "left")
    return (
        rows.where("refers_to IS NULL").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
        .unionByName(again.select("page_id", F.col("full_size").alias("payload_bytes"), F.col("said").alias("payload_digest"), "record_type", "refers_to"))
    )
