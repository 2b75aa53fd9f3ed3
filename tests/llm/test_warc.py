"""Archives written and read back, with markers inside payloads and splits in odd places."""

from __future__ import annotations

import hashlib

import pytest

from labelkit.llm import warc
from labelkit.session import shared_dir

SCHEMA = "page_id long, url string, html string, header string"


def pages() -> list[tuple]:
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n"
    rows = [
        (1, "http://a.example/ x\r\n", "plain", "h"), (2, None, None, None), (3, "u", "", None), (4, "u", "x" * 150, None), (5, "u", "x" * 150, None),
        (6, "u", "WARC/1.0\r\n", None), (7, "u", "a" + fake.format(5) + "12345\r\n\r\n" + fake.format(3) + "abc", None), (8, "u", "WARC/1.0\r\nWARC/1.0\r\n" * 30, None),
        (9, "u", "é𝄞\r\n\r\nü" * 40, None), (10, "u", "z" * 20_000 + fake.format(20_000) + "y" * 9_000, None), (11, "u", "x" * 99, None), (12, "u", "x" * 99, None),
        (None, "u", "x" * 150, None), (4, "u", "x" * 150, None), (13, "u", "\r\n\r\n", None), (14, "u", "WARC/1.0\r\nWARC/1.0\r\n" * 30, None),
    ]
    return rows + [(100 + k, "u", fake.format(k * 40) * (k % 5) + f"page {k} " * k, None) for k in range(60)]


@pytest.mark.parametrize("split", ["500", "3000", "128m"])
def test_round_trip(spark, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = shared_dir(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA).coalesce(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    name = lambda i: None if i is None else f"<urn:page:{i}>"
    found = sorted((str(r["header"].get("WARC-Record-ID")), r["header"]["WARC-Type"], bytes(r["payload"]), r["header"].get("WARC-Refers-To")) for r in got)
    first: dict[bytes, int] = {}
    for i, _, html, _ in pages():
        body = (html or "").encode()
        if i is not None and len(body) >= 100:
            first[body] = min(first.get(body, i), i)
    want = []
    for i, _, html, _ in pages():
        body = (html or "").encode()
        lead = first.get(body)
        again = i is not None and lead is not None and lead < i
        want.append((str(name(i)), "revisit" if again else "response", b"" if again else body, name(lead) if again else None))
    assert found == sorted(want)
    assert all(r["header"]["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(bytes(r["payload"])).hexdigest() for r in got if r["header"]["WARC-Type"] == "response")
    if split == "500":
        assert len({r["start"] for r in got}) > 50


def test_empty_table(spark):
    path = shared_dir(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).count() == 0


def test_query_on_ids_that_repeat_with_other_payloads(spark, tmp_path):
    a, b, long = "A" * 200, "B" * 200, "é" * 60
    rows = [(1, "u", a, None), (1, "u", b, None), (2, "u", a, None), (3, "u", "C" * 50, None), (4, "u", b, None), (4, "u", b, None), (5, "u", long, None),
            (6, "u", long, None), (None, "u", None, None), (None, "u", "short", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, warc.op9_warc_round_trip(spark, str(tmp_path)).collect()), key=str)
    lead = {a: 1, b: 1, long: 5}
    want = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        again = i is not None and lead.get(html, i) < i
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", lead[html] if again else None))
    assert got == sorted(want, key=str)
