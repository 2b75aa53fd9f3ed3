"""Quality cutoffs, packing, language and the pipeline."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelkit.llm import langid, packing, quality

FOLDER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def counted(text: str | None) -> tuple[int, ...]:
    t = text or ""
    w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_counts_of_whole_texts(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "a b c d a b c\n\na\na\n a", "é𝄞 #$% é𝄞 #$% é𝄞 q", "the cat " * 30_000, "a b c x a b c x a b"]
    rows = [(i, t, None, 1) for i, t in enumerate(texts)]
    got = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, quality long")).collect()
    assert {r["doc_id"]: tuple(r["quality_"][c] for c in quality.COUNTS) for r in got} == {i: counted(t) for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    cases = [(0, 10, 0.3), (2, 100, 0.05), (10, 400, 0.05), (300, 10_000, 0.04), (45, 1000, 0.05), (90_000, 2_000_000, 0.05), (5, 10, 0.05)]
    for k, n, risk in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), risk).alias("p")).first()["p"]
        log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log(1 - risk) for i in range(k + 1)]
        want = math.fsum(math.exp(x) for x in log)
        near = n * risk - k < math.sqrt(n * risk * (1 - risk))
        assert got == 1.0 if near else got == pytest.approx(want, rel=1e-6, abs=1e-300)


def test_cutoffs_keep_good_documents_and_need_enough_labels(spark):
    rng = random.Random(4)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    rows = [(i, plain(), "en", 1) for i in range(1500)] + [(2000 + i, plain().upper(), "en", 0) for i in range(100)]
    rows += [(3000 + i, plain(), "fr", 1) for i in range(20)] + [(4000 + i, plain().upper(), "fr", 0) for i in range(20)]
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows] + [(9, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows] + [(None, 1), (77_777, 0)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, _, lang, q in rows if q == 1 or lang == "fr"}  # too few labels certify nothing
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels.limit(0)).count() == len(rows)
    assert quality.keep_good(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    supply = np.zeros(101, np.int64)
    for size in rng.integers(1, 101, 400 if seed else 1):
        supply[size] += rng.integers(1, 30)
    plan = packing.pack_histogram(supply, 100, 60)
    used = np.zeros(101, np.int64)
    for config, times in plan:
        assert sum(config) <= 100 and times > 0
        for size in config:
            used[size] += times
    assert (used == supply).all()
    n, lower = sum(t for _, t in plan), -(-int((supply * np.arange(101)).sum()) // 100)
    if seed:
        assert lower <= n <= lower * 1.05 + 1
    else:  # one length only: as many as fit go into each
        size = int(np.flatnonzero(supply)[0])
        assert n == -(-int(supply[size]) // (100 // size))
    assert packing.pack_histogram(np.zeros(101, np.int64), 100) == []


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(path("byte_bpe_50k.json")))
    rng = random.Random(6)
    odd = [None, "", " ", "  two  blanks ", "a\n\nb\t c", "é𝄞 ß x  y", "<|endoftext|> and <|endoftext|>", "it's we'll 123 45", " lead", "trail ", "word " * 5000]
    texts = odd + [" ".join(rng.choice(["alpha", "Beta,", "gamma's", "42"]) for _ in range(rng.randrange(1, 300))) for _ in range(80)]
    data = list(enumerate(texts)) + [(3, texts[3])]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, text string").repartition(3), capacity=256).toPandas()
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [0] for i, t in data}
    for r in got.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.asarray(part, "<u4").tobytes()) == r.ids_crc32
    assert got.length.sum() == sum(len(ids[i]) for i, _ in data)
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *group.length.cumsum().tolist()[:-1]] and group.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_languages(spark):
    words = {"en": ["the", "house", "stone", "water"], "de": ["das", "haus", "stein", "wasser"], "fr": ["la", "maison", "pierre", "eau"]}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(words[lang], k=20)), lang) for i, lang in enumerate(list(words) * 20)] + [(900, None, "en"), (901, "the", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(1, "the stone", "en"), (2, "wassersteine", "de"), (3, None, "und"), (4, "", "und"), (5, "12 !!", "und"), (6, "pierres", "fr"), (7, "THE HOUSE " * 20_000, "en")]
    got = langid.predict(spark.createDataFrame([(i, t, None) for i, t, _ in tests], "doc_id long, text string, lang string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: want for i, _, want in tests}
    assert all(0 <= r["score"] <= 1 for r in got)
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none.predict("some text") == ("und", 0.0)


def test_long_runs_are_read_to_their_end(spark):
    rng = random.Random(9)
    run = lambda letters, n: "".join(rng.choices(letters, k=n))
    head, rows = run("abcd", 64), []
    rows += [(i, head + run("mnop", 400), "x") for i in range(10)] + [(100 + i, run("abcd", 300), "y") for i in range(10)]
    rows += [(200 + i, " ".join(run("qrst", 5) for _ in range(20)), "z") for i in range(10)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    every = Counter(g[i : i + 3] for _, t, _ in rows for w in t.split() for g in [f"^{w}$"] for i in range(len(g) - 2))
    assert {g for g in model.grams if len(g) == 3} == set(every)
    assert model.predict(head + run("mnop", 200))[0] == "x" and model.predict(head + run("qrst", 500))[0] == "z"
    assert model.predict(run("abcd", 20_000))[0] == "y" and langid.slices("a" * 58) == ["^" + "a" * 58 + "$"]


def test_rare_languages_are_learned(spark):
    large = [(i, f"the house w{chr(97 + i % 26)}{chr(97 + i // 26)} stone", "en") for i in range(600)]
    rare = [(1000 + i, "gwlad dwfr", "cy") for i in range(3)]
    model = langid.train(spark.createDataFrame(large + rare, "doc_id long, text string, lang string"), sample_docs=40, vocabulary=12)
    assert model.langs == ["cy", "en"] and {"gwlad", "dwfr", "the", "house", "stone"} <= set(model.words) and len(model.words) < 30
    assert model.predict("gwlad")[0] == "cy" and model.predict("the stone")[0] == "en"
    assert langid.cut_off([(1, 8), (5, 2), (9, 1)], 7) == (1, 0.5) and langid.cut_off([(1, 8)], 8) == (0, 0.0)


@needs_data
def test_language_accuracy_on_held_out_documents(spark):
    got = langid.op8_language_id(spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert held["n"] > 200 and held["a"] > 0.97


@needs_data
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == before
