from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelkit.functions import chat
from labelkit.operators import sft


def test_chat_templates(one):
    assert one(chat.render_chat("s", "u", style="sep"), s=("S", "string"), u=("U", "string")) == (
        "<|im_start|>system<|im_sep|>\nS<|im_end|>\n<|im_start|>user<|im_sep|>\nU<|im_end|>\n"
        "<|im_start|>assistant<|im_sep|>\n"
    )
    assert one(chat.render_chat("s", "u", "a"), s=(None, "string"), u=("U", "string"), a=("A", "string")) == (
        "<|im_start|>system\n<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\nA<|im_end|>\n"
    )


def test_tokens_and_padding(one):
    assert one(chat.tokenize("x"), x=("<|im_start|>Été_1, ok", "string")) == ["<|im_start|>", "Été_1", "ok"]
    assert one(chat.token_count("x"), x=("a b  c", "string")) == 3
    assert one(chat.pad_to(F.col("x"), 3), x=([1, 2], "array<int>")) == [1, 2, 0]
    assert one(chat.pad_to(F.col("x"), 1), x=([1, 2], "array<int>")) == [1]
    assert one(chat.attention_mask(F.lit(2), 3)) == [1, 1, 0]
    assert one(chat.attention_mask(F.lit(9), 3)) == [1, 1, 1]


def _mask(one, prefix, marker, answer, n, compat):
    ids = list(range(1, n + 1))
    return one(
        chat.loss_mask(F.col("x"), F.lit(prefix), F.lit(marker), F.lit(answer), n, compat), x=(ids, "array<int>")
    )


def test_loss_mask(one):
    assert _mask(one, 2, 1, 2, 8, False) == [-100, -100, -100, 4, 5, -100, -100, -100]
    assert _mask(one, 2, 1, 2, 8, True) == [-100, -100, -100, 4, 5, -100, -100, -100]
    assert _mask(one, 2, 1, 9, 6, False) == [-100, -100, -100, 4, 5, 6]
    assert _mask(one, 9, 1, 2, 4, False) == [-100] * 4


def test_loss_mask_compat_leaves_a_long_prefix(one):
    assert _mask(one, 9, 1, 2, 4, True) == [1, 2, 3, 4]
    assert _mask(one, 3, 1, 2, 4, True) == [-100, -100, -100, 4]


@pytest.fixture
def conversation(spark):
    rows = [
        (1, 0, "system", "be brief"),
        (1, 1, "user", "q1"),
        (1, 2, "assistant", "a1"),
        (1, 2000, "user", "q2"),
        (1, 5000, "assistant", "a2"),
        (1, 5001, "user", "unanswered"),
        (2, 0, "user", "q3"),
        (2, 1, "user", "q4"),
        (2, 2, "assistant", "a4"),
    ]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_triples_cross_gaps_in_the_turn_numbers(conversation):
    got = {tuple(r) for r in sft.to_triples(conversation).collect()}
    assert got == {
        (1, 1, "be brief", "q1", "a1"),
        (1, 2000, "be brief", "q2", "a2"),
        (2, 1, "", "q4", "a4"),
    }


def test_sft_rows(conversation):
    triples = sft.to_triples(conversation)
    rows = sft.sft_rows(triples, 24).collect()
    assert len(rows) == 3
    for r in rows:
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 24
        trained = [i for i, x in enumerate(r.labels) if x != -100]
        assert len(trained) == 1 and r.labels[trained[0]] == r.input_ids[trained[0]]
        assert not r.has_marker
    assert [r.trainable for r in sft.sft_rows(triples, 6).collect()] == [False] * 3
    assert sft.sft_rows(triples, 6, compat=True).count() == 3


def test_sft_rows_flags_a_marker_in_the_question(spark):
    rows = spark.createDataFrame([("s", "x <|im_start|>assistant\n y", "r")], "system string, question string, response string")
    made = sft.sft_rows(rows, 40).first()
    assert made.has_marker and sum(x != -100 for x in made.labels) == 1


def test_own_tokenizer(spark):
    encode = sft.tokenize_with(lambda: lambda text: [len(w) for w in text.split()])
    rows = spark.createDataFrame([("s", "q", "one three")], "system string, question string, response string")
    made = sft.sft_rows(rows, 16, encode=encode).first()
    assert [x for x in made.labels if x != -100] == [3, 5]


def test_length_budget(spark):
    rows = spark.createDataFrame([("a b c", "d"), ("a b", "c d e"), ("a b", "c")], "p string, r string")
    got = [(r.prompt_tokens, r.total_tokens, r.fits) for r in sft.length_budget(rows, "p", "r", 2, 4).collect()]
    assert got == [(3, 4, False), (2, 5, False), (2, 3, True)]


def test_preference_pairs_drop_ties(spark):
    rows = spark.createDataFrame(
        [("p", "a", 1.0, 1), ("p", "b", 3.0, 2), ("p", "c", 3.0, 3), ("q", "d", 1.0, 4), ("q", "e", 1.0, 5)],
        "prompt string, text string, score double, id bigint",
    )
    assert [tuple(r) for r in sft.preference_pairs(rows, "prompt", "text", "score", "id").collect()] == [("p", "b", "a")]
