"""Instruction-tuning rows: triples, token lists with loss masks, length limits, preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from labelkit.functions import chat
from labelkit.operators.ranking import next_in_group, order_range


def to_triples(conv: DataFrame, width: int = 1024) -> DataFrame:
    """(conv_id, turn, system, question, response) for each user turn that an assistant turn follows.

    The system text is the conversation's first system turn, or empty.  It is joined per range of
    turns, the partitioning the pairs already have, so turns are shuffled once.
    """
    turns = conv.select("conv_id", "turn", "role", "text")
    follow = next_in_group(turns, "conv_id", "turn", ["role", "text"], width, keep_range=True)
    pairs = follow.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    systems = (
        turns.where(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system"))
    )
    ranges = turns.select("conv_id", order_range("turn", width).alias("__range")).distinct()
    per_range = ranges.join(systems, "conv_id", "inner")
    return pairs.join(per_range, ["conv_id", "__range"], "left").select(
        "conv_id",
        "turn",
        F.coalesce("system", F.lit("")).alias("system"),
        F.col("text").alias("question"),
        F.col("next_text").alias("response"),
    )


def tokenize_with(encoder_factory: Callable[[], Callable[[str], list[int]]]) -> Callable[[Column], Column]:
    """Column function around a real tokenizer, built once per Python worker task."""

    @pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_factory()
        for part in texts:
            yield part.map(lambda t: encoder(t if t is not None else ""))

    return encode


def sft_rows(
    triples: DataFrame,
    max_length: int = 4096,
    pad: int = 0,
    encode: Callable[[Column], Column] | None = None,
    compat: bool = False,
) -> DataFrame:
    """Adds input_ids, attention_mask and labels (IGNORED outside the answer) of fixed length.

    Each part of the chat is tokenized on its own, so its length is known and a text that happens
    to hold the assistant marker cannot move the mask; such rows are flagged.  Every row stays; rows
    without a trained token (the prefix fills the sequence, or there is no answer) have ``trainable``
    false.  ``compat=True`` leaves a long prefix unmasked.
    """
    encode = encode or (lambda text: chat.token_ids(chat.tokenize(text)))
    opening = chat.TURN_START + "assistant\n"
    prefix_text = F.concat(chat.render_turn("system", "system"), chat.render_turn("user", "question"))
    parts = triples.withColumns(
        {
            "prefix_ids": encode(prefix_text),
            "marker_ids": encode(F.lit(opening)),
            "answer_ids": encode(F.coalesce("response", F.lit(""))),
            "end_ids": encode(F.lit(chat.TURN_END)),
            "has_marker": F.contains(F.concat_ws("\n", "system", "question"), F.lit(opening)),
        }
    )
    lengths = {c: F.size(f"{c}_ids") for c in ("prefix", "marker", "answer", "end")}
    total = lengths["prefix"] + lengths["marker"] + lengths["answer"] + lengths["end"]
    padded = chat.pad_to(F.concat("prefix_ids", "marker_ids", "answer_ids", "end_ids"), max_length, pad)
    rows = parts.withColumn("input_ids", padded).withColumns(
        {
            "attention_mask": chat.attention_mask(total, max_length),
            "labels": chat.loss_mask(
                F.col("input_ids"), lengths["prefix"], lengths["marker"], lengths["answer"], max_length, compat
            ),
        }
    )
    trainable = (lengths["prefix"] + lengths["marker"] < max_length) & (lengths["answer"] > 0)
    return rows.withColumn("trainable", trainable).drop("prefix_ids", "marker_ids", "answer_ids", "end_ids")


def length_budget(
    df: DataFrame,
    prompt: str | Column,
    answer: str | Column,
    max_prompt: int = 12288,
    max_total: int = 12800,
    count: Callable[[str | Column], Column] = chat.token_count,
) -> DataFrame:
    """Adds prompt_tokens, total_tokens and fits (both limits kept)."""
    counted = df.withColumns({"prompt_tokens": count(prompt), "answer_tokens": count(answer)})
    return (
        counted.withColumn("total_tokens", F.col("prompt_tokens") + F.col("answer_tokens"))
        .withColumn("fits", (F.col("prompt_tokens") <= max_prompt) & (F.col("total_tokens") <= max_total))
        .drop("answer_tokens")
    )


def preference_pairs(scored: DataFrame, prompt: str, response: str, score: str, key: str) -> DataFrame:
    """(prompt, chosen, rejected): best and worst answer per prompt, none when all scores are equal.

    ``key`` identifies an answer and breaks ties, the smaller one first.  The choice is made on keys
    alone; the answers are then looked up by key, and Catalyst broadcasts the chosen keys where their
    size in bytes allows.
    """
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k")))
    worst = F.min(F.struct(F.col(score).alias("s"), F.col(key).alias("k")))
    ends = (
        scored.groupBy(F.col(prompt).alias("prompt"))
        .agg(best.alias("hi"), worst.alias("lo"))
        .where(F.col("hi.s") > F.col("lo.s"))
    )
    keys = ends.select(
        "prompt",
        F.inline(
            F.array(
                F.struct((-F.col("hi.k")).alias("__key"), F.lit("chosen").alias("role")),
                F.struct(F.col("lo.k").alias("__key"), F.lit("rejected").alias("role")),
            )
        ),
    )
    answers = scored.select(F.col(key).alias("__key"), F.col(response).alias("answer"))
    found = answers.join(keys, "__key", "inner")
    return found.groupBy("prompt").agg(
        *[F.max(F.when(F.col("role") == r, F.col("answer"))).alias(r) for r in ("chosen", "rejected")]
    )
