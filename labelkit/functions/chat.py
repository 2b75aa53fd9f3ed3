"""Chat templates, token lists, padding and loss masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The chat markers the target models were trained with, and the ignored label id.
TURN_START = "<|im_start|>"
TURN_SEP = "<|im_sep|>"
TURN_END = "<|im_end|>"
IGNORED = -100

# A marker is one token, else a run of letters, digits and underscores.
TOKEN_PATTERN = r"<\|[a-z_]+\|>|[\p{L}\p{N}_]+"


def _col(sel: str | Column) -> Column:
    return F.col(sel) if isinstance(sel, str) else sel


def _open_turn(role: str, style: str) -> Column:
    return F.lit(TURN_START + role + (TURN_SEP if style == "sep" else "") + "\n")


def render_turn(role: str, text: str | Column, style: str = "plain") -> Column:
    body = F.coalesce(_col(text), F.lit(""))
    return F.concat(_open_turn(role, style), body, F.lit(TURN_END + "\n"))


def render_chat(
    system: str | Column,
    user: str | Column,
    assistant: str | Column | None = None,
    style: str = "plain",
) -> Column:
    """System and user turn, then a closed assistant turn, or an open one without an answer.

    ``style="sep"`` puts the separator marker after each role name.
    """
    head = F.concat(render_turn("system", system, style), render_turn("user", user, style))
    if assistant is None:
        return F.concat(head, _open_turn("assistant", style))
    return F.concat(head, render_turn("assistant", assistant, style))


def tokenize(sel: str | Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(sel), F.lit("")), F.lit(pattern), F.lit(0))


def token_count(sel: str | Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Number of tokens without building the list."""
    return F.regexp_count(F.coalesce(_col(sel), F.lit("")), F.lit(pattern))


def token_ids(tokens: Column, vocab: int = 50000) -> Column:
    """Stable ids by hash; a real tokenizer goes through ``operators.sft.tokenize_with``."""
    return F.transform(
        tokens,
        lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % vocab).cast("int"),
    )


def pad_to(ids: Column, n: int, pad: int = 0) -> Column:
    """Cut to ``n`` ids or fill up with ``pad`` on the right."""
    return F.concat(
        F.slice(ids, 1, n),
        F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(ids), F.lit(0))),
    )


def attention_mask(length: Column, n: int) -> Column:
    """One for the first ``length`` of ``n`` places, zero for padding."""
    real = F.least(length.cast("int"), F.lit(n))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(n) - real))


def loss_mask(
    padded: Column, prefix: Column, marker: Column, answer: Column, n: int, compat: bool = False
) -> Column:
    """Training labels: only the answer's ids remain, everything else is ``IGNORED``.

    ``prefix``, ``marker`` and ``answer`` are token counts of the text before the assistant turn,
    of its opening marker and of the answer.  The end marker and padding are ignored too.  With
    ``compat=True`` a prefix that fills the whole sequence leaves it unmasked; by default such a
    row has no label left.
    """
    start, end = prefix + marker, prefix + marker + answer

    def inside(x: Column, i: Column) -> Column:
        if compat:
            gone = (
                ((prefix < n) & (i < prefix))
                | ((start < n) & (i >= prefix) & (i < start))
                | ((end < n) & (i >= end))
            )
        else:
            gone = (i < start) | (i >= end)
        return F.when(gone, F.lit(IGNORED)).otherwise(x)

    return F.transform(padded, inside)
