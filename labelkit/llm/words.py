"""Words of raw UTF-8 bytes, shared by the operators that read texts in Arrow batches."""

from __future__ import annotations

import re

_BLANK = ord(" ")
LOWER_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else _BLANK for c in range(256)
)
"""Byte table: A-Z to lower case, everything but letters, digits and non-ASCII to a blank."""
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def lower_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; every byte of a non-ASCII character is a word byte."""
    return text.translate(LOWER_WORDS).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words between ASCII white space (``\\x20``, ``\\x09``-``\\x0D``)."""
    return text.lower().split() if text else []
