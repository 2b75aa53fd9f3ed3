"""Draws that depend only on (seed, purpose, key).

A retried task, another partition count or another engine gives the same value, which ``rand()``
does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    """32 hex digits that order rows as a seeded shuffle would."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_int(seed: int | str, *keys: str | Column) -> Column:
    """Uniform integer below 2**32 (the first eight hex digits)."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint")


def unit_draw(seed: int | str, purpose: str, *keys: str | Column) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(seed, F.lit(purpose), *keys) / F.lit(4294967296.0)
