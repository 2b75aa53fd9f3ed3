"""Checks and lookups on column names, made before any job runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which audio and reference text are looked for, in order.
AUDIO_NAMES = ["audio", "sound", "speech"]
TEXT_NAMES = ["text", "transcript", "sentence", "transcription"]


class MissingColumns(ValueError):
    """A required column is not there."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df


def first_existing(df: DataFrame, names: Sequence[str] = AUDIO_NAMES) -> str:
    """The first of the names that is a column."""
    for name in names:
        if name in df.columns:
            return name
    raise MissingColumns(f"none of {list(names)} is a column")


def reference_text(df: DataFrame, names: Sequence[str] = TEXT_NAMES) -> Column:
    """First non-empty value among the text columns that exist; null when there is none."""
    there = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def tag_source(df: DataFrame, **constants: object) -> DataFrame:
    """Add constant columns such as language, label text and origin."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})
