"""Compare a Spark result with the result of its SQL twin."""

from __future__ import annotations

import math

import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    """DuckDB connection with every table of a folder as a view."""
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _kind(values: pd.Series) -> str:
    kind = values.dtype.kind
    if kind == "f" and values.isna().any() and (values.dropna() % 1 == 0).all():
        return "int64"  # a long column with nulls comes as float
    if kind in "iu" and values.dtype.name == "Int64":
        return "int64"
    if kind in "iu":
        return values.dtype.name
    if kind == "f":
        return "float64"
    if kind == "M":
        return "time"
    if kind == "b":
        return "bool"
    return "text"


def _cell(value: object) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return repr(value.item() if hasattr(value, "item") else value)


def same_rows(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both frames hold the same rows in any order, else what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(want) == 0:
        return "no rows"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    names = sorted(got.columns)
    kinds = {n: (_kind(got[n]), _kind(want[n])) for n in names}
    odd = {n: k for n, k in kinds.items() if k[0] != k[1]}
    if odd:
        return f"types {odd}"
    for n, (a, b) in kinds.items():
        if a == b == "int64":
            got, want = got.assign(**{n: got[n].astype("Int64")}), want.assign(**{n: want[n].astype("Int64")})
    left = sorted(tuple(_cell(v) for v in row) for row in got[names].astype(object).itertuples(index=False))
    right = sorted(tuple(_cell(v) for v in row) for row in want[names].astype(object).itertuples(index=False))
    for a, b in zip(left, right):
        if a != b:
            return f"values {names}: {str(a)[:300]} vs {str(b)[:300]}"
    return None
