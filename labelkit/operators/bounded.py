"""Tables that are meant to be small, with the size checked before they are broadcast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_LOCAL_ROWS = 10_000


def local_table(spark: SparkSession, columns: Mapping[str, Sequence], schema: str) -> DataFrame:
    """A literal table. Built from Arrow, it is a local relation whose size Catalyst knows."""
    return spark.createDataFrame(pa.table({k: list(v) for k, v in columns.items()}), schema)


def local_copy(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> DataFrame | None:
    """``df`` as a local relation when it has at most ``max_rows`` rows, else None.

    At most ``max_rows + 1`` rows reach the driver.  The lineage of the copy ends here, and it is
    broadcast without a hint because its size is known.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def _estimate(df: DataFrame) -> int:
    """Bytes, as Catalyst sees them; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df`` may be broadcast: rows are counted, unless Spark would broadcast it unasked by its size."""
    own = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return _estimate(df) <= min(own, max_rows) or df.count() <= max_rows


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Broadcast join when ``small`` is proven small, else a shuffle join under AQE skew handling."""
    on = [on] if isinstance(on, str) else list(on)
    return big.join(F.broadcast(small) if is_small(small, max_rows) else small, on, how)


def spread(df: DataFrame, key: str, max_bytes: int = 256 << 20) -> DataFrame:
    """``df`` dealt to all cores by ``key`` when Catalyst estimates it to be small; larger tables stay as they are.

    A small table often is one file with one row group, which a single task reads; heavy work on its rows is
    worth a shuffle of that size.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key) if _estimate(df) <= max_bytes else df
