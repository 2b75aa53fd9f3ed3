from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelkit.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "labelkit-tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Value of a column over a one-row table given as keyword arguments (name=(value, type))."""

    def evaluate(column, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(
            *[F.lit(v).cast(t).alias(n) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast(t).alias(n)
              for n, (v, t) in values.items()],
            F.lit(0).alias("__"),
        )
        return row.select(column.alias("x")).first()["x"]

    return evaluate
