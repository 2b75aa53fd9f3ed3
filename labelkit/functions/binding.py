"""Evaluate a value once and use it inside lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed a single time.

    An outer expression written inside ``transform(arr, lambda x: ...)`` is evaluated for every
    element, which makes mean or maximum quadratic in the array length.  A lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
