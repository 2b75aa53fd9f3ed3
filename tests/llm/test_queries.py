"""Registered queries beside their SQL twins, and one query per operator."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from labelkit.llm import ORACLES, QUERIES
from tools.compare import duck, same_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert same_rows(got, duck(FOLDER).sql(ORACLES[name]).df()) is None


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(contract.queries())
