"""Every registered query beside its SQL twin, and the driver contract."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as contract
from labelkit.plans import ORACLES, QUERIES
from tools.compare import duck, same_rows

FOLDER = "/root/testdata/sf0.01"


needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert same_rows(got, con.sql(ORACLES[name]).df()) is None


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


@needs_data
def test_entry(spark):
    report = contract.entry(spark)
    assert report.columns == ["split", "name", "precision", "recall", "f1", "support"] and report.count() > 0


def test_every_oracle_has_a_query():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) >= set(QUERIES)
    assert all(re.fullmatch(r"[a-z][a-z0-9_]+", name) for name in queries)
