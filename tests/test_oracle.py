"""Every registered query with an SQL twin gives the twin's rows.

The folder comes from BARWEAVE_SF_DIR; the smallest scale keeps the run short.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from tools.check_oracle import compare, oracle_connection

FOLDER = os.environ.get("BARWEAVE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    c = oracle_connection(FOLDER)
    yield c
    c.close()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert compare(got, con.execute(ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"ml_gbt"}))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(df.columns) == len(set(df.columns))
    df.count()


def test_flagship_has_a_row(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n_obs"] > 500
