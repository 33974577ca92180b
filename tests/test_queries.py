"""Every query with SQL against that SQL, over the tables of sf0.01."""

from __future__ import annotations

import pytest

from barloom.plans import all as plans
from tests.oracle import spark_rows, sql_rows, tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


def test_every_sql_has_its_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)
    assert all(isinstance(sql, str) for sql in plans.ORACLE_SQL.values())


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    names, found = spark_rows(plans.QUERIES[name](spark, SF))
    wanted_names, wanted = sql_rows(con, plans.ORACLE_SQL[name])
    assert names == wanted_names
    assert len(found) == len(wanted)
    differing = [(a, b) for a, b in zip(found, wanted, strict=True) if a != b]
    assert not differing, f"{len(differing)} of {len(found)} rows, first {differing[0]}"


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    frame = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert frame.columns and frame.limit(1).count() == 1
