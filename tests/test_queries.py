"""Every query against its DuckDB SQL, and the driver's entry points."""

from __future__ import annotations

import pytest

import __spark_entry__
from rallypoint.plans import further, oracles, queries, studies
from tests.compare import same_rows

QUERIES, SQL = {**queries.QUERIES, **further.QUERIES, **studies.QUERIES}, {**oracles.SQL, **further.SQL, **studies.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, small, name):
    same_rows(QUERIES[name](spark, small), duck.sql(SQL[name]))


def test_champion_means_of_all_events(spark, duck, small):
    want = "SELECT user_id, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN avg(value) ELSE (SELECT avg(value) FROM events) END, 6) AS mean FROM events GROUP BY user_id"
    same_rows(QUERIES["champion_means"](spark, small), duck.sql(want))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "games" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
