"""Every registered query equals its DuckDB oracle on sf0.001 (row count, columns, values)."""

import pytest

import __spark_entry__ as E
from tools.check_oracle import digest

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_every_query_is_registered_with_an_oracle():
    missing = sorted(set(QUERIES) - set(ORACLE) - set(E.LLM_QUERIES))
    # queries without SQL form are tested against brute force elsewhere
    assert missing == [], missing


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1
    assert rows[0]["duplicate_groups"] == 10 and rows[0]["duplicate_files"] == 21
    assert rows[0]["wasted_bytes"] == 29443


@pytest.mark.parametrize("name", sorted(set(ORACLE) - set(E.LLM_ORACLE)))
def test_query_matches_oracle(spark, duck, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(rel.columns, drows)[0]
