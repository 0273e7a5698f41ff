"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import duckdb
import pytest

from spanloom import plans

TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return made


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query(spark, con, small, name):
    frame = plans.queries()[name](spark, small)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(map(plain, r))) for r in frame.select(*columns).collect())
    found = con.sql(plans.oracles()[name])
    at = [list(found.columns).index(c) for c in columns]
    assert got == sorted(str(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(plans.queries().keys() - plans.oracles().keys()))
def test_query_without_sql_runs(spark, small, name):
    assert plans.queries()[name](spark, small).count() > 0


def test_every_oracle_has_a_query():
    assert plans.oracles().keys() <= plans.queries().keys()
