"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidegauge.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    cell = lambda x: round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    own = frame[columns].astype(object)
    return sorted(map(tuple, own.where(frame[columns].notna(), None).map(cell).astype(str).to_numpy().tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_names_agree():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
