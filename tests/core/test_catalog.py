"""Every query that has SQL gives the rows that DuckDB gives, over the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from repograph.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
SQL, QUERIES = catalog.oracle_sql(), catalog.queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    got = duck.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    want = Counter(tuple(_cell(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall())
    have = Counter(tuple(_cell(r[c]) for c in sorted(columns)) for r in df.collect())
    assert have == want and (sum(want.values()) or name == "j13_files_importing")


def test_every_query_is_named_with_sql():
    assert set(QUERIES) == set(SQL)
