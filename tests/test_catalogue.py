"""Every query beside its DuckDB text on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from netledger.plans import catalogue, pipeline_queries
from tests.conftest import DATA

QUERIES = catalogue.QUERIES | pipeline_queries.QUERIES
ORACLE = catalogue.ORACLE | pipeline_queries.ORACLE


def norm(v):
    if isinstance(v, float):
        return f"{v:.8g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_its_text():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(map(norm, r)) for r in df.select(*cols).collect())
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want
