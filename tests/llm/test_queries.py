import pytest

from netledger.llm.queries import QUERIES
from tests.conftest import DATA
from tests.test_empty_tables import empty_copy


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return empty_copy(spark, tmp_path_factory.mktemp("empty"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert [tuple(r) for r in rows] == ([(0, 0, 0, None)] if name == "p7_fill" else [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_small_tables(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows and len(rows) == len(set(map(str, rows)))
