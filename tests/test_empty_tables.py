"""Every query on tables without rows."""

from pathlib import Path

import pytest

from netledger.plans import catalogue, pipeline_queries
from tests.conftest import DATA


QUERIES = catalogue.QUERIES | pipeline_queries.QUERIES
# totals of nothing are one row a kind
TOTALS = {"q16_auc_pr": 2, "w_auc_pr": 2, "l_low_watermark": 1}


def empty_copy(spark, folder):
    for p in Path(DATA).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.mode("overwrite").parquet(f"{folder}/{p.name}")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return empty_copy(spark, tmp_path_factory.mktemp("empty"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert len(rows) == TOTALS.get(name, 0) and all(v is None or isinstance(v, str) for r in rows for v in r)
