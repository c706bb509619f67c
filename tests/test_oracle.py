"""Every registered query on the smallest tables, against its SQL."""

import pytest

from cadencia.plans import QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
# minutes even on these tables; their operators run on smaller fixtures in test_waves
SLOW = {"grid", "soft_dtw_cluster_stats", "tune"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    msg = compare(spark, con, name, SF)
    assert msg in (None, "both empty", "no rows"), msg


def test_registry_is_complete():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 150
