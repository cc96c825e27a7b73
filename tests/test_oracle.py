"""Every registered query of the library against its SQL on the smallest tables; those without SQL must run."""

import os

import pytest
from oracle import compare

from loamwork.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert compare(spark, QUERIES[name], SQL[name], SF) == []
    else:
        assert QUERIES[name](spark, SF).count() >= 0
