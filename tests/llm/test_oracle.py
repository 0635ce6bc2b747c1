import os

import pytest
from lodestar.llm.queries import ORACLE, QUERIES
from oracle import compare, connect

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    compare(QUERIES[name](spark, SF), connect(SF), ORACLE[name])
