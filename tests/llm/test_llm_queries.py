"""Every query of the subpackage runs on the smallest tables; those with SQL agree with it."""

import pytest

from tallyloom.llm import queries as Q
from tests.conftest import SMALL
from tests.harness import compare


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    if name in Q.ORACLE:
        assert compare(spark, Q.QUERIES[name], Q.ORACLE[name], SMALL) == ""
    else:
        assert Q.QUERIES[name](spark, SMALL).count() > 0
