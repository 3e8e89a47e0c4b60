"""Operators that SQL can express, against their SQL."""

import pytest
from compare import connect, differences
from helpers import SF_DIR

from stratiform.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLE[name]) == []
