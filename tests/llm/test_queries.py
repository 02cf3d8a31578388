import pytest

from linescan.llm import registry
from tests.conftest import DATA, same_as_sql


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(registry.QUERIES[name](spark, DATA), duck, registry.ORACLE_SQL[name])
