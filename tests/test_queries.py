import pytest
from aerolith.plans import registry

from .oracle import connect, same


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    assert same(registry.queries()[name](spark, sf_dir), duck, registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0
