"""Every retrieval query against its SQL on sf0.001."""

import pytest

from conftest import DATA, oracle_rows, rows_of
from ragmill.plans import registry



@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    assert rows_of(registry.queries()[name](spark, DATA)) == oracle_rows(duck, registry.oracle_sql()[name])


#: Queries without SQL, and whether the given pages and documents hold anything for them; txt10_cards has literal tests.
@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql()])
def test_without_sql_gives_rows(spark, name):
    out = registry.queries()[name](spark, DATA)
    assert len(set(out.columns)) == len(out.columns)
    assert name == "txt10_cards" or out.count() > 0
