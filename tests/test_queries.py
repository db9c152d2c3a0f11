import pytest

from trialframe.plans.oracles import oracle_sql
from trialframe.plans.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(name, compare):
    found, expected = compare(queries()[name], oracle_sql()[name], SF)
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_gives_rows(name, spark):
    assert queries()[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
