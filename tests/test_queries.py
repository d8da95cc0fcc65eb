import pytest

from umbra.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(name, spark, sf, same_as_sql):
    same_as_sql(QUERIES[name](spark, sf), ORACLE_SQL[name])


def test_predicates_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["inventory_size_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
    plan = QUERIES["column_redact"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
