import duckdb
import pytest
from compare import same

from sievelog.plans import catalogue

WITH_SQL = sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_its_sql(spark, sf, name):
    same(catalogue.queries()[name](spark, sf), sf, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(WITH_SQL)))
def test_other_queries_give_rows(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_values_of_more_users_than_a_position_lists(spark, tmp_path):
    """Events of 2,500 users a type: all of them count, and the most frequent one is seen last."""
    types = "list_value('click', 'error', 'purchase', 'signup', 'view')"
    duckdb.sql(
        f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, CASE WHEN i >= 12500 THEN 7000 + i % 5 ELSE i END AS user_id, {types}[1 + i % 5] AS event_type, "
        f"1.5::DOUBLE AS value, '{{}}' AS props FROM range(12520) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)"
    )
    name = "analysis_with_values"
    same(catalogue.queries()[name](spark, str(tmp_path)), str(tmp_path), catalogue.oracle_sql()[name])
