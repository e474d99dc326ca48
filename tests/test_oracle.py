"""Every query that SQL can express gives DuckDB's rows."""

import pytest
from comparing import assert_same

from firegrid import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(name, spark, duck, sf_dir):
    assert_same(catalog.queries()[name](spark, sf_dir).toPandas(), duck.execute(catalog.oracle_sql()[name]).df())


def test_queries_without_sql_are_fits_with_tests_of_their_own():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"m2_logistic", "m4_platt", "m7_forward_cv", "m10_spatial_cv", "m11_importances", "m11_weighting"}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
