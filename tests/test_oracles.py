"""Every registered query of the library against its SQL."""

import compare
import pytest

from scriptorium import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, small, duck, name):
    found = catalogue.queries()[name](spark, small)
    assert compare.differences(found, duck, catalogue.oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_points(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["item_id", "doc_id", "rank", "score"]
    assert rows.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
