import pytest

from threadloom.plans import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_its_oracle(name, spark, sf_dir, same_rows):
    same_rows(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name])


def test_entry_imports_and_lists_every_archive_query():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.ORACLES) <= set(entry.oracle_sql())
