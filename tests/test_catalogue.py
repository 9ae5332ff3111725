import pytest
from oracle import DATA, compare

from winnower import catalogue, catalogue_packages  # noqa: F401  (the second adds its queries to the first)

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_nested_report(spark):
    import json

    rows = catalogue.QUERIES["report_nested"](spark, str(DATA)).collect()
    assert rows and all("n_defined" in json.loads(r["report"]) for r in rows)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["content_type", "n", "docs", "sum_conf"]
