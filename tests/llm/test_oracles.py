import pytest

from folioflow.llm import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, sf, name):
    compare(spark, sf, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf).count()
    assert rows > 0 or name == "p9_found"  # the smallest tables label too few documents for a subject


def test_splits_tear_no_component_apart(spark, sf):
    """No two pages that share a name come out with different splits."""
    from folioflow.llm.splits import p1_splits, split_pages
    from pyspark.sql import functions as F

    out = p1_splits(spark, sf).join(split_pages(spark, sf).select("page_id", F.explode("links").alias("name")), "page_id")
    assert out.groupBy("name").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
