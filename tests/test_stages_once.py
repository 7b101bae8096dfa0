"""Later stages look only at retailers without deals, and what several branches read is extracted once."""

import pytest

from dealtide.operators import deals
from dealtide.plans import QUERIES


def test_retailers_with_deals_are_done(spark):
    pages = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("b", 4)], "retailer_slug string, page int")
    done = spark.createDataFrame([("b",), (None,), ("c",)], "retailer_slug string")
    assert sorted(r.page for r in deals.without_deals(pages, done).collect()) == [1, 3]


@pytest.mark.parametrize("name", ["harvest_products", "extraction_fallback"])
def test_pages_are_parsed_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan
