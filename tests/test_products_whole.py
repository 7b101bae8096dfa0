"""Questions about products give all rows when no limit is asked for."""

import datetime as dt

from dealtide.operators import products

DAY = dt.date(1999, 5, 17)


def stored(spark, count):
    rows = [("s7", f"p{n:05d}", "beauty", DAY, DAY + dt.timedelta(days=6), dt.datetime(1999, 5, 17), "Promo", 1.0, n) for n in range(count)]
    deals = spark.createDataFrame(rows, "retailer_slug string, product string, vertical string, valid_from date, valid_until date, scraped_at timestamp, category string, promo_price double, seq bigint")
    return products.upsert_products(None, products.product_rows(deals.withColumn("original_price", deals.promo_price), "1999-05-18"))


def test_no_limit_is_the_whole_answer(spark):
    held = stored(spark, 1200)
    asked = [
        products.products_by_retailer(held, "s7", week=20, year=1999, limit=None), products.products_by_week(held, 20, 1999, vertical="beauty", limit=None),
        products.products_by_category(held, "pROMO", "1999-05-20", limit=None), products.search_products(held, "p", "1999-05-20", limit=None),
    ]
    for found in asked:
        assert [r.product_name for r in found.select("product_name").collect()] == [f"p{n:05d}" for n in range(1200)]
    assert products.products_by_week(held, 20, 1999, limit="x").count() == 1000


def test_category_merges_only_what_can_pass(spark):
    """A product with an older row that passes is looked at, but its last row decides; the others are not merged."""
    from dealtide.plans import ORACLES, QUERIES

    from .compare import compare, duck

    sf = "/root/testdata/sf0.001"
    assert "LeftSemi" in QUERIES["products_by_category"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "products_by_category" in ORACLES and compare(spark, duck(sf), sf, "products_by_category") is None
    rows = [("s", "p", "v", DAY, DAY, dt.datetime(1999, 5, 17), "promo", 1.0, 1), ("s", "p", "v", DAY, DAY, dt.datetime(1999, 5, 18), "other", 1.0, 2)]
    deals = spark.createDataFrame(rows, "retailer_slug string, product string, vertical string, valid_from date, valid_until date, scraped_at timestamp, category string, promo_price double, seq bigint")
    keyed = products.keyed_rows(deals.withColumn("original_price", deals.promo_price), "1999-05-18")
    assert keyed.filter(products.in_category(keyed, "PROMO", "1999-05-20")).count() == 1
    assert products.products_by_category(products.upsert_products(None, keyed), "PROMO", "1999-05-20", limit=None).count() == 0


def test_key_conditions_come_before_the_merge(spark, monkeypatch):
    """What is merged for a question about one retailer, week or validity are its rows only."""
    from dealtide.plans import QUERIES, product_queries

    merge, seen = products.upsert_products, []
    monkeypatch.setattr(product_queries.pr, "upsert_products", lambda held, rows: seen.append(rows) or merge(held, rows))
    outside = {"products_by_retailer": "retailer_slug <> 's7'", "products_by_week": "vertical <> 'beauty'", "search_products": "valid_until < DATE '2001-10-01'"}
    for name, other in outside.items():
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert seen.pop().filter(other).count() == 0
