"""What a merge of products moves."""

import datetime as dt
import re

from dealtide.operators import products

DAY = dt.date(1999, 5, 17)
SCHEMA = "retailer_slug string, retailer_name string, product string, vertical string, valid_from date, valid_until date, scraped_at timestamp, original_price double, promo_price double, discount string, seq bigint"


def rows(spark, found, day):
    full = [("s", name, "p", "v", DAY, DAY, dt.datetime(1999, 5, 17), price, promo, None, seq) for name, price, promo, seq in found]
    return products.keyed_rows(spark.createDataFrame(full, SCHEMA), day)


def test_a_history_is_not_moved_again_for_a_batch(spark):
    """Two exchanges for each side; the id, 32 digits, goes through none."""
    stored = products.merged_rows(rows(spark, [("s", 1.0, 2.0, 1)], "1999-05-18"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = products.upsert_products(stored, rows(spark, [("s", 3.0, 2.0, 1)], "1999-05-19"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert len(exchanges) == 4 and all("_key_a" in e for e in exchanges)


def test_first_price_and_name_are_kept(spark):
    """A key's first price is none or -1 whatever its last one is; the first name stays, equal to the slug or not."""
    for first, last in ((None, -1.0), (-1.0, None), (2.0, 2.0)):
        for name, other in (("s", "t"), ("t", "s")):
            batch = rows(spark, [(name, 1.0, first, 1), (other, 5.0, last, 2)], "1999-05-18")
            later = rows(spark, [("u", 9.0, first, 1)], "1999-05-19")
            one = products.upsert_products(None, batch).collect()
            two = products.upsert_products(products.upsert_products(None, batch), later).collect()
            assert [(r.retailer_name, r.promo_price, r.original_price) for r in one] == [(name, first, 5.0)]
            assert [(r.retailer_name, r.promo_price, r.original_price) for r in two] == [(name, first, 9.0)]
            assert one[0].id == two[0].id == batch.first().id and (one[0].year, one[0].week_number) == (1999, 20)
