"""Harvest: the choice of stages, challenges, documents read back, and the way into the product store."""

import datetime as dt

from pyspark.sql import functions as F

from dealtide.operators import harvest as hv
from dealtide.operators import products
from dealtide.operators.changes import doc_changed
from dealtide.sources import product_store, sinks
from dealtide.sources.documents import parse_docs, read_folder_docs
from dealtide.sources.tables import read_products

NOW = "2024-01-31 00:00:00"
DEAL = "retailer_slug string, page bigint, id string, product string, original_price double, promo_price double, discount string, description string, image_url string"


def deals_of(spark, rows, stage, method):
    full = [(r, page, id_, product, None, price, None, f"about {product}", None) for r, page, id_, product, price in rows]
    return hv.stage_deals(spark.createDataFrame(full, DEAL), stage, method, "page")


def setup(spark):
    primary = deals_of(spark, [("a", 1, "html-0", "P", 1.0), ("a", 1, "html-1", " p ", 1.0), ("a", 3, "html-0", "late", 1.0), ("b", 2, "html-0", "blocked", 1.0)], hv.PRIMARY, "html")
    leaflet = deals_of(spark, [("a", 0, "a-pdf-0", "unused", 2.0), ("b", 0, "b-pdf-0", "L", 2.0)], hv.LEAFLET_TEXT, "pdf-text")
    text = deals_of(spark, [("b", 1, "t-0", "unused", 3.0), ("c", 2, "t-0", "T", 3.0), ("c", 2, "t-1", "U", None), ("c", 3, "t-0", "later page", 3.0), ("d", 2, "t-0", "after challenge", 3.0)], hv.PAGE_TEXT, "page-text")
    visits = [("a", 0, 2, True), ("a", 0, 1, False), ("b", 0, 1, True), ("c", 2, 1, False), ("c", 2, 2, False), ("c", 2, 4, True), ("d", 2, 1, True), ("a", 0, 3, False)]
    visits = spark.createDataFrame([(*v, f"https://x/{v[2]}") for v in visits], "retailer_slug string, stage int, page_no bigint, challenged boolean, url string")
    return primary.unionByName(leaflet).unionByName(text), visits


def test_stages_and_challenges(spark):
    deals, visits = setup(spark)
    got = {(r.retailer_slug, r.method, r.product, r.description) for r in hv.harvested(deals, visits, NOW).collect()}
    assert got == {("a", "html", "P", "about P"), ("b", "pdf-text", "L", "about L"), ("c", "page-text", "T", "about T"), ("c", "page-text", "U", "about U")}
    [week] = hv.harvested(deals, visits, NOW).select("valid_from", "valid_until", "scraped_at").distinct().collect()
    assert tuple(week) == (dt.date(2024, 1, 29), dt.date(2024, 2, 4), dt.datetime(2024, 1, 31))


def test_one_pass(spark):
    deals, visits = setup(spark)
    plan = hv.harvested(deals, visits, NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") == 1 and "WindowGroupLimit" in plan


def test_nothing_harvested(spark):
    deals, visits = setup(spark)
    none = hv.harvested(deals.limit(0), visits.limit(0), NOW)
    leaflets = spark.createDataFrame([], FOLDER)
    assert none.count() == 0 and hv.harvest_documents(none, leaflets, visits.limit(0), NOW).count() == 0


FOLDER = (
    "retailer_slug string, id string, title string, valid_from date, valid_until date, page_count int, thumbnail_url string, "
    "pages array<struct<page_number:int,image_url:string>>, embed_url string, pdf_url string, content_source string, scraped_at timestamp_ntz"
)


def test_documents_and_history(spark, tmp_path):
    deals, visits = setup(spark)
    found = hv.harvested(deals, visits, NOW)
    day = dt.date(2024, 1, 29)
    leaflets = [(s, f"{s}-f", f"Leaflet {s}", day, day, 1, "", [(1, "/p.png")], None, "https://x/f.pdf", "pdf", dt.datetime(2024, 1, 31)) for s in ("b", "e")]
    leaflets = spark.createDataFrame(leaflets, FOLDER)
    docs = hv.harvest_documents(found, leaflets, visits, NOW)
    parsed = {r.slug: r for r in parse_docs(docs.select("slug", "raw")).collect()}
    assert sorted(parsed) == ["a", "b", "c", "e"]  # d has neither deals nor leaflets
    assert [d.product for d in parsed["c"].deals] == ["T", "U"] and parsed["c"].deals[1].promo_price is None
    assert (parsed["b"].methods, parsed["b"].folders[0].pages[0].image_url, parsed["e"].deals) == (["pdf", "pdf-text"], "/p.png", [])
    assert parsed["a"].source_urls == ["https://x/1", "https://x/2", "https://x/3"] and parsed["a"].scraped_at == "2024-01-31T00:00:00.000Z"
    # the same harvest an hour later changes no document
    later = hv.harvest_documents(hv.harvested(deals, visits, "2024-01-31 01:00:00"), leaflets, visits, "2024-01-31 01:00:00")
    assert doc_changed(docs, later.select("slug", "raw")).filter("changed").count() == 0
    out = str(tmp_path / "docs")
    sinks.write_folder_docs(docs.withColumn("changed", F.lit(True)), out)
    assert read_folder_docs(spark, out, layout="written").count() == 4
    names = spark.createDataFrame([("b", "Shop B")], "slug string, name string")
    path = str(tmp_path / "products")
    rows = products.keyed_rows(hv.harvest_products(found, visits, leaflets, names, "general"), NOW)
    product_store.append_version(rows, path, 0)
    stored = {r.product_name: r for r in read_products(spark, path).collect()}
    assert sorted(stored) == ["L", "P", "T", "U"]
    b = stored["L"]
    assert (b.retailer_name, b.folder_title, b.source_method, b.source_url, b.description, b.year, b.week_number) == ("Shop B", "Leaflet b", "pdf-text", "https://x/1", "about L", 2024, 5)
