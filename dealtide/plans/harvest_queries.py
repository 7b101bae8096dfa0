"""The way from captures to documents and product history over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import harvest as hv
from ..operators import page_deals as pg
from ..operators import products as pr
from ..operators import text_deals as td
from ..operators.deals import without_deals
from ..sources.documents import parse_docs
from ..streaming.folders import stored_once
from .extract_queries import CARD_RULES, CARD_SQL, GATE_SQL, LD_BLOCKS_SQL, LD_SQL, PAGE_TEXT_SQL, PARTS_SQL, deals_sql
from .product_queries import PROMO_TYPE_SQL, SHOWN
from .registry import query
from .views import AS_OF

# Which page meets a bot challenge: of the product pages some, of the text pages others.
CHALLENGED = {hv.PRIMARY: (61, 5), hv.PAGE_TEXT: (59, 51)}

VISITS_SQL = """visits AS (
    SELECT 's' || (p_partkey % 30) AS retailer_slug, 0 AS stage, p_partkey AS page_no, p_partkey % 61 = 5 AS challenged FROM part
    UNION ALL SELECT 's' || (p_partkey % 60), 2, p_partkey, p_partkey % 59 = 51 FROM part),
  stops AS (SELECT retailer_slug, stage, min(page_no) AS stop FROM visits WHERE challenged GROUP BY ALL)"""

HARVEST_SQL = f"""{VISITS_SQL}, {LD_BLOCKS_SQL}, {LD_SQL}, {CARD_SQL}, {GATE_SQL}, {deals_sql('catalogues')}, {PARTS_SQL}, {PAGE_TEXT_SQL}
  staged AS (
    SELECT retailer_slug, 0 AS stage, 'html' AS method, page_id AS page_no, 0 AS rank, id, product, original_price, promo_price, discount, description, NULL::VARCHAR AS category, image_url FROM card_deals
    UNION ALL SELECT retailer_slug, 0, 'html', page_id, 1, id, product, original_price, promo_price, NULL, NULL, NULL, NULL FROM ld_deals
    UNION ALL SELECT retailer_slug, 1, 'pdf-text', doc_id, 0, id, product, original_price, promo_price, discount, NULL, NULL, NULL FROM text_deals
    UNION ALL SELECT retailer_slug, 2, 'page-text', page_id, 0, id, product, original_price, promo_price, discount, NULL, NULL, NULL FROM page_text),
  passed AS (SELECT staged.* FROM staged LEFT JOIN stops USING (retailer_slug, stage) WHERE stop IS NULL OR page_no < stop),
  least AS (SELECT retailer_slug, min(stage) AS stage FROM passed GROUP BY ALL),
  opening AS (SELECT retailer_slug, min(page_no) AS page_no FROM passed WHERE stage = 2 GROUP BY ALL),
  harvest AS (
    SELECT p.* FROM passed p JOIN least USING (retailer_slug, stage) LEFT JOIN opening o USING (retailer_slug) WHERE p.stage < 2 OR p.page_no = o.page_no
    QUALIFY row_number() OVER (PARTITION BY lower(trim(product)), promo_price, retailer_slug
      ORDER BY p.page_no, rank, CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER), id, original_price NULLS FIRST, discount NULLS FIRST) = 1)"""


def visits_of(t):
    page = F.col("p_partkey")

    def visit(stage: int, retailers: int):
        n, rest = CHALLENGED[stage]
        slug = F.concat(F.lit("s"), (page % retailers).cast("string"))
        url = F.concat(F.lit("https://shop.example.com/"), page.cast("string"))
        return t.part.select(slug.alias("retailer_slug"), F.lit(stage).alias("stage"), page.alias("page_no"), (page % n == rest).alias("challenged"), url.alias("url"))

    return visit(hv.PRIMARY, 30).unionAll(visit(hv.PAGE_TEXT, 60))


def harvest_of(t):
    """Primary deals are extracted and stored first; of the leaflets and page texts only those of retailers without any are read."""
    visits = visits_of(t)
    deals = hv.stage_deals(pg.card_deals(t.dealt("card_pages", "part"), CARD_RULES), hv.PRIMARY, "html", "page_id")
    deals = deals.unionByName(hv.stage_deals(pg.jsonld_deals(t.dealt("ld_pages", "part")), hv.PRIMARY, "html", "page_id", rank=1))
    deals = stored_once(hv.before_challenges(deals, visits), "primary")
    done = stored_once(deals.select("retailer_slug").distinct(), "done")
    leaflets = td.catalogue_gate(without_deals(t.dealt("leaflet_pages", "lineitem"), done), ["doc_id", "retailer_slug"])
    deals = deals.unionByName(hv.stage_deals(td.text_deals(leaflets), hv.LEAFLET_TEXT, "pdf-text", "doc_id"))
    deals = deals.unionByName(hv.stage_deals(pg.page_text_deals(without_deals(t.dealt("card_texts", "part"), done)), hv.PAGE_TEXT, "page-text", "page_id"))
    return hv.harvested(deals, visits, AS_OF)


def folders_of(t):
    """A leaflet for every other retailer."""
    now = F.to_timestamp_ntz(F.lit(AS_OF))
    return t.retailers.filter("substring(slug, 2) % 2 = 0").select(
        F.concat("slug", F.lit("-folder")).alias("id"), F.col("slug").alias("retailer_slug"), F.concat("name", F.lit(" folder")).alias("title"),
        F.to_date(F.lit("2024-01-29")).alias("valid_from"), F.to_date(F.lit("2024-02-04")).alias("valid_until"), F.lit(0).alias("page_count"), F.lit("").alias("thumbnail_url"),
        F.array().cast("array<struct<page_number:int,image_url:string>>").alias("pages"), F.lit(None).cast("string").alias("embed_url"),
        F.lit("https://cdn.example.com/f.pdf").alias("pdf_url"), F.lit("pdf").alias("content_source"), now.alias("scraped_at"),
    )


@query(
    "harvested",
    f"""WITH {HARVEST_SQL} SELECT retailer_slug, stage, method, page_no, rank, id, product, original_price, promo_price, discount, description, category, image_url,
        DATE '2024-01-29' AS valid_from, DATE '2024-02-04' AS valid_until FROM harvest""",
)
def harvested(t):
    shown = ["retailer_slug", "stage", "method", "page_no", "rank", *[c for c in hv.FIELDS if c != "affiliate_url"], "valid_from", "valid_until"]
    return harvest_of(t).select(*shown)


@query(
    "harvest_products",
    f"""WITH {HARVEST_SQL}, rows AS (
          SELECT retailer_slug, 'general' AS vertical, product AS product_name, description, harvest.category, original_price, promo_price, discount AS discount_label,
            {PROMO_TYPE_SQL} AS promo_type, DATE '2024-01-29' AS valid_from, DATE '2024-02-04' AS valid_until, 5 AS week_number, 2024 AS year,
            TIMESTAMP '2024-01-31' AS scraped_at, image_url, method AS source_method,
            'https://shop.example.com/' || (SELECT min(page_no) FROM visits v WHERE v.retailer_slug = harvest.retailer_slug AND v.stage = (SELECT min(stage) FROM visits x WHERE x.retailer_slug = harvest.retailer_slug)) AS source_url,
            coalesce(r.name, retailer_slug) AS retailer_name, CASE WHEN CAST(substr(r.slug, 2) AS INTEGER) % 2 = 0 THEN r.name || ' folder' END AS folder_title,
            row_number() OVER (PARTITION BY retailer_slug, product, coalesce(promo_price, -1) ORDER BY page_no, rank, id) AS first_n,
            row_number() OVER (PARTITION BY retailer_slug, product, coalesce(promo_price, -1) ORDER BY page_no DESC, rank DESC, id DESC) AS last_n
          FROM harvest LEFT JOIN retailers r ON r.slug = retailer_slug)
        SELECT * EXCLUDE (first_n, last_n) FROM rows WHERE first_n = 1 AND last_n = 1""",
)
def harvest_products(t):
    deals = hv.harvest_products(stored_once(harvest_of(t), "harvest"), visits_of(t), folders_of(t), t.retailers, "general")
    rows = pr.upsert_products(None, pr.keyed_rows(deals, AS_OF))
    return rows.select(*SHOWN, "image_url", "source_method", "source_url", "retailer_name", "folder_title")


@query(
    "harvest_documents",
    f"""WITH {HARVEST_SQL}, own AS (SELECT retailer_slug AS slug, count(*) AS deals, min(product) AS least_product, round(sum(promo_price), 2) AS promo_total, any_value(method) AS method FROM harvest GROUP BY ALL),
        held AS (SELECT slug FROM retailers WHERE CAST(substr(slug, 2) AS INTEGER) % 2 = 0)
        SELECT slug, coalesce(deals, 0) AS deals, least_product, promo_total, CASE WHEN held.slug IS NULL THEN 0 ELSE 1 END AS folders,
          concat_ws(',', CASE WHEN held.slug IS NOT NULL THEN 'pdf' END, method) AS methods, '2024-01-31T00:00:00.000Z' AS scraped_at FROM own FULL JOIN held USING (slug)""",
)
def harvest_documents(t):
    """The documents read back from their JSON text."""
    docs = parse_docs(hv.harvest_documents(stored_once(harvest_of(t), "harvest"), folders_of(t), visits_of(t), AS_OF).select("slug", "raw"))
    products = F.transform("deals", lambda d: d["product"])
    total = F.aggregate("deals", F.lit(0.0), lambda s, d: s + F.coalesce(d["promo_price"], F.lit(0.0)))
    return docs.select(
        "slug", F.size("deals").cast("long").alias("deals"), F.array_min(products).alias("least_product"),
        F.when(F.size("deals") > 0, F.round(total, 2)).alias("promo_total"), F.size("folders").alias("folders"), F.array_join("methods", ",").alias("methods"), "scraped_at",
    )
