"""Deal extraction from text, JSON-LD, cards and card texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prices import parse_price as price_of
from ..operators import deals as dl
from ..operators import page_deals as pg
from ..operators import text_deals as td
from ..streaming.folders import stored_once
from .registry import query

EURO = "€\\s*(\\d+[.,]\\d{2})"
NEAR = "(?i)-?\\d+\\s*%|[123]\\s*\\+\\s*[123]|gratis|korting|réduction"
ONLY = "(?i)-\\d+\\s*%|\\d+\\s*\\+\\s*\\d+\\s*gratis|[234]e?\\s*(halve\\s*prijs|gratis)|koop\\s*\\d+\\s*betaal"
NAKED = "\\b\\d{1,3}[.,]\\d{2}\\b"


def clean_sql(text: str) -> str:
    bare = f"regexp_replace(regexp_replace({text}, '{EURO}', '', 'g'), '{NAKED}', '', 'g')"
    bare = f"regexp_replace({bare}, '(?i)^(per\\s*(stuk|kg|liter|l)|vanaf|nu|nieuw|actie|promo|van)\\s*', '')"
    return f"trim(regexp_replace(regexp_replace({bare}, '^[^a-zA-Z0-9À-ÿ]+', ''), '[^a-zA-Z0-9À-ÿ]+$', ''))"


def lines_sql(docs: str) -> str:
    """CTEs that end in ``kept``: the lines of ``docs`` with their neighbours."""
    return f"""numbered AS (SELECT row_number() OVER () AS rid, *, string_split(text, chr(10)) AS parts FROM {docs}),
      lines AS (SELECT rid, doc_id, retailer_slug, trim(unnest(parts)) AS line, generate_subscripts(parts, 1) AS pos FROM numbered),
      kept AS (SELECT rid, doc_id, retailer_slug, line, CAST(row_number() OVER w - 1 AS INTEGER) AS i, lag(line) OVER w AS prev, lead(line) OVER w AS next
        FROM lines WHERE length(line) > 2 WINDOW w AS (PARTITION BY rid ORDER BY pos))"""


def _numbers(pattern: str, group: int, line: str = "line") -> str:
    return f"[CAST(replace(x, ',', '.') AS DOUBLE) FOR x IN regexp_extract_all({line}, '{pattern}', {group})]"


_OWN_EURO = f"trim(regexp_replace(regexp_replace(line, '{EURO}', '', 'g'), '\\d+[.,]\\d{{2}}', '', 'g'))"
_OWN_NAKED = f"trim(regexp_replace(line, '{NAKED}', '', 'g'))"


def blocks_sql(docs: str) -> str:
    """CTEs that end in ``blocks``: what each line says."""
    own_or_prev = "CASE WHEN length({own}) < 3 AND prev IS NOT NULL THEN prev ELSE {own} END"
    return f"""{lines_sql(docs)},
      sorted AS (SELECT *, CASE WHEN regexp_matches(line, '{EURO}') THEN 'euro_price' WHEN regexp_matches(line, '{ONLY}') THEN 'discount_only'
          WHEN len(regexp_extract_all(line, '{NAKED}')) >= 2 THEN 'naked_price' END AS kind FROM kept),
      blocks AS (SELECT * FROM (SELECT rid, doc_id, retailer_slug, i, kind,
          CASE kind WHEN 'euro_price' THEN {clean_sql(own_or_prev.format(own=_OWN_EURO))}
            WHEN 'discount_only' THEN {clean_sql("coalesce(prev, '')")}
            WHEN 'naked_price' THEN {clean_sql(own_or_prev.format(own=_OWN_NAKED))} END AS product,
          CASE kind WHEN 'euro_price' THEN CASE WHEN len({_numbers(EURO, 1)}) > 1 THEN list_max({_numbers(EURO, 1)}) END
            WHEN 'naked_price' THEN list_max({_numbers(NAKED, 0)}) END AS original_price,
          CASE kind WHEN 'euro_price' THEN list_min({_numbers(EURO, 1)}) WHEN 'naked_price' THEN list_min({_numbers(NAKED, 0)}) END AS promo_price,
          CASE kind WHEN 'euro_price' THEN nullif(trim(coalesce(nullif(regexp_extract(line, '{NEAR}'), ''), regexp_extract(next, '{NEAR}'))), '')
            WHEN 'discount_only' THEN trim(regexp_extract(line, '{ONLY}')) END AS discount
        FROM sorted) WHERE length(product) >= 3)"""


def deals_sql(docs: str) -> str:
    """CTEs that end in ``text_deals``."""
    return f"""{blocks_sql(docs)},
      text_deals AS (SELECT doc_id, retailer_slug, retailer_slug || '-pdf-' || (row_number() OVER (PARTITION BY rid ORDER BY i) - 1) AS id,
        product, original_price, promo_price, discount FROM blocks
        WHERE coalesce(promo_price, 0) <> 0 OR coalesce(original_price, 0) <> 0 OR discount IS NOT NULL)"""


@query("text_lines", f"WITH {lines_sql('deal_text')} SELECT doc_id, retailer_slug, i, line, prev, next FROM kept")
def text_lines(t):
    return td.text_lines(t.dealt("deal_text", "lineitem"))


@query(
    "text_lines_documents",
    """WITH numbered AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
         lines AS (SELECT doc_id, trim(unnest(parts)) AS line FROM numbered)
       SELECT doc_id, count(*) AS lines, max(length(line)) AS longest FROM lines WHERE length(line) > 2 GROUP BY doc_id""",
)
def text_lines_documents(t):
    lines = td.text_lines(t.documents.select("doc_id", "text"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("line")).cast("bigint").alias("longest"))


BLOCK_SQL = f"WITH {blocks_sql('deal_text')} SELECT doc_id, retailer_slug, i, kind, product, original_price, promo_price, discount FROM blocks"


@query("euro_price_deals", BLOCK_SQL + " WHERE kind = 'euro_price'")
def euro_price_deals(t):
    return td.euro_price_deals(td.text_lines(t.dealt("deal_text", "lineitem")))


@query("discount_only_deals", BLOCK_SQL + " WHERE kind = 'discount_only'")
def discount_only_deals(t):
    return td.discount_only_deals(td.text_lines(t.dealt("deal_text", "lineitem")))


@query("naked_price_deals", BLOCK_SQL + " WHERE kind = 'naked_price'")
def naked_price_deals(t):
    return td.naked_price_deals(td.text_lines(t.dealt("deal_text", "lineitem")))


@query(
    "clean_product_name",
    f"""SELECT page_id, name, {clean_sql('name')} AS cleaned FROM (SELECT p_partkey AS page_id,
          CASE p_partkey % 4 WHEN 0 THEN 'Per stuk ' WHEN 1 THEN 'VANAF ' WHEN 2 THEN '** van ' ELSE '€ 3,99 nieuw ' END || p_name || ' 12.50 - ' || p_type || ' €1,20 !' AS name FROM part)""",
)
def clean_product_name(t):
    name = F.expr(
        "CASE p_partkey % 4 WHEN 0 THEN 'Per stuk ' WHEN 1 THEN 'VANAF ' WHEN 2 THEN '** van ' ELSE '€ 3,99 nieuw ' END"
        " || p_name || ' 12.50 - ' || p_type || ' €1,20 !'"
    )
    named = t.part.select(F.col("p_partkey").alias("page_id"), name.alias("name"))
    return named.withColumn("cleaned", td.clean_product_name(F.col("name")))


@query("text_deals", f"WITH {deals_sql('deal_text')} SELECT * FROM text_deals")
def text_deals(t):
    return td.text_deals(t.dealt("deal_text", "lineitem"))


GATE_SQL = f"""catalogues AS (SELECT * FROM (SELECT doc_id, retailer_slug, string_agg(text, chr(10) ORDER BY page_no) AS text
    FROM leaflet_pages GROUP BY doc_id, retailer_slug) WHERE len(regexp_extract_all(text, '{EURO}')) >= 2)"""


@query("catalogue_gate", f"WITH {GATE_SQL} SELECT doc_id, retailer_slug, text FROM catalogues")
def catalogue_gate(t):
    return td.catalogue_gate(t.dealt("leaflet_pages", "lineitem"), ["doc_id", "retailer_slug"])


@query("leaflet_deals", f"WITH {GATE_SQL}, {deals_sql('catalogues')} SELECT * FROM text_deals")
def leaflet_deals(t):
    return td.text_deals(td.catalogue_gate(t.dealt("leaflet_pages", "lineitem"), ["doc_id", "retailer_slug"]))


LD_SQL = """ld_deals AS (
    SELECT page_id, retailer_slug, 'jsonld-0' AS id, json_extract_string(doc, '$.name') AS product, try_cast(json_extract_string(doc, '$.offers.highPrice') AS DOUBLE) AS original_price,
      try_cast(json_extract_string(doc, '$.offers.price') AS DOUBLE) AS promo_price
    FROM ld WHERE json_extract_string(doc, '$."@type"') = 'Product'
    UNION ALL SELECT page_id, retailer_slug, 'jsonld-0', 'Unknown', NULL, try_cast(json_extract_string(doc, '$[0].price') AS DOUBLE) FROM ld WHERE json_extract_string(doc, '$[0]."@type"') = 'Offer'
    UNION ALL SELECT page_id, retailer_slug, 'jsonld-0', json_extract_string(doc, '$.itemListElement[0].item.name'), NULL, try_cast(json_extract_string(doc, '$.itemListElement[0].item.offers.price') AS DOUBLE)
    FROM ld WHERE json_extract_string(doc, '$."@type"') = 'ItemList'
    UNION ALL SELECT page_id, retailer_slug, 'jsonld-1', json_extract_string(doc, '$.itemListElement[1].name'), NULL, try_cast(json_extract_string(doc, '$.itemListElement[1].price') AS DOUBLE)
    FROM ld WHERE json_extract_string(doc, '$."@type"') = 'ItemList')"""
LD_BLOCKS_SQL = """ld AS (SELECT page_id, retailer_slug, doc FROM (
    SELECT page_id, retailer_slug, try_cast(regexp_extract(html, '<script type="application/ld\\+json">(.*?)</script>', 1) AS JSON) AS doc FROM ld_pages) WHERE doc IS NOT NULL)"""


@query(
    "jsonld_deals",
    f"WITH {LD_BLOCKS_SQL}, {LD_SQL} SELECT page_id, retailer_slug, id, product, original_price, promo_price, NULL::VARCHAR AS discount FROM ld_deals",
)
def jsonld_deals(t):
    return pg.jsonld_deals(t.dealt("ld_pages", "part")).drop("description", "image_url")


# One card layout for all test retailers.
SELECTORS = {
    "card": ".product-card, article", "name": "h3, h4", "original_price": "del, s", "promo_price": '[class*="price-now"]',
    "discount": '[class*="badge"]', "description": ".desc", "image": 'img[src*="product"], img[class*="product"]',
}
CARD_RULES = {f"s{n}": SELECTORS for n in range(30)}

CARD_SQL = """card_deals AS (
    SELECT p_partkey AS page_id, 's' || (p_partkey % 30) AS retailer_slug, 'html-0' AS id, trim(p_name) AS product, p_size + 0.9::DOUBLE AS original_price,
      p_size + 0.5::DOUBLE AS promo_price, '-' || p_size || '%' AS discount, NULL AS description, '/i/product/' || p_partkey || '.png' AS image_url FROM part
    UNION ALL SELECT p_partkey, 's' || (p_partkey % 30), 'html-1', p_brand || '& co', 1.299, NULL, NULL, p_type, '/lazy.png' FROM part)"""


@query("card_deals", f"WITH {CARD_SQL} SELECT *, NULL::VARCHAR AS category FROM card_deals")
def card_deals(t):
    return pg.card_deals(t.dealt("card_pages", "part"), CARD_RULES)


@query(
    "parse_price",
    """SELECT p_partkey, raw, try_cast(regexp_extract(regexp_replace(regexp_replace(raw, '[^\\d.,]', '', 'g'), ',', '.'), '^(\\d+\\.?\\d*|\\.\\d+)') AS DOUBLE) AS price
       FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'EUR 1.299,00' WHEN 1 THEN '€ ' || p_size || ',50 nu' WHEN 2 THEN 'gratis' WHEN 3 THEN ',5' ELSE p_size || ' voor 1,2,3' END AS raw FROM part)""",
)
def parse_price(t):
    raw = F.expr(
        "CASE p_partkey % 5 WHEN 0 THEN 'EUR 1.299,00' WHEN 1 THEN '€ ' || p_size || ',50 nu' WHEN 2 THEN 'gratis' WHEN 3 THEN ',5' ELSE p_size || ' voor 1,2,3' END"
    )
    return t.part.select("p_partkey", raw.alias("raw")).withColumn("price", price_of(F.col("raw")))


# The layout of the card texts is known: of five cards one repeats the first one's name in capitals and one is too short to name anything.
PAGE_TEXT_SQL = """page_text AS (
    SELECT page_id, retailer_slug, 'pagetext-0' AS id, name AS product, CASE WHEN price <> 2.5 THEN greatest(price, 2.5::DOUBLE) END AS original_price,
      least(price, 2.5::DOUBLE) AS promo_price, '-10%' AS discount FROM parts
    UNION ALL SELECT page_id, retailer_slug, 'pagetext-1', p_brand || ' extra', NULL, 0.0, NULL FROM parts
    UNION ALL SELECT page_id, retailer_slug, 'pagetext-2', p_type || ' set 1+1', 60000.0, 4.0, '1+1' FROM parts),"""
PARTS_SQL = "parts AS (SELECT p_partkey AS page_id, 's' || (p_partkey % 60) AS retailer_slug, p_name AS name, p_brand, p_type, p_size + 0.99::DOUBLE AS price FROM part)"


@query(
    "page_text_deals",
    f"""WITH {PARTS_SQL}, {PAGE_TEXT_SQL.rstrip(',')} SELECT * FROM page_text""",
)
def page_text_deals(t):
    return pg.page_text_deals(t.dealt("card_texts", "part"))


@query(
    "card_text_scan",
    """SELECT p_partkey AS page_id, 's' || (p_partkey % 30) AS retailer_slug,
         [' ' || p_name || ' € ' || p_size || ',90€ ' || p_size || ',50-' || p_size || '%', '  € 5,00'] AS cards FROM part""",
)
def card_text_scan(t):
    return pg.card_texts(t.dealt("card_pages", "part"))


def _fallback_stages(t):
    primary = pg.jsonld_deals(t.dealt("ld_pages", "part")).unionByName(pg.card_deals(t.dealt("card_pages", "part"), CARD_RULES), allowMissingColumns=True)
    primary = primary.select("*", F.lit("html").alias("method"), F.lit(0).cast("bigint").alias("page_no"))
    primary = stored_once(primary, "primary")
    done = stored_once(primary.select("retailer_slug").distinct(), "done")
    leaflets = td.catalogue_gate(dl.without_deals(t.dealt("leaflet_pages", "lineitem"), done), ["doc_id", "retailer_slug"])
    pdf = td.text_deals(leaflets).select("*", F.lit("pdf-text").alias("method"), F.lit(0).cast("bigint").alias("page_no"))
    text = pg.page_text_deals(dl.without_deals(t.dealt("card_texts", "part"), done)).select("*", F.lit("page-text").alias("method"), F.col("page_id").alias("page_no"))
    return primary, pdf, text


FALLBACK_SQL = f"""{LD_BLOCKS_SQL}, {LD_SQL}, {CARD_SQL}, {GATE_SQL}, {deals_sql('catalogues')},
    {PARTS_SQL},
    {PAGE_TEXT_SQL}
    first_stage AS (SELECT retailer_slug, 'html' AS method, 0::BIGINT AS page_no, product, original_price, promo_price, NULL::VARCHAR AS discount FROM ld_deals
      UNION ALL SELECT retailer_slug, 'html', 0, product, original_price, promo_price, discount FROM card_deals),
    second_stage AS (SELECT retailer_slug, 'pdf-text', 0::BIGINT, product, original_price, promo_price, discount FROM text_deals
      WHERE retailer_slug NOT IN (SELECT retailer_slug FROM first_stage)),
    third_stage AS (SELECT retailer_slug, 'page-text', page_id, product, original_price, promo_price, discount FROM page_text
      WHERE retailer_slug NOT IN (SELECT retailer_slug FROM first_stage) AND retailer_slug NOT IN (SELECT retailer_slug FROM text_deals)
      QUALIFY page_id = min(page_id) OVER (PARTITION BY retailer_slug)),
    fallback AS (SELECT * FROM first_stage UNION ALL SELECT * FROM second_stage UNION ALL SELECT * FROM third_stage)"""


@query("extraction_fallback", f"WITH {FALLBACK_SQL} SELECT * FROM fallback")
def extraction_fallback(t):
    shown = ["retailer_slug", "method", "page_no", "product", "original_price", "promo_price", "discount"]
    return dl.extraction_fallback(*_fallback_stages(t)).select(*shown)


@query(
    "extraction_methods",
    f"WITH {FALLBACK_SQL} SELECT retailer_slug, list(DISTINCT method) AS methods FROM fallback GROUP BY retailer_slug",
)
def extraction_methods(t):
    deals = dl.extraction_fallback(*_fallback_stages(t))
    return dl.extraction_methods(deals, {"html": 0, "pdf-text": 1, "page-text": 2})
