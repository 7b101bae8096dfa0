"""Work that costs much per row runs in as many tasks as the session shuffles into, however few splits its table has."""

import pytest

from dealtide.operators import text_deals
from dealtide.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name", ["card_text_scan", "card_deals", "jsonld_deals", "page_text_deals", "viewer_page_urls", "text_lines", "euro_price_deals", "text_deals", "pick_embed"]
)
def test_one_file_feeds_all_tasks(spark, name):
    held = QUERIES[name](spark, SMALL).rdd.glom().map(len).collect()
    assert sum(n > 0 for n in held) == 8


def test_blocks_by_kind_are_the_blocks(spark):
    """Dropping the lines of other kinds first changes no block."""
    text = "Kaas jong\n€ 3,99 €5.00\n-20% korting\nMelk 1,00 2,00\nkoop 2 betaal 1\nBrood € 2,50 gratis"
    lines = text_deals.text_lines(spark.createDataFrame([(1, "s1", text)], "doc_id int, retailer_slug string, text string"))
    whole = sorted(map(tuple, text_deals.line_blocks(lines).collect()), key=str)
    parts = [text_deals.euro_price_deals(lines), text_deals.discount_only_deals(lines), text_deals.naked_price_deals(lines)]
    assert whole and sorted([tuple(r) for part in parts for r in part.collect()], key=str) == whole


@pytest.mark.parametrize("name", ["catalogue_gate", "leaflet_deals"])
def test_leaflets_are_gathered_in_a_stated_number_of_parts(spark, name):
    """AQE goes by compressed bytes and would join the parts of short lines into few large ones."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "REPARTITION_BY_NUM" in plan
