"""Deals from leaflet text.

A document is one row: its lines become an array, neighbours come from shifted copies of that array,
and the rules run over the array elements. Nothing is shuffled, however long or frequent a document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import unnest
from ..functions.prices import EURO_PRICE, PLAIN_PRICE, numbers_in
from ..functions.text import CASELESS, SPACE, WORD_END, WORD_START, erase, first_match, longer_than, strip

# Wording of discounts and of words that precede a name.
NEAR_DISCOUNT = rf"{CASELESS}-?\d+{SPACE}*%|[123]{SPACE}*\+{SPACE}*[123]|gratis|korting|r[éÉ]duction"
ONLY_DISCOUNT = (
    rf"{CASELESS}-\d+{SPACE}*%|\d+{SPACE}*\+{SPACE}*\d+{SPACE}*gratis"
    rf"|[234]e?{SPACE}*(?:halve{SPACE}*prijs|gratis)|koop{SPACE}*\d+{SPACE}*betaal"
)
NAKED_PRICE = rf"{WORD_START}\d{{1,3}}[.,]\d{{2}}{WORD_END}"
LEADING_NOISE = rf"{CASELESS}^(?:per{SPACE}*(?:stuk|kg|liter|l)|vanaf|nu|nieuw|actie|promo|van){SPACE}*"
CORE = r"(?s)[a-zA-Z0-9À-ÿ](?:.*[a-zA-Z0-9À-ÿ])?"
MAX_PAGES = 12


def clean_product_name(name: Column) -> Column:
    """Without prices, one leading noise word, and signs at either end."""
    priced = F.contains(name, F.lit(",")) | F.contains(name, F.lit("."))
    bare = F.when(priced, erase(erase(name, EURO_PRICE), NAKED_PRICE)).otherwise(name)
    # From the first letter or digit to the last one; empty when there is none.
    return F.regexp_extract(erase(bare, LEADING_NOISE), CORE, 0)


def line_array(text: Column) -> Column:
    """Trimmed lines of more than two characters."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: longer_than(line, 2))


def neighbour_array(lines: Column) -> Column:
    """Each line with the one before and the one after it; one more entry, without a line, closes the array."""
    before = F.concat(F.array(F.lit(None).cast("string")), lines)
    after = F.slice(lines, 2, F.size(lines))
    return F.arrays_zip(lines.alias("line"), before.alias("prev"), after.alias("next"))


def _with_neighbours(docs: DataFrame) -> DataFrame:
    split = docs.withColumn("_lines", line_array(F.col("text")))
    return split.withColumn("_near", neighbour_array(F.col("_lines")))


def text_lines(docs: DataFrame) -> DataFrame:
    """One row per kept line: its index from 0 and its neighbours."""
    kept = [c for c in docs.columns if c != "text"]
    rows = unnest(_with_neighbours(docs), kept, F.col("_near"), "_at", "i")
    return rows.filter(F.col("_at.line").isNotNull()).select(*kept, "i", "_at.line", "_at.prev", "_at.next")


def _kind(line: Column) -> Column:
    """Which rule a line falls under: the first that applies uses the line up, null for none."""
    return (
        F.when(line.rlike(EURO_PRICE), "euro_price")
        .when(line.rlike(ONLY_DISCOUNT), "discount_only")
        .when(F.regexp_count(line, F.lit(NAKED_PRICE)) >= 2, "naked_price")
    )


def block_array(near: Column) -> Column:
    """What the lines of a document say: kind, index, name, prices and discount of each line that says something.

    * euro prices: two or more give original and promo price, one the promo price; the discount stands
      on the line or on the next one;
    * a discount phrase without a euro price: the name is the line before;
    * two or more prices without a sign.

    The name is the line without its prices, or the line before if that leaves less than three
    characters. Built in steps, each of which computes its values once per line.
    """
    kinds = F.filter(
        F.transform(near, lambda at, i: F.struct(i.alias("i"), _kind(at["line"]).alias("kind"), at.alias("at"))),
        lambda e: e["kind"].isNotNull(),
    )

    def read(e: Column) -> Column:
        kind, line = e["kind"], e["at"]["line"]
        own = F.when(kind == "euro_price", strip(erase(erase(line, EURO_PRICE), PLAIN_PRICE))).when(
            kind == "naked_price", strip(erase(line, NAKED_PRICE))
        )
        prices = F.when(kind == "euro_price", numbers_in(line, EURO_PRICE)).when(
            kind == "naked_price", numbers_in(line, NAKED_PRICE, 0)
        )
        discount = F.when(
            kind == "euro_price", F.coalesce(first_match(line, NEAR_DISCOUNT), first_match(e["at"]["next"], NEAR_DISCOUNT))
        ).when(kind == "discount_only", first_match(line, ONLY_DISCOUNT))
        return F.struct(
            e["i"].alias("i"), kind.alias("kind"), F.coalesce(own, F.lit("")).alias("own"),
            e["at"]["prev"].alias("prev"), prices.alias("prices"), strip(discount).alias("discount"),
        )

    def source(e: Column) -> Column:
        text = F.when(longer_than(e["own"], 2), e["own"]).otherwise(F.coalesce(e["prev"], e["own"]))
        return F.struct(
            e["i"].alias("i"), e["kind"].alias("kind"), text.alias("source"), e["prices"].alias("prices"),
            e["discount"].alias("discount"),
        )

    def block(e: Column) -> Column:
        return F.struct(
            e["kind"].alias("kind"), e["i"].alias("i"), clean_product_name(e["source"]).alias("product"),
            F.when(F.size(e["prices"]) >= 2, F.array_max(e["prices"])).alias("original_price"),
            F.array_min(e["prices"]).alias("promo_price"), e["discount"].alias("discount"),
        )

    read_all = F.transform(F.transform(kinds, read), source)
    return F.filter(F.transform(read_all, block), lambda b: longer_than(b["product"], 2))


def line_blocks(lines: DataFrame) -> DataFrame:
    """Blocks found in the rows of ``text_lines``."""
    kept = [c for c in lines.columns if c not in ("line", "prev", "next")]
    found = unnest(lines, kept, block_array(F.array(F.struct("line", "prev", "next"))), "_block")
    return found.select(*kept, "_block.kind", "_block.product", "_block.original_price", "_block.promo_price", "_block.discount")


def _blocks_of(lines: DataFrame, kind: str) -> DataFrame:
    """The blocks of one kind; lines of other kinds are dropped before they are read."""
    return line_blocks(lines.filter(_kind(F.col("line")) == kind)).filter(F.col("kind") == kind)


def euro_price_deals(lines: DataFrame) -> DataFrame:
    return _blocks_of(lines, "euro_price")


def discount_only_deals(lines: DataFrame) -> DataFrame:
    return _blocks_of(lines, "discount_only")


def naked_price_deals(lines: DataFrame) -> DataFrame:
    return _blocks_of(lines, "naked_price")


def _useful(block: Column) -> Column:
    def priced(field: str) -> Column:
        return F.coalesce(block[field] != 0, F.lit(False))

    return priced("promo_price") | priced("original_price") | block["discount"].isNotNull()


def text_deals(docs: DataFrame) -> DataFrame:
    """Deals of each document with ids ``retailer-pdf-n``, n counting the deals of the document from 0.

    ``docs``: retailer_slug, text and any further columns, which are kept.
    """
    kept = [c for c in docs.columns if c != "text"]
    deals = unnest(_with_neighbours(docs), kept, F.filter(block_array(F.col("_near")), _useful), "_deal")
    deal_id = F.concat_ws("-", F.col("retailer_slug"), F.lit("pdf"), F.col("_n").cast("string"))
    return deals.select(
        *kept, deal_id.alias("id"), "_deal.product", "_deal.original_price", "_deal.promo_price", "_deal.discount"
    )


def catalogue_gate(pages: DataFrame, by: list[str], max_pages: int | None = None) -> DataFrame:
    """Documents that look like a catalogue: at least two euro prices in all their pages, or in the first ``max_pages``.

    ``pages``: the ``by`` columns, page_no (unique in a document) and text. Pages past the last one are
    dropped before the shuffle, and copies of a page are reduced to one before pages are listed.
    """
    taken = pages if max_pages is None else pages.filter(F.col("page_no").between(1, max_pages))
    single = taken.groupBy(*by, "page_no").agg(F.min("text").alias("text"))
    listed = single.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("_pages"))
    docs = listed.select(*by, F.array_join(F.col("_pages.text"), "\n").alias("text"))
    return docs.filter(F.regexp_count("text", F.lit(EURO_PRICE)) >= 2)


def page_text(items: Column) -> Column:
    """Text of a page from its text items."""
    return F.array_join(items, " ", "")
