"""Deals from web pages: JSON-LD blocks, product cards by selector, and the text of product cards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import unnest
from ..functions.markup import parse_html, select, text_of
from ..functions.prices import EURO_PRICE, number_prefix, numbers_in, parse_price
from ..functions.text import (
    CASELESS, SPACE, WORD_END, WORD_START, erase, first_match, longer_than, strip, utf16_head, utf16_length,
)

LD_BLOCK = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def _text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _given(value: Column, path: str) -> Column:
    """The value at ``path`` as text if it counts as given: not null, empty, zero or false."""
    text = _text_at(value, path)
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    zero = ~kind.isin("STRING") & text.try_cast("double").eqNullSafe(F.lit(0.0))
    return F.when((text != "") & ~zero & ~((kind == "BOOLEAN") & (text == "false")), text)


def _as_list(value: Column) -> Column:
    """The elements of an array; anything else as its own single element."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))


def _object(value: Column, path: str) -> Column:
    """The variant at ``path`` unless it is absent or a JSON null."""
    inner = F.try_variant_get(value, path, "variant")
    return F.when(inner.isNotNull() & ~F.is_variant_null(inner), inner)


def _ld_candidates(block: Column) -> Column:
    """The things one JSON-LD block may offer, in page order, as (product, offer, listed).

    Reading a block stops at the first element that is a JSON null.
    """
    shape = "array<struct<product:variant,listed:boolean>>"

    def entries(item: Column) -> Column:
        kind = _text_at(item, '$["@type"]')
        elements = F.try_variant_get(item, "$.itemListElement", "array<variant>")
        listed = F.transform(
            elements,
            lambda e: F.struct(F.coalesce(_object(e, "$.item"), e).alias("product"), F.lit(True).alias("listed")),
        )
        single = F.array(F.struct(item.alias("product"), F.lit(False).alias("listed")))
        return (
            F.when(F.is_variant_null(item) | kind.isin("Product", "Offer"), single)
            .when((kind == "ItemList") & elements.isNotNull(), listed)
            .otherwise(F.array().cast(shape))
        )

    everything = F.flatten(F.transform(_as_list(F.try_parse_json(block)), entries))
    stop = F.array_position(F.transform(everything, lambda e: F.is_variant_null(e["product"])), True)
    return F.when(stop > 0, F.slice(everything, 1, (stop - 1).cast("int"))).otherwise(everything)


def jsonld_deals(pages: DataFrame) -> DataFrame:
    """Products and offers of every ``application/ld+json`` block of a page; blocks that do not parse are skipped.

    ``pages``: html and any further columns, which are kept.
    """
    kept = [c for c in pages.columns if c != "html"]
    blocks = F.regexp_extract_all("html", F.lit(LD_BLOCK), F.lit(1))
    found = pages.select(*kept, blocks.alias("_blocks")).filter(F.size("_blocks") > 0)
    candidates = F.flatten(F.filter(F.transform("_blocks", _ld_candidates), lambda c: c.isNotNull()))

    def deal(entry: Column) -> Column:
        product = entry["product"]
        offer = F.coalesce(_object(product, "$.offers"), product)
        name = _given(product, "$.name")
        fallback = F.when(~entry["listed"], F.coalesce(_given(offer, "$.name"), F.lit("Unknown")))
        return F.struct(
            F.coalesce(name, fallback).alias("product"),
            number_prefix(_given(offer, "$.highPrice")).alias("original_price"),
            number_prefix(_given(offer, "$.price")).alias("promo_price"),
            F.when(~entry["listed"], _given(offer, "$.discount")).alias("discount"),
            _given(product, "$.description").alias("description"),
            F.coalesce(_text_at(product, "$.image[0]"), _given(product, "$.image")).alias("image_url"),
        )

    deals = F.filter(F.transform(candidates, deal), lambda d: d["product"].isNotNull())
    rows = unnest(found, kept, deals, "_deal")
    return rows.select(*kept, F.concat(F.lit("jsonld-"), F.col("_n").cast("string")).alias("id"), "_deal.*")


CARD_FIELDS = ["name", "original_price", "promo_price", "discount", "description", "category", "image"]


def card_deals(pages: DataFrame, selectors: dict[str, dict[str, str]]) -> DataFrame:
    """Deals of the product cards of a page, by the selectors of its retailer.

    ``selectors``: per retailer the selectors of ``card``, ``name`` and optionally of the other
    ``CARD_FIELDS``. They are a small constant and travel with the task. Python only finds the
    elements; prices are parsed by Spark. Pages of retailers without selectors are dropped first.
    """
    kept = [c for c in pages.columns if c != "html"]
    known = pages.filter(F.col("retailer_slug").isin(list(selectors)))
    fields = {name: f"{name} string" for name in CARD_FIELDS}
    schema = ", ".join(
        [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + ["card int"] + list(fields.values())
    )

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for values in frame.to_dict("records"):
                rules = selectors[values["retailer_slug"]]
                for n, card in enumerate(select(parse_html(values["html"] or ""), rules["card"])):
                    found = {}
                    for field in CARD_FIELDS:
                        element = next(iter(select(card, rules[field])), None) if rules.get(field) else None
                        if element is None:
                            found[field] = None
                        elif field == "image":
                            found[field] = element.attrs.get("src") or element.attrs.get("data-src")
                        else:
                            found[field] = text_of(element)
                    out.append({**{c: values[c] for c in kept}, "card": n, **found})
            yield pd.DataFrame(out, columns=[*kept, "card", *CARD_FIELDS])

    def filled(field: str) -> Column:
        return F.nullif(strip(F.col(field)), F.lit(""))

    cards = known.mapInPandas(read, schema)
    return cards.filter(filled("name").isNotNull()).select(
        *kept,
        F.concat(F.lit("html-"), F.col("card").cast("string")).alias("id"),
        strip(F.col("name")).alias("product"),
        parse_price(F.col("original_price")).alias("original_price"),
        parse_price(F.col("promo_price")).alias("promo_price"),
        F.when(F.col("discount") != "", strip(F.col("discount"))).alias("discount"),
        F.when(F.col("description") != "", strip(F.col("description"))).alias("description"),
        F.when(F.col("category") != "", strip(F.col("category"))).alias("category"),
        F.col("image").alias("image_url"),
    )


# Which elements are product cards, and which card lines are navigation.
CARD_SELECTOR = (
    '[class*="product-card"], [class*="productCard"], [class*="product-tile"], [class*="productTile"], '
    '[class*="product-item"], [class*="productItem"], [class*="deal-card"], [class*="dealCard"], '
    '[class*="offer-card"], [class*="offerCard"], [class*="promo-card"], [class*="promoCard"], '
    '[data-product], [data-product-id], [data-item-id], [data-testid*="product"]'
)
BROAD_CARD_SELECTOR = (
    'article, [role="listitem"], [class*="product"]:not(nav):not(header):not(footer), '
    '[class*="card"]:not(nav):not(header):not(footer)'
)
NOISE_LINE = (
    CASELESS + r"^(?:menu|footer|header|nav|cookie|login|registr|winkel|winkels|jobs|bezorg|verzend|levering|service"
    r"|advies|contact|klantenservice|openingsuren|over ons|alle (?:acties|categorie|product|promo)|acties voor jou"
    r"|top promo|weekactie\d|aanbiedingen|promotions? page|acties & promoties|gratis (?:ruilen|retour|advies|verzend)"
    r"|voor \d+u|download|volgende week|meer info|bekijk |lees meer|inloggen|uitloggen|mijn account|zoeken|categorie)"
)
CARD_DISCOUNT = (
    rf"{CASELESS}-\d+{SPACE}*%|\d+{SPACE}*\+{SPACE}*\d+{SPACE}*gratis"
    rf"|[234]e?{SPACE}*(?:halve{SPACE}*prijs|gratis)|1\+1"
)


#: What the reference takes of cards.
CARD_LIMITS = {"shortest": 15, "longest": 300, "above": 0.01, "below": 50000, "key_length": 30, "name_length": 100}


def card_texts(pages: DataFrame) -> DataFrame:
    """The texts of the product cards of each page as an array; a broader search where none are marked."""
    kept = [c for c in pages.columns if c != "html"]
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + ["cards array<string>"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for html in frame["html"]:
                root = parse_html(html or "")
                found = select(root, CARD_SELECTOR) or select(root, BROAD_CARD_SELECTOR)
                texts.append([text_of(element) for element in found])
            yield frame[kept].assign(cards=texts)

    return pages.mapInPandas(read, schema)


def _card_name(text: Column, length: int | None) -> Column:
    """The first line that still names something without its prices."""
    naked = rf"{WORD_START}\d{{1,3}}[.,]\d{{2}}{WORD_END}"
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: longer_than(line, 3))
    bare = F.transform(
        lines, lambda line: strip(erase(erase(erase(line, EURO_PRICE), naked), rf"-?\d+{SPACE}*%"))
    )
    named = F.filter(
        bare,
        lambda line: longer_than(line, 4)
        & ~line.rlike(rf"^{SPACE[:-1]}\d%€,.+\-]+\z")
        & ~line.rlike(NOISE_LINE),
    )
    name = F.get(named, F.lit(0))
    return name if length is None else utf16_head(name, length)


def page_text_deals(
    pages: DataFrame, shortest: int | None = None, longest: int | None = None, above: float | None = None, below: float | None = None,
    key_length: int | None = None, name_length: int | None = None,
) -> DataFrame:
    """Deals from card texts with a euro price, one per name in a page.

    Cards have ``shortest`` to ``longest`` characters, prices lie between ``above`` and ``below``, names that share
    ``key_length`` letters and digits are one, and names are cut at ``name_length``; None sets no bound.

    ``pages``: ``cards`` (array of texts) and any further columns, which are kept. A page is one row and
    stays one until its deals are final. A card that takes a name but has no usable price still uses
    the name up.
    """
    kept = [c for c in pages.columns if c != "cards"]

    def read(text: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), _card_name(text, name_length).alias("product"), text.alias("text"))

    def keyed(card: Column) -> Column:
        key = erase(F.lower(card["product"]), "[^a-z0-9]")
        key = key if key_length is None else F.substring(key, 1, key_length)
        return F.struct(key.alias("key"), card["at"].alias("at"), card["product"].alias("product"), card["text"].alias("text"))

    sized = F.filter(
        F.transform("cards", strip),
        lambda t: (utf16_length(t) >= (shortest or 0)) & (F.lit(True) if longest is None else utf16_length(t) <= longest) & t.rlike(EURO_PRICE),
    )
    named = F.filter(F.transform(sized, read), lambda c: c["product"].isNotNull())
    by_key = pages.select(*kept, F.array_sort(F.transform(named, keyed)).alias("_cards"))
    firsts = F.filter("_cards", lambda c, i: (i == 0) | (F.get("_cards", i - 1)["key"] != c["key"]))

    def priced(card: Column) -> Column:
        prices = F.filter(numbers_in(card["text"], EURO_PRICE), lambda p: (F.lit(True) if above is None else p > above) & (F.lit(True) if below is None else p < below))
        return F.struct(
            card["at"].alias("at"), card["product"].alias("product"), F.array_min(prices).alias("low"),
            F.array_max(prices).alias("high"), card["text"].alias("text"),
        )

    def deal(card: Column) -> Column:
        return F.struct(
            card["at"].alias("at"),
            card["product"].alias("product"),
            F.when(card["high"] > card["low"], card["high"]).alias("original_price"),
            card["low"].alias("promo_price"),
            strip(first_match(card["text"], CARD_DISCOUNT)).alias("discount"),
        )

    usable = F.filter(F.transform(firsts, priced), lambda c: c["low"].isNotNull())
    deals = F.array_sort(F.transform(usable, deal))
    rows = unnest(by_key, kept, deals, "_deal")
    return rows.select(
        *kept, F.concat(F.lit("pagetext-"), F.col("_n").cast("string")).alias("id"),
        "_deal.product", "_deal.original_price", "_deal.promo_price", "_deal.discount",
    )
