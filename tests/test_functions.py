"""Scalar rules on literal cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from dealtide import catalog_data
from dealtide.functions import dates, geo, markup, prices, promo, text, urls
from dealtide.operators import capture, ingest, text_deals
from dealtide.params import clamp_int


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given,want",
    [(5, 5), ("7.9", 7), (None, 30), ("x", 30), (math.inf, 30), (math.nan, 30), (0, 1), (-3, 1), (9999, 365)],
)
def test_clamp(given, want):
    assert clamp_int(given, 30, 1, 365) == want


@pytest.mark.parametrize(
    "discount,product,promo_price,want",
    [
        ("1+1 gratis", "Koffie", None, "bogo"),
        ("Koop 2 betaal 1", "x", 3.0, "bogo"),
        (None, "buy 3 get 1", None, "bogo"),
        ("11+1", "x", None, "unknown"),
        ("é1+1", "x", None, "bogo"),
        ("2 voor €5", "x", None, "multi_buy"),
        ("3 pour 2", "x", None, "multi_buy"),
        ("-25 %", "x", 1.0, "percentage_off"),
        ("RÉDUCTION de 20%", "x", None, "percentage_off"),
        (None, "korting tot 10%", None, "percentage_off"),
        (None, "10% vet", None, "unknown"),
        ("€ 5 korting", "x", None, "fixed_discount"),
        ("Cashback", "x", None, "cashback"),
        ("REMBOURSÉ", "x", None, "cashback"),
        ("gratis cadeau", "x", None, "free_gift"),
        ("Free GIFT", "x", None, "free_gift"),
        (None, "Solden", None, "clearance"),
        (None, "sale", None, "clearance"),
        (None, "salesman", None, "unknown"),
        (None, "x", 2.0, "fixed_price"),
        (None, None, None, "unknown"),
    ],
)
def test_promo_type(spark, discount, product, promo_price, want):
    kind = promo.infer_promo_type(
        F.lit(discount).cast("string"), F.lit(product).cast("string"), F.lit(promo_price).cast("double")
    )
    assert value(spark, kind) == want


@pytest.mark.parametrize(
    "given,want",
    [("€ 1.299,00", 1.299), ("12,50", 12.5), ("nu 3.49 euro", 3.49), (",5", 0.5), ("gratis", None), (".", None), ("1,2,3", 1.2)],
)
def test_parse_price(spark, given, want):
    assert value(spark, prices.parse_price(F.lit(given))) == want


@pytest.mark.parametrize("given,want", [("2,5", 2.0), ("0", 0.0), (" 12.50 EUR", 12.5), ("abc", None), ("1e2", 100.0)])
def test_number_prefix(spark, given, want):
    assert value(spark, prices.number_prefix(F.lit(given))) == want


def test_strip_takes_every_white_space(spark):
    assert value(spark, text.strip(F.lit(" \t a b\n　﻿"))) == "a b"


def test_lengths_count_utf16_units(spark):
    assert value(spark, text.utf16_length(F.lit("\U0001f6d2a"))) == 3
    assert value(spark, text.longer_than(F.lit("\U0001f6d2a"), 2)) is True
    assert value(spark, text.utf16_head(F.lit("x" * 120), 100)) == "x" * 100


@pytest.mark.parametrize(
    "day,week,year", [("2027-01-01", 53, 2026), ("2024-12-30", 1, 2025), ("2026-05-11", 20, 2026), ("2021-01-03", 53, 2020)]
)
def test_iso_week(spark, day, week, year):
    column = F.lit(day).cast("date")
    assert value(spark, dates.iso_week(column)) == week
    assert value(spark, dates.iso_week_year(column)) == year


def test_week_dates_of_a_sunday(spark):
    got = value(spark, dates.week_dates(F.lit("2026-05-17").cast("date")))
    assert tuple(got) == (dt.date(2026, 5, 11), dt.date(2026, 5, 17))


def test_folder_id_uses_the_calendar_year(spark):
    assert value(spark, dates.folder_id(F.lit("a"), F.lit("2027-01-01").cast("date"))) == "a-2027-w53-folder"


@pytest.mark.parametrize(
    "hours,want", [(None, "unknown age"), (0.5, "30m"), (0.99, "59m"), (1.0, "1h"), (23.4, "23h"), (24.0, "1d"), (180.0, "8d")]
)
def test_format_age(spark, hours, want):
    assert value(spark, dates.format_age(F.lit(hours).cast("double"))) == want


@pytest.mark.parametrize(
    "given,want",
    [
        ("2024-01-15", dt.datetime(2024, 1, 15)), ("2024-01-15T10:00:00.000Z", dt.datetime(2024, 1, 15, 10)),
        ("2024-01-15T10:00:00+02:00", dt.datetime(2024, 1, 15, 8)), ("04-02-2024", dt.datetime(2024, 4, 2)),
        ("13-02-2024", None), ("soon", None), ("2024-13-01", None),
    ],
)
def test_iso_instant(spark, given, want):
    assert value(spark, dates.iso_instant(F.lit(given))) == want


def test_haversine(spark):
    km = geo.haversine_km(F.lit(51.2194), F.lit(4.4025), F.lit(50.8503), F.lit(4.3517))
    assert value(spark, km) == pytest.approx(41.2, abs=0.1)


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://view.publitas.com/a/b/", "https://view.publitas.com/a/b/page/1?publitas_embed=embedded"),
        ("https://view.publitas.com/a/page/3?x=1", "https://view.publitas.com/a/page/3?x=1&publitas_embed=embedded"),
        ("https://view.publitas.com/a?publitas_embed=1", "https://view.publitas.com/a?publitas_embed=1"),
        ("https://issuu.com/x", "https://issuu.com/x"),
    ],
)
def test_normalize_embed_url(spark, url, want):
    column = F.lit(url)
    assert value(spark, urls.normalize_embed_url(column, urls.embed_source(column))) == want


@pytest.mark.parametrize(
    "xfo,csp,want",
    [
        (None, None, True), ("DENY", None, False), ("SameOrigin", None, False), (None, "frame-ancestors 'none'", False),
        (None, "default-src 'self'; frame-ancestors *", True), (None, "frame-ancestors https://other.example.com", False),
        (None, "frame-ancestors https://own.example.com", True), (None, "default-src 'self'", True),
    ],
)
def test_is_embeddable(spark, xfo, csp, want):
    column = urls.is_embeddable(F.lit(xfo).cast("string"), F.lit(csp).cast("string"), ("https://own.example.com",))
    assert value(spark, column) is want


def test_offline_publication(spark):
    gone = urls.offline_publication(F.lit("This publication is OFFLINE (see https://a.example.com/x) https://b"))
    assert tuple(value(spark, gone)) == (True, "https://a.example.com/x")
    assert tuple(value(spark, urls.offline_publication(F.lit("https://a.example.com")))) == (False, None)


@pytest.mark.parametrize(
    "cookie,want",
    [
        ("sp_cookie_consent=accepted", True), ("a=1; sp_cookie_consent=accepted", True), ("sp_cookie_consent=accepted=no", True),
        ("sp_cookie_consent=rejected; sp_cookie_consent=accepted", False), ("xsp_cookie_consent=accepted", False), (None, False),
    ],
)
def test_consent(spark, cookie, want):
    assert value(spark, ingest.has_consent(F.lit(cookie).cast("string"))) is want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("%7B%22utm_source%22%3A%22a+b%22%2C%22utm_medium%22%3A3%7D", ("a+b", None, None, None)),
        ("%7B%22utm_content%22%3A%22%22%7D", None), ("%E0%A4%A", None), ("nojson", None), (None, None),
    ],
)
def test_attribution_cookie(spark, raw, want):
    got = value(spark, ingest.parse_attribution_cookie(F.lit(raw).cast("string")))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "given,want",
    [
        ("vanille", "ille"), ("Per stuk Melk €1,99", "Melk"), ("** Éclair! **", "Éclair"), ("12,50 € 3.99", ""), ("nu vanaf x", "vanaf x"),
    ],
)
def test_clean_product_name(spark, given, want):
    assert value(spark, text_deals.clean_product_name(F.lit(given))) == want


def test_resolve_url(spark):
    base = F.lit("https://www.example.com/nl/folder?x=1#top")
    want = {
        "https://b.example.com/": "https://b.example.com/", "//c.example.com/p": "https://c.example.com/p",
        "/abs": "https://www.example.com/abs", "rel": "https://www.example.com/nl/rel", "?q": "https://www.example.com/nl/folder?q",
        "#a": "https://www.example.com/nl/folder?x=1#a",
    }
    for link, url in want.items():
        assert value(spark, capture.resolve_url(base, F.lit(link))) == url


def test_selectors():
    root = markup.parse_html(
        '<div class="a product-card" id="x"><picture><img src="1"></picture><img src="2"></div><nav class="card"></nav><p data-product>t</p>'
    )
    found = lambda selector: [e.tag for e in markup.select(root, selector)]
    assert found("picture img") == ["img"]
    assert found('[class*="card"]:not(nav)') == ["div"]
    assert found("#x, [data-product]") == ["div", "p"]
    assert found(".a.product-card img") == ["img", "img"]
    assert markup.text_of(markup.select(root, "p")[0]) == "t"


def test_fixed_tables(spark):
    assert catalog_data.retailers(spark).count() == 32
    assert catalog_data.stores(spark).count() == 6
    links = ingest.affiliate_url(
        spark.createDataFrame([("lidl",), ("aldi",), ("bol",)], "slug string"),
        catalog_data.affiliates(spark, {"AFFILIATE_ALDI": "https://x.example.com"}),
    )
    assert dict(links.collect()) == {
        "lidl": "https://www.lidl.be/nl/aanbiedingen", "aldi": "https://x.example.com", "bol": "#",
    }
