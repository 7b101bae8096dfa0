"""Operators on small literal inputs, and against brute force."""

import datetime as dt
import json
import math
import random

from pyspark.sql import functions as F

from dealtide.operators import changes, coverage, deals, folders, health, ingest, page_deals, products, proximity, text_deals
from dealtide.sources.documents import deals_of, folders_of, parse_docs

NOW = "2026-05-15 12:00:00"


def texts(spark, *rows):
    return spark.createDataFrame([(n, "shop", row) for n, row in enumerate(rows)], "doc_id int, retailer_slug string, text string")


def found(frame):
    return [(r.product, r.original_price, r.promo_price, r.discount) for r in frame.orderBy("doc_id", "id").collect()]


def test_text_deals(spark):
    docs = texts(
        spark,
        "Appels Jonagold\n€ 2,99 €1.49\n-50 %",
        "Koffie € 5,00\nxx\nGratis",
        "Bier\n2 + 1 gratis",
        "Kaas 12,50 9,75 per kilo",
        "€ 1,00\nWijn",
        "ab\n€ 0,00 Nulprijs",
        "",
    )
    assert found(text_deals.text_deals(docs)) == [
        ("Appels Jonagold", 2.99, 1.49, "-50 %"),
        ("Koffie", None, 5.0, "Gratis"),
        ("Bier", None, None, "2 + 1 gratis"),
        ("Kaas   per kilo", 12.5, 9.75, None),
    ]


def test_text_deal_ids_count_per_document(spark):
    docs = texts(spark, "Melk € 1,00\nniets\nBrood € 2,00", "Ei € 3,00 doos")
    ids = [r.id for r in text_deals.text_deals(docs).orderBy("doc_id", "id").collect()]
    assert ids == ["shop-pdf-0", "shop-pdf-1", "shop-pdf-0"]


def test_catalogue_gate_reads_twelve_pages(spark):
    rows = [("a", n, "€ 1,00" if n in (1, 13) else "-") for n in range(1, 14)] + [("b", 2, "€ 2,00"), ("b", 1, "€ 1,00")]
    pages = spark.createDataFrame(rows, "doc string, page_no int, text string")
    got = text_deals.catalogue_gate(pages, ["doc"], max_pages=text_deals.MAX_PAGES).collect()
    assert [(r.doc, r.text) for r in got] == [("b", "€ 1,00\n€ 2,00")]


def ld(spark, *blocks):
    html = "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    page = spark.createDataFrame([("p", html)], "page string, html string")
    return page_deals.jsonld_deals(page).orderBy("id").collect()


def test_jsonld(spark):
    rows = ld(
        spark,
        json.dumps({"@type": "Product", "name": "A", "offers": {"price": "2,5", "highPrice": 0}, "image": ["i1", "i2"]}),
        "{bad",
        json.dumps([{"@type": "Offer", "price": "0"}, {"@type": "Thing", "name": "no"}]),
        json.dumps({"@type": "ItemList", "itemListElement": [{"item": {"name": "B", "offers": {"price": 3}}}, {"name": "C"}, {"x": 1}]}),
        json.dumps([{"@type": "Product", "name": "D"}, None, {"@type": "Product", "name": "E"}]),
    )
    assert [(r.id, r.product, r.original_price, r.promo_price, r.image_url) for r in rows] == [
        ("jsonld-0", "A", None, 2.0, "i1"), ("jsonld-1", "Unknown", None, 0.0, None), ("jsonld-2", "B", None, 3.0, None),
        ("jsonld-3", "C", None, None, None), ("jsonld-4", "D", None, None, None),
    ]


def test_page_text_deals_use_a_name_once(spark):
    cards = [
        "Lekkere Koffie zonder\n€ 0,00", "Lekkere koffie, zonder € 3,00", "Menu kaart\nAndere Thee € 4,00 € 4,00 1+1", "kort € 1,00",
        "x" * 301 + " € 1,00", "Geen prijs in deze kaart",
    ]
    page = spark.createDataFrame([("p", cards)], "page string, cards array<string>")
    got = page_deals.page_text_deals(page, **page_deals.CARD_LIMITS).collect()
    assert [(r.id, r.product, r.original_price, r.promo_price, r.discount) for r in got] == [
        ("pagetext-0", "Andere Thee   1+1", None, 4.0, "1+1")
    ]


def test_upsert_rules(spark):
    columns = (
        "retailer_slug string, retailer_name string, product string, promo_price double, original_price double, vertical string, "
        "valid_from date, valid_until date, scraped_at timestamp, description string, seq bigint"
    )
    day, until, at = dt.date(2027, 1, 1), dt.date(2027, 1, 7), dt.datetime(2027, 1, 1, 8)
    first = [
        ("s", "Shop", "A", None, 9.0, "general", day, until, at, "one", 1),
        ("s", "Shop", "B", 2.0, 3.0, "general", day, until, at, "one", 2),
        ("s", "Shop", None, 2.0, 3.0, "general", day, until, at, "no name", 3),
    ]
    second = [
        ("s", "Renamed", "A", -1.0, 8.0, "general", day, until, at, "two", 1),
        ("s", "Renamed", "A", -1.0, 7.0, "general", day, until, at, "three", 2),
        ("s", "Renamed", "C", 2.0, None, "general", day, until, at, None, 3),
    ]
    stored = products.upsert_products(None, products.product_rows(spark.createDataFrame(first, columns), "2027-01-01"))
    batch = products.product_rows(spark.createDataFrame(second, columns), "2027-01-02")
    rows = {r.product_name: r for r in products.upsert_products(stored, batch).collect()}
    assert set(rows) == {"A", "B", "C"}
    a = rows["A"]
    assert (a.retailer_name, a.promo_price, a.original_price, a.description) == ("Shop", None, 7.0, "three")
    assert (a.created_at.day, a.updated_at.day, a.week_number, a.year) == (1, 2, 53, 2026)
    assert rows["B"].updated_at.day == 1 and rows["C"].created_at.day == 2
    assert products.accepted_rows(batch).first().accepted == 3


def docs_of(spark, **named):
    rows = [(slug, body if isinstance(body, (str, type(None))) else json.dumps(body)) for slug, body in named.items()]
    return parse_docs(spark.createDataFrame(rows, "slug string, raw string"))


def leaflet(**changes):
    base = {
        "id": "f", "retailerSlug": "a", "title": "T", "validFrom": "2026-05-11", "validUntil": "2026-05-17", "pageCount": 0,
        "pages": [], "embedUrl": "https://view.publitas.com/x", "contentSource": "publitas", "scrapedAt": "2026-05-11T08:00:00Z",
    }
    return {**base, **changes}


def test_validate_docs(spark):
    docs = docs_of(
        spark, ok={"folders": [leaflet()]}, gone=None, broken="{", text={"folders": "x"}, none={"folders": []},
        bad={"folders": [leaflet(title=5, validFrom=None, validUntil="17-05-2026", pageCount=3, embedUrl="ftp:x")]},
        bare={"folders": [leaflet(embedUrl="", pdfUrl="")]},
    )
    got = {}
    for row in health.validate_docs(docs).collect():
        got.setdefault(row.slug, []).append((row.field, row.message, row.severity))
    assert "ok" not in got
    assert got["gone"] == [("file", "Data file does not exist", "error")]
    assert got["broken"] == [("file", "Invalid JSON", "error")]
    assert got["text"] == [("folders", "Missing or not an array", "error")]
    assert got["none"] == [("folders", "Empty folders array", "warning")]
    assert [f for f, _, _ in got["bad"]] == [
        "folders[0].title", "folders[0].validFrom", "folders[0].validUntil", "folders[0].pageCount", "folders[0].embedUrl",
    ]
    assert got["bad"][3][1] == "Mismatch: pageCount=3 but pages.length=0"
    assert got["bare"][0][0] == "folders[0]"


def test_current_folder_ends_with_its_last_day(spark):
    old, new = leaflet(id="old", validFrom="2026-05-01", validUntil="2026-05-10"), leaflet(id="new")
    docs = docs_of(spark, a={"folders": [old, new]}, b={"folders": [old]}, c={"folders": []})
    pick = lambda at: {r.slug: r.id for r in folders.all_current_folders(docs, at).collect()}
    assert pick(NOW) == {"a": "new", "b": "old"}
    assert pick("2026-05-17 00:00:01")["a"] == "old"


def test_expiry_and_offline_links(spark):
    docs = docs_of(
        spark, a={"folders": [leaflet(), leaflet(validUntil="2026-05-01", pdfUrl="https://x.folderz.be/p")]},
        b={"folders": [leaflet(validUntil="2026-05-01", embedUrl="https://issuu.com/x")]}, c={"folders": [leaflet(validUntil=None)]},
        d={"folders": [leaflet(validUntil="soon")]},
    )
    assert {r.slug: r.expired for r in folders.folder_expiry(docs, NOW).collect()} == {"a": False, "b": True, "c": False, "d": False}
    stripped = {r.slug: r for r in folders.strip_offline_embeds(docs, NOW).collect()}
    assert {s: r.changed for s, r in stripped.items()} == {"a": True, "b": False, "c": False, "d": True}
    assert [(f.embed_url, f.pdf_url) for f in stripped["a"].folders] == [("https://view.publitas.com/x", None), ("", "")]


def test_dead_links(spark):
    docs = docs_of(spark, a={"folders": [leaflet(pdfUrl="https://p")]}, b={"folders": [leaflet()]})
    url = "https://view.publitas.com/x"
    probes = spark.createDataFrame([("a", url, 404), ("a", "https://p", None), ("b", url, 301)], "slug string, url string, status int")
    got = {r.slug: (r.changed, r.folders[0].embed_url, r.folders[0].pdf_url) for r in folders.strip_dead_urls(docs, probes).collect()}
    assert got == {"a": (True, "", "https://p"), "b": (False, url, None)}


def test_run_status(spark):
    fresh, old = "2026-05-15T00:00:00Z", "2026-05-01T00:00:00Z"
    expired = leaflet(validUntil="2026-05-01")
    docs = docs_of(
        spark, a={"folders": [leaflet()], "scrapedAt": fresh}, b={"folders": [expired], "scrapedAt": old}, c="{",
        d={"folders": [expired], "scrapedAt": fresh}, e={"folders": [leaflet()]},
    )
    log = [
        ("a", 1, True, None), ("b", 1, False, "x"), ("b", 2, False, "y"), ("c", 1, False, "z"),
        ("d", 1, False, "1"), ("d", 2, False, "2"), ("d", 3, False, "3"), ("d", 4, True, None),
        ("e", 1, False, "1"), ("e", 2, False, "2"), ("e", 3, False, "3"), ("e", 4, True, None),
    ]
    rows = spark.createDataFrame([("r", *row) for row in log], "run_id string, slug string, attempt int, ok boolean, error string")
    got = {r.slug: (r.status, r.attempts, r.error, r.data_age) for r in health.run_status(rows, docs, NOW, health.ATTEMPTS, health.ATTEMPTS_IF_EXPIRED).collect()}
    assert got == {
        "a": ("fresh", 1, None, None), "b": ("stale", 2, "y", "15d"), "c": ("missing", 1, "z", None),
        "d": ("retry_success", 4, None, None), "e": ("fallback_local", 3, "3", "unknown age"),
    }


def test_viewer_mode(spark):
    rows = [
        ("colruyt", leaflet(pages=[{"pageNumber": 1, "imageUrl": "i"}])), ("delhaize", leaflet(embedUrl="https://e.example.com", pdfUrl="p")),
        ("a", leaflet(embedUrl="https://e.example.com")), ("b", leaflet(embedUrl="https://publitas.com/x")),
        ("c", leaflet(validUntil="2026-05-01", embedUrl="https://publitas.com/x", pdfUrl="https://p")), ("d", leaflet(embedUrl="https://x.ah.be/")),
    ]
    docs = docs_of(spark, **{slug: {"folders": [body]} for slug, body in rows})
    got = {r.slug: (r.mode, r.embed_shown, r.pdf_shown) for r in folders.viewer_mode(folders_of(docs), NOW).collect()}
    assert got == {
        "colruyt": ("pages", False, False), "delhaize": ("pdf", False, True), "a": ("embed", True, False), "b": ("embed", True, False),
        "c": ("pdf", False, True), "d": ("pdf", False, False),
    }


def test_contract(spark):
    pages = [{"pageNumber": n, "imageUrl": f"/{n}.png", "deals": []} for n in (1, 2)]
    good = {"retailer": "a", "folders": [leaflet(pages=pages, pageCount=2, thumbnailUrl="/1.png")], "deals": [], "scrapedAt": "x", "methods": ["screenshot"]}
    single = {**good, "folders": [leaflet(pages=pages[1:], pageCount=1, thumbnailUrl="", retailerSlug="b")]}
    got = {}
    for row in health.contract_violations(docs_of(spark, good=good, single=single)).collect():
        got.setdefault(row.slug, set()).add(row.rule)
    assert got == {"single": {"folder_retailer", "thumbnail", "pages_in_order", "single_page_screenshot"}}


def test_deals_with_image_lists(spark):
    docs = docs_of(spark, a={"folders": [], "deals": [{"id": "1", "product": "P", "promoPrice": 3, "imageUrl": ["x", "y"]}, {"product": "Q", "imageUrl": "z"}]})
    assert [(r.product, r.promo_price, r.image_url) for r in deals_of(docs).orderBy("pos").collect()] == [("P", 3.0, "x"), ("Q", None, "z")]


def test_deal_rules(spark):
    rows = [("a", "1", "P", 5.0, 3.0, "2026", "2026", "a", "/x"), ("a", "2", "", -1.0, None, None, "2026", "b", "img"), ("a", "3", " p ", 5.0, 9.0, "2026", "2026", "a", None)]
    frame = spark.createDataFrame(rows, "doc_slug string, id string, product string, promo_price double, original_price double, valid_from string, valid_until string, retailer_slug string, image_url string")
    got = {(r.id, r.rule) for r in deals.deal_violations(frame).collect()}
    assert got == {
        ("1", "promo_above_original"), ("2", "product_missing"), ("2", "promo_price_negative"), ("2", "valid_from_missing"),
        ("2", "retailer_mismatch"), ("2", "image_url_shape"),
    }
    assert [tuple(r) for r in deals.duplicate_deals(frame).collect()] == [("p", 5.0, "a", 2)]


def test_coverage(spark):
    retailers = spark.createDataFrame([("m", s) for s in "abc"], "project string, slug string")
    configs = spark.createDataFrame([("a", ["https://x"]), ("b", ["ftp:x"])], "slug string, folder_urls array<string>")
    docs = docs_of(spark, a={"folders": [leaflet()], "deals": []}, b={"folders": [leaflet(embedUrl="")]})
    got = {r.slug: r.failure_reasons for r in coverage.coverage_checks(retailers, configs, docs, NOW, True).collect()}
    assert got == {
        "a": [], "b": ["missing_folder_urls", "folder_not_renderable", "no_products"],
        "c": ["missing_scraper", "missing_folder_urls", "missing_data_file", "no_folders", "no_current_folder", "no_products"],
    }


def test_doc_changed_ignores_scrape_times(spark):
    old = {"retailer": "a", "folders": [leaflet()], "deals": [], "scrapedAt": "1", "methods": ["html"], "sourceUrls": ["u"]}
    cases = {
        "same": {**old, "scrapedAt": "2", "folders": [leaflet(scrapedAt="2")]}, "title": {**old, "folders": [leaflet(title="N")]},
        "methods": {**old, "methods": []}, "deals": {**old, "deals": [{"id": "1"}]},
    }
    before = spark.createDataFrame([(s, json.dumps(old)) for s in cases], "slug string, raw string")
    after = spark.createDataFrame([(s, json.dumps(d)) for s, d in [*cases.items(), ("new", old)]], "slug string, raw string")
    got = {r.slug: r.changed for r in changes.doc_changed(before, after).collect()}
    assert got == {"same": False, "title": True, "methods": True, "deals": True, "new": True}


def test_change_history_crosses_months(spark):
    rows = [("s", n, f"2024-{1 + n // 2:02d}-1{n % 2} 00:00:00", v) for n, v in enumerate(["a", "a", "a", "b", "b", None, "b", "b"])]
    probes = spark.createDataFrame(rows, "slug string, id bigint, at string, fingerprint_raw string").withColumn("probed_at", F.col("at").cast("timestamp"))
    got = [r.changed for r in changes.change_history(probes).orderBy("id").collect()]
    assert got == [True, False, False, True, False, True, True, False]


def brute(points, stores, k):
    def km(a, b):
        p = math.pi / 180
        x = math.sin((b[0] - a[0]) * p / 2) ** 2 + math.cos(a[0] * p) * math.cos(b[0] * p) * math.sin((b[1] - a[1]) * p / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    return {u: sorted((round(km((la, ln), (sla, sln)), 6), i) for i, _, sla, sln in stores)[:k] for u, la, ln in points}


def test_nearest_stores_against_brute_force(spark):
    rng = random.Random(5)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(80)]
    spots += [(50 + rng.gauss(0, 0.01), 4 + rng.gauss(0, 0.01)) for _ in range(150)]
    spots += [(89.9, 10.0), (-89.95, 170.0), (10.0, 179.999), (10.0, -179.999), (0.0, 0.0), (90.0, 0.0)]
    stores = [(f"s{n:03d}", f"r{n % 3}", la, ln) for n, (la, ln) in enumerate(spots)]
    points = [(n, la + rng.gauss(0, 0.5) if abs(la) < 80 else la, ln) for n, (la, ln) in enumerate(spots)]
    points += [(1000 + n, rng.uniform(-90, 90), rng.uniform(-180, 180)) for n in range(100)]
    s = spark.createDataFrame(stores, "id string, retailer_slug string, lat double, lng double")
    p = spark.createDataFrame(points, "user_id int, lat double, lng double")
    for k in (1, 4):
        got = {}
        for r in proximity.nearest_stores(p, s, k).collect():
            got.setdefault(r.user_id, []).append((round(r.distance_km, 6), r.store_id))
        want = brute(points, stores, k)
        assert {u: [d for d, _ in sorted(v)] for u, v in got.items()} == {u: [d for d, _ in v] for u, v in want.items()}
    assert proximity.nearest_stores(p, s, -2).count() == 0
    asked = p.withColumn("retailer_slug", F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")))
    got = {r.user_id: r.distance_km for r in proximity.nearest_store_distance(asked, s).collect()}
    for u, la, ln in points:
        own = [x for x in stores if x[1] == f"r{u % 4}"]
        if not own:
            assert got[u] is None
        else:
            assert round(got[u], 6) == brute([(u, la, ln)], own, 1)[u][0][0]


def test_scroll_milestones(spark):
    rows = [(1, 0, 0.0, 1600.0), (1, 10, 500.0, 1600.0), (1, 20, 900.0, 1600.0), (2, 0, 999.0, 600.0), (2, 5, 0.0, 600.0)]
    samples = spark.createDataFrame(rows, "view_id int, s int, y double, height double").select(
        "view_id", F.timestamp_seconds("s").alias("ts"), "y", "height", F.lit(600.0).alias("viewport")
    )
    got = {(r.view_id, r.event_name, r.created_at.second) for r in ingest.scroll_milestones(samples).collect()}
    assert got == {
        (1, "folder_view", 0), (1, "folder_engaged_15s", 15), (1, "folder_scroll_50", 10), (1, "folder_scroll_90", 20), (2, "folder_view", 0),
    }


def test_stores_at_one_place(spark):
    """Of 10,000 stores at one place only the k first are looked at."""
    crowd = [(n, 51.0, 4.0) for n in range(10_000)] + [(20_000 + n, 51.0 + n / 100, 4.1) for n in range(5)]
    stores = spark.createDataFrame(crowd, "id long, lat double, lng double")
    users = spark.createDataFrame([(1, 51.0, 4.0), (2, 51.2, 4.3)], "user_id long, lat double, lng double")
    found = proximity.nearest_stores(users, stores, 3)
    got = {(r.user_id, r["rank"]): r.store_id for r in found.collect()}
    assert [got[1, n] for n in (1, 2, 3)] == [0, 1, 2] and len(got) == 6
    places = stores.join(stores.groupBy("lat", "lng").agg(F.min("id").alias("least")), ["lat", "lng"]).filter("id < least + 3").select("id", "lat", "lng")
    points = users.select(F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    assert proximity.near_pairs(points, places, 3, []).count() <= 2 * 8
