"""Limits are arguments: without them nothing is dropped."""

from dealtide.operators import capture, health, page_deals, text_deals

from .test_operators import NOW, docs_of, leaflet


def test_catalogue_gate_takes_all_pages(spark):
    pages = spark.createDataFrame([("a", n, f"€ {n},00") for n in range(40, 0, -1)], "doc string, page_no int, text string")
    [row] = text_deals.catalogue_gate(pages, ["doc"]).collect()
    assert row.text.split("\n") == [f"€ {n},00" for n in range(1, 41)]


def test_cards_of_any_size(spark):
    long = "Een hele lange naam van een product dat nog niet was genoemd"
    cards = ["Kaas € 1,00 A", "Auto groot € 60000,00", f"{long} een € 2,00", f"{long} twee € 3,00", "y" * 400 + " € 4,00"]
    page = spark.createDataFrame([("p", cards)], "page string, cards array<string>")
    got = page_deals.page_text_deals(page).collect()
    assert [r.product for r in got] == ["Kaas  A", "Auto groot", f"{long} een", f"{long} twee", "y" * 400] and got[1].promo_price > 50000


def test_late_success_counts(spark):
    docs = docs_of(spark, e={"folders": [leaflet()]})
    rows = spark.createDataFrame([("r", "e", n, n == 5, f"{n}") for n in range(1, 6)], "run_id string, slug string, attempt int, ok boolean, error string")
    [row] = health.run_status(rows, docs, NOW).collect()
    assert (row.status, row.attempts, row.error) == ("retry_success", 5, None)


def test_viewer_pages(spark):
    embeds = spark.createDataFrame([("https://view.publitas.com/g/h",)], "url string")
    assert capture.viewer_page_urls(embeds, 40).count() == 40
