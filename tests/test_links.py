"""Links, frames and data attributes of pages as browsers show them."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from dealtide.functions import links
from dealtide.operators import capture

BASE = "https://Shop.example.com/nl/promo/index.html?x=1#top"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def resolved(spark, pairs):
    frame = spark.createDataFrame([(n, b, r) for n, (b, r) in enumerate(pairs)], "n int, base string, link string")
    return [row.u for row in frame.select("n", links.resolved(F.col("base"), F.col("link")).alias("u")).orderBy("n").collect()]


CASES = {
    "../folder/week.html": "https://shop.example.com/nl/folder/week.html", "./a/./b/../c": "https://shop.example.com/nl/promo/a/c", "..": "https://shop.example.com/nl/",
    "../../../../x": "https://shop.example.com/x", "/a/../b/": "https://shop.example.com/b/", ".": "https://shop.example.com/nl/promo/", "/%2e%2E/y": "https://shop.example.com/y",
    "//cdn.example.com/a/../f.pdf": "https://cdn.example.com/f.pdf", "?p=2": "https://shop.example.com/nl/promo/index.html?p=2", "#end": "https://shop.example.com/nl/promo/index.html?x=1#end",
    "": "https://shop.example.com/nl/promo/index.html?x=1", "HTTPS://EXAMPLE.com": "https://example.com/", "http://example.com:80/a": "http://example.com/a",
    " \n/fol\tder ": "https://shop.example.com/folder", "\\dir\\file": "https://shop.example.com/dir/file", "/a b/é": "https://shop.example.com/a%20b/%C3%A9",
    "mailto:a@b.be": "mailto:a@b.be", "javascript:void(0)": "javascript:void(0)", "a?b=../c#../d": "https://shop.example.com/nl/promo/a?b=../c#../d", "x..y/..z": "https://shop.example.com/nl/promo/x..y/..z",
}


def test_references(spark):
    assert dict(zip(CASES, resolved(spark, [(BASE, link) for link in CASES]))) == CASES
    assert resolved(spark, [("https://a.example.com", "b"), ("https://a.example.com?q", "/c"), ("https://a.example.com/d", "")]) == ["https://a.example.com/b", "https://a.example.com/c", "https://a.example.com/d"]


def test_references_against_the_standard_library(spark):
    rng = random.Random(7)
    links_ = ["/".join(rng.choice(["a", "b.c", "..", ".", "d"]) for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    links_ = [rng.choice(["", "/", "../"]) + link + rng.choice(["", "?q=1", "#f"]) for link in links_]
    base = "https://shop.example.com/nl/promo/x/index.html"
    assert resolved(spark, [(base, link) for link in links_]) == [urljoin(base, link) for link in links_]


@pytest.mark.parametrize("text, want", [
    ("a &amp; b", "a & b"), ("&lt;p&gt;&quot;&#39;", "<p>\"'"), ("&#8364; &#x20AC;5", "€ €5"), ("&eacute;t&eacute;", "été"), ("&unknown; & co", "&unknown; & co"),
    ("?a=1&b=2", "?a=1&b=2"), ("&#128512;", "😀"), ("&#0;&#xD800;&#x110000;", "���"), ("plain", "plain"), ("&amp;lt;", "&lt;"), ("&", "&"), ("", ""),
])
def test_character_references(spark, text, want):
    assert value(spark, links.unescaped(F.lit(text))) == want


HTML = """<html><head><title><a href="/title-folder">t</a></title><style>a:after{content:'<a href="/style-folder">'}</style>
<script>var s = '<a href="/script-folder">x</a>'; // <!--
</script><!-- <a href="/comment-folder">old folder</a> --></head><body>
<noscript><a href="/noscript-folder">n</a></noscript><textarea><a href="/text-folder">n</a></textarea>
<a name="folder">no address</a><a data-href="/folder-data" title="href='/no'">none</a><a title="a > b" href='/eerste?a=1&amp;b=2'>Eerste <b>&euro;</b> pagina</a>
<a href="">self</a><A HREF=../week/../folder.html CLASS=x>Naar de <i>fol</i>der &raquo;</A>
<iframe src="https://www.google.com/maps"><a href="/inner-folder">i</a></iframe><iframe data-src="/lazy"></iframe>
<iframe title="x>y" src="//view.publitas.com/shop/week&#45;5/"></iframe><script src=x></script>
<a href="/docs/f.PDF?v=1&amp;w=2">open</a><a href="https://x.example.com/get/7">Download <b>PDF</b></a><a href="/unclosed">Unclosed <!-- never closed <a href="/hidden-folder">"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([("s", "https://shop.example.com/nl/promo/", HTML)], "retailer_slug string, url string, html string")


def test_page_links(page):
    found = [(a.href, a.text) for a in capture.with_links(page).first().links]
    shop = "https://shop.example.com"
    assert found == [
        (f"{shop}/eerste?a=1&b=2", "Eerste € pagina"), (f"{shop}/nl/folder.html", "Naar de folder »"), (f"{shop}/docs/f.PDF?v=1&w=2", "open"),
        ("https://x.example.com/get/7", "Download PDF"), (f"{shop}/unclosed", "Unclosed  "),
    ]


def test_pick_folder_link(spark, page):
    assert capture.pick_folder_link(capture.with_links(page)).first().folder_link == "https://shop.example.com/nl/folder.html"
    rules = spark.createDataFrame([("s", [r"[?&]b=2"])], "slug string, patterns array<string>")
    assert capture.pick_folder_link(capture.with_links(page), rules).first().folder_link == "https://shop.example.com/eerste?a=1&b=2"


def captures(spark, **found):
    kinds = ["pdf", "publitas", "ipaper", "yumpu", "issuu"]
    return spark.createDataFrame([("s", *[found.get(k) for k in kinds])], "retailer_slug string, " + ", ".join(f"{k} string" for k in kinds))


def test_pick_embed(spark, page):
    picked = capture.pick_embed(page, captures(spark, yumpu="https://www.yumpu.com/e/1"), ["retailer_slug"])
    row = picked.first()
    assert row.embed_kind == "publitas" and row.embed_url.startswith("https://view.publitas.com/shop/week-5/")
    data = '<!-- <div data-embed-url="/old"> --><script>"<p data-folder-url=\'/no\'>"</script><div title="a>b" data-embed-url="https://view.publitas.com/a/b/?x=1&amp;y=2">'
    other = spark.createDataFrame([("s", "https://shop.example.com/", data)], "retailer_slug string, url string, html string")
    assert capture.pick_embed(other, captures(spark), ["retailer_slug"]).first().embed_url.startswith("https://view.publitas.com/a/b/")


def test_pick_pdf(spark, page):
    pages = capture.with_links(page)
    assert capture.pick_pdf(pages, captures(spark), ["retailer_slug"]).first().pdf_url == "https://shop.example.com/docs/f.PDF?v=1&w=2"
    assert capture.pick_pdf(pages, captures(spark, pdf="https://c/x.pdf"), ["retailer_slug"]).first().pdf_url == "https://c/x.pdf"


def test_base_element(spark):
    html = '<base target="_top"><base href="/deep/er/"><a href="x">folder</a><iframe src="../f"></iframe>'
    got = spark.range(1).select(links.anchors(F.lit(html), F.lit("https://a.be/q")).alias("a"), links.frames(F.lit(html), F.lit("https://a.be/q")).alias("f")).first()
    assert (got.a[0].href, got.f) == ("https://a.be/deep/er/x", ["https://a.be/deep/f"])


def test_odd_pages(spark):
    rows = [("s", "https://a.be/", None), ("s", "https://a.be/", ""), ("s", "https://a.be/", "<a"), ("s", None, '<a href="/x">y</a>'), ("s", "https://a.be/", '<a href="x">' * 300 + "y" * 200_000)]
    frame = spark.createDataFrame(rows, "retailer_slug string, url string, html string")
    found = [r.links for r in capture.with_links(frame).collect()]
    assert found[0] is None and found[1] == found[2] == [] and len(found[4]) == 300


def test_no_html_is_moved(spark, page):
    for picked in (capture.pick_embed(page, captures(spark), ["retailer_slug"]).select("retailer_slug", "embed_url"), capture.pick_pdf(capture.with_links(page), captures(spark), ["retailer_slug"]).select("pdf_url")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = picked._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        before = plan.split("Exchange hashpartitioning")[1:]
        assert before and all("html" not in part.split("\n")[1].split("AS _")[0].split("[")[1].split("]")[0] for part in before if "Project [" in part.split("\n")[1][:40])
