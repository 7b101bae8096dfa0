"""Captured pages and responses: which link, viewer or pdf holds the leaflet, and the leaflet rows built from them.

A page is one row; its links and frames are arrays in page order, and choices are "first element that
passes". Nothing is grouped by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at_first, unnest
from ..functions.dates import folder_id, iso_week, iso_week_year, week_dates, week_start
from ..functions.links import INSIDE, anchors, attribute, frames, visible
from ..functions.links import resolved as resolve_url  # noqa: F401
from ..functions.text import any_of, first_match, present
from ..functions.urls import (
    API_WORDS, FOLDER_WORDS, PUBLITAS_EXCLUDED, TRACKING_WORDS, VIEWER_FRAMES, embed_source, normalize_embed_url,
    resolve_content_source,
)
from ..params import clock

# Element attributes, image endings, URL templates and limits.
DATA_ATTRIBUTES = ["data-folder-url", "data-embed-url", "data-publication-url", "data-flipbook-url", "data-viewer-url"]
IMAGE_URL = r"(?i)\.(?:png|jpe?g|webp|gif)(?:\z|\?)"
PDF_URL = r"(?i)\.pdf(?:\z|\?)"
PDF_HREF = r"(?i)\.pdf(?:\z|\?|#)"
MAX_PAGES = 12
WEEK_URLS = {
    "albert-heijn": "https://www.ah.be/bonus/folder/bonus-week-{week}-{year}",
    "delhaize": "https://view.publitas.com/delhaize-belgium-nl/w{week}-{year}-nl/page/1",
    "aldi": "https://folder.aldi.be/import-folder/{year}/{year2}{week2}-nl",
}
RANGE_URLS = {"lidl": "https://folder-nl.lidl.be/nl-folder-{from}-{until}"}

def bucket_responses(responses: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Captured URLs by kind; a URL may be of several kinds and counts once per kind and capture.

    ``responses``: the ``by`` columns, url, content_type and ``order``. The result keeps the first place.
    """
    url, kind = F.col("url"), F.coalesce("content_type", F.lit(""))

    def bucket(name: str, test: Column, value: Column = url) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("bucket"), value.alias("url")))

    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    viewer = F.concat(origin, F.lit("/"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.lit("/"))
    excluded = F.arrays_overlap(parts, F.array(*[F.lit(p) for p in PUBLITAS_EXCLUDED]))
    kinds = F.array(
        bucket("image", F.startswith(kind, F.lit("image/")) | url.rlike(IMAGE_URL)),
        bucket("pdf", url.rlike(PDF_URL) | F.contains(kind, F.lit("application/pdf"))),
        bucket("publitas", F.contains(url, F.lit("view.publitas.com")) & (F.size(parts) >= 2) & ~excluded, viewer),
        bucket("ipaper", any_of(url, ["ipaper.io", "ipapercms.dk"])),
        bucket("yumpu", F.contains(url, F.lit("yumpu.com"))),
        bucket(
            "issuu",
            F.contains(url, F.lit("issuu.com")) & any_of(url, ["/stacks/", "e.issuu.com"]) & F.endswith(url, F.lit(".html")),
        ),
        bucket("api_json", F.contains(kind, F.lit("application/json")) & any_of(url, API_WORDS)),
    )
    rows = unnest(responses, [*by, order], kinds, "b")
    return rows.groupBy(*by, F.col("b.bucket").alias("bucket"), F.col("b.url").alias("url")).agg(
        F.min(order).alias(order)
    )


def first_captures(buckets: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """The first URL of each kind per capture, one column per kind."""
    kinds = ["pdf", "publitas", "ipaper", "yumpu", "issuu"]
    wanted = buckets.filter(F.col("bucket").isin(kinds))
    return wanted.groupBy(*by).agg(
        *[
            F.min_by(F.when(F.col("bucket") == k, F.col("url")), F.when(F.col("bucket") == k, F.struct(order, "url"))).alias(k)
            for k in kinds
        ]
    )


def page_links(html: Column, base: Column) -> Column:
    """The links of a page in order, as (href, text), as a browser shows them."""
    return anchors(html, base)


def with_links(pages: DataFrame) -> DataFrame:
    """Pages (url, html and more) with their ``links``."""
    return pages.withColumn("links", page_links(F.col("html"), F.col("url")))


def pick_folder_link(pages: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """The link to the leaflet: the first that meets a pattern of the retailer, else the first with a leaflet word.

    ``pages``: links and, with ``patterns`` (slug, patterns array), retailer_slug.
    """
    def worded(link: Column) -> Column:
        return any_of(F.lower(link["href"]), FOLDER_WORDS) | any_of(F.lower(link["text"]), FOLDER_WORDS)

    by_word = at_first(worded, F.col("links"))["href"]
    if patterns is None:
        return pages.withColumn("folder_link", by_word)
    rules = patterns.select(F.col("slug").alias("retailer_slug"), F.col("patterns").alias("_patterns"))
    by_pattern = at_first(
        lambda link: F.exists("_patterns", lambda p: F.rlike(link["href"], p)), F.col("links")
    )["href"]
    return pages.join(rules, "retailer_slug", "left").withColumn("folder_link", F.coalesce(by_pattern, by_word)).drop("_patterns")


def page_frames(html: Column, base: Column) -> Column:
    """Sources of the frames of a page, in order."""
    return frames(html, base)


def data_embed(html: Column) -> Column:
    """Embed URL in a data attribute: the first element with the first attribute that occurs decides."""
    found = F.lit(None).cast("string")
    for name in reversed(DATA_ATTRIBUTES):
        tag = first_match(html, rf"(?is)<[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*?[\s\"']{name}(?=[\s=>/]){INSIDE}>")
        tag_inside = F.regexp_replace(tag, r"^<[^\s/>]+|>\z", "")
        value = F.coalesce(*[attribute(tag_inside, other) for other in DATA_ATTRIBUTES])
        found = F.when(tag.isNotNull(), value).otherwise(found)
    return found


def pick_embed(pages: DataFrame, captures: DataFrame, by: list[str]) -> DataFrame:
    """The viewer of the leaflet: a known viewer frame, else any other frame that is not tracking, else a
    captured viewer, else a data attribute. Adds embed_url and embed_kind.

    ``pages``: the ``by`` columns, url, html; ``captures``: ``first_captures``.
    """
    # what the html says is taken before the join, so that it need not be moved
    said = pages.withColumn("_frames", page_frames(F.col("html"), F.col("url"))).withColumn("_data", data_embed(visible(F.col("html"))))
    frames = F.col("_frames")
    viewer = at_first(lambda s: any_of(s, VIEWER_FRAMES), frames)
    other = at_first(lambda s: F.startswith(s, F.lit("http")) & ~any_of(s, TRACKING_WORDS), frames)

    def embed(url: Column, kind: Column) -> Column:
        return F.when(url.isNotNull(), F.struct(url.alias("url"), kind.alias("kind")))

    said = said.withColumn("_frame", F.coalesce(viewer, other)).drop("_frames")
    staged = said.join(captures.select(*by, "publitas", "ipaper", "yumpu", "issuu"), by, "left")
    frame, publitas, data = F.col("_frame"), F.col("publitas"), F.col("_data")
    choice = F.coalesce(
        embed(normalize_embed_url(frame, embed_source(frame)), embed_source(frame)),
        embed(normalize_embed_url(publitas, F.lit("publitas")), F.lit("publitas")),
        *[embed(F.col(k), F.lit(k)) for k in ("ipaper", "yumpu", "issuu")],
        embed(data, embed_source(data)),
    )
    picked = staged.withColumn("_embed", choice)
    return picked.withColumns({"embed_url": F.col("_embed.url"), "embed_kind": F.col("_embed.kind")}).drop(
        "_embed", "_frame", "_data", "publitas", "ipaper", "yumpu", "issuu"
    )


def pick_pdf(pages: DataFrame, captures: DataFrame, by: list[str]) -> DataFrame:
    """The pdf of the leaflet: captured, else the first pdf link, else a download link that names a pdf."""
    def download(link: Column) -> Column:
        text = F.lower(link["text"])
        return F.contains(text, F.lit("download")) & F.contains(text, F.lit("pdf")) & F.startswith(link["href"], F.lit("http"))

    file = at_first(lambda link: link["href"].rlike(PDF_HREF), F.col("links"))["href"]
    named = at_first(download, F.col("links"))["href"]
    # one address is moved instead of all links
    said = pages.withColumn("_said", F.coalesce(file, named))
    joined = said.join(captures.select(*by, "pdf"), by, "left")
    return joined.withColumn("pdf_url", F.coalesce("pdf", "_said")).drop("pdf", "_said")


def build_folder_rows(captures: DataFrame, screenshots: DataFrame, as_of, max_pages: int | None = None) -> DataFrame:
    """Leaflet rows from captures.

    ``captures``: slug, name, folder_title, embed_url, embed_kind, pdf_url, offline, embeddable,
    deal_count; ``screenshots``: slug, page_number, image_url, one row per page. All pages of a leaflet are
    taken, or its first ``max_pages``.
    """
    shots = screenshots if max_pages is None else screenshots.filter(F.col("page_number").between(1, max_pages))
    shots = shots.groupBy("slug", "page_number").agg(F.min("image_url").alias("image_url"))
    pages = shots.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("page_number", "image_url"))).alias("pages"))
    now = clock(as_of)
    empty = F.array().cast("array<struct<page_number:int,image_url:string>>")
    joined = captures.join(pages, "slug", "left").withColumn("pages", F.coalesce("pages", empty))
    has_pages = F.size("pages") > 0
    hidden = F.col("offline") | ~F.col("embeddable") | ((F.col("embed_kind") == "issuu") & has_pages)
    week = week_dates(now)
    return joined.select(
        folder_id(F.col("slug"), now).alias("id"),
        F.col("slug").alias("retailer_slug"),
        F.coalesce(F.nullif("folder_title", F.lit("")), F.concat("name", F.lit(" folder van de week"))).alias("title"),
        week["valid_from"].alias("valid_from"),
        week["valid_until"].alias("valid_until"),
        F.size("pages").alias("page_count"),
        F.coalesce(F.get("pages", F.lit(0))["image_url"], F.lit("")).alias("thumbnail_url"),
        "pages",
        F.when(~F.coalesce(hidden, F.lit(False)), F.col("embed_url")).alias("embed_url"),
        "pdf_url",
        resolve_content_source(
            F.col("embed_kind"), F.col("pdf_url").isNotNull(), has_pages, F.col("deal_count") > 0
        ).alias("content_source"),
        now.alias("scraped_at"),
    )


def _filled(template: str, values: dict[str, Column]) -> Column:
    url = F.lit(template)
    for name, value in values.items():
        url = F.replace(url, F.lit("{" + name + "}"), value)
    return url


def candidate_week_urls(requests: DataFrame) -> DataFrame:
    """Likely leaflet URLs for this, the next and the last week of each request (slug, moment).

    Weeks outside 1 to 53 are left out; the year stays that of the moment.
    """
    day = F.col("moment").cast("date")
    rows = requests.filter(F.col("slug").isin([*WEEK_URLS, *RANGE_URLS])).withColumn("offset", F.explode(F.array(*map(F.lit, (0, 1, -1)))))
    week, year = iso_week(day) + F.col("offset"), iso_week_year(day).cast("string")
    start = F.date_add(week_start(day), F.col("offset") * 7)
    values = {
        "week2": F.lpad(week.cast("string"), 2, "0"),
        "week": week.cast("string"),
        "year2": F.right(year, F.lit(2)),
        "year": year,
    }
    span = {"from": F.date_format(start, "dd-MM"), "until": F.date_format(F.date_add(start, 5), "dd-MM")}
    in_year = (week >= 1) & (week <= 53)
    url = F.lit(None).cast("string")
    for slug, template in WEEK_URLS.items():
        url = F.when((F.col("slug") == slug) & in_year, _filled(template, values)).otherwise(url)
    for slug, template in RANGE_URLS.items():
        url = F.when(F.col("slug") == slug, _filled(template, span)).otherwise(url)
    return rows.withColumn("url", url).filter(F.col("url").isNotNull())


def set_query_value(url: Column, key: str, value: Column) -> Column:
    """``url`` with one query parameter set, in its place if it is there, else at the end."""
    there = url.rlike(rf"^[^#]*[?&]{key}=")
    base, tail = F.regexp_extract(url, r"^([^#]*)", 1), F.regexp_extract(url, r"^[^#]*(.*)\z", 1)
    joint = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    pattern = rf"^([^#]*?[?&]{key}=)([^&#]*)"
    replaced = F.concat(
        F.regexp_extract(url, pattern, 1), value, F.substring(url, F.length(F.regexp_extract(url, pattern, 0)) + 1, F.length(url))
    )
    return F.when(there, replaced).otherwise(F.concat(base, joint, F.lit(key + "="), value, tail))


def viewer_page_urls(embeds: DataFrame, pages: int | Column) -> DataFrame:
    """The URL of each page of a viewer, from page 1 to ``pages``, as a URL does not tell how many it has; at least one. ``embeds``: url and more; other URLs give none."""
    url, page = F.col("url"), F.col("page").cast("string")
    path = F.regexp_extract(url, r"^([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*(.*)\z", 1)
    turned = F.concat(F.regexp_replace(path, r"/page/\d+/?\z", F.concat(F.lit("/page/"), page)), rest)
    asked = set_query_value(set_query_value(url, "page", page), "pageNumber", page)
    ipaper = r"(?i)^(https?://\S+?/iPaper/Papers/[^/]+/Pages/)\d+(/Zoom\.jpg)(\?\S+)?"
    images = F.concat(F.regexp_extract(url, ipaper, 1), page, F.regexp_extract(url, ipaper, 2), F.regexp_extract(url, ipaper, 3))
    page_url = (
        F.when(url.rlike(r"(?i)ipaper\.io/iPaper/Papers/.+/Pages/\d+/Zoom\.jpg"), images)
        .when(F.contains(url, F.lit("e.issuu.com/embed.html")), set_query_value(url, "pageNumber", page))
        .when(F.contains(url, F.lit("view.publitas.com/")), F.when(F.contains(path, F.lit("/page/")), turned).otherwise(asked))
    )
    rows = embeds.withColumn("page", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.lit(pages) if isinstance(pages, int) else pages))))
    return rows.withColumn("page_url", page_url).filter(F.col("page_url").isNotNull())
