"""URL and page-text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_SPACE, any_of, first_match, present, strip

# Viewer hosts, phrases and words the rules look for.
VIEWERS = ["publitas", "ipaper", "yumpu", "issuu"]
VIEWER_FRAMES = ["publitas", "ipaper", "yumpu", "issuu", "flipbook"]
TRACKING_WORDS = [
    "about:", "javascript:", "google", "facebook", "doubleclick", "analytics", "tag",
    "consent", "cookie", "onetrust", "kameleoon", "hotjar", "tealium", "utag",
]
FOLDER_WORDS = ["folder", "leaflet", "flyer", "brochure", "promofolder"]
CHALLENGE_PHRASES = [
    "sorry voor de onderbreking", "click to verify", "captcha", "colruytgroup", "je een bot",
    "onmiddellijk weer toegang",
]
OFFLINE_PHRASES = [
    "deze publicatie is offline", "this publication is offline", "deze publicatie is niet gevonden",
    "this publication was not found", "publication not found",
]
OFFLINE_RISK_HOSTS = r"(?i)publitas\.com|folderz\.be"
PUBLITAS_EXCLUDED = ["branding", "custom-menu", "analytics", "stats"]
API_WORDS = ["promo", "deal", "offer", "folder", "product", "flyer", "leaflet"]


def embed_source(url: Column) -> Column:
    kind = F.lit("unknown")
    for viewer in reversed(VIEWERS):
        kind = F.when(F.contains(url, F.lit(viewer)), viewer).otherwise(kind)
    return kind


def normalize_embed_url(url: Column, source: Column) -> Column:
    """Publitas viewers get a page and the embed flag, each once; others stay."""
    paged = F.when(F.contains(url, F.lit("/page/")), url).otherwise(
        F.concat(F.regexp_replace(url, r"/\z", ""), F.lit("/page/1"))
    )
    joint = F.when(F.contains(paged, F.lit("?")), "&").otherwise("?")
    flagged = F.concat(paged, joint, F.lit("publitas_embed=embedded"))
    return F.when((source == "publitas") & ~F.contains(url, F.lit("publitas_embed")), flagged).otherwise(url)


def is_bot_challenge(text: Column) -> Column:
    return any_of(F.lower(F.coalesce(text, F.lit(""))), CHALLENGE_PHRASES)


def offline_publication(text: Column) -> Column:
    offline = any_of(F.lower(F.coalesce(text, F.lit(""))), OFFLINE_PHRASES)
    target = first_match(text, rf"(?i)https?://(?:(?![)\]]){NOT_SPACE})+")
    return F.struct(offline.alias("is_offline"), F.when(offline, target).alias("redirect_url"))


def is_embeddable(x_frame_options: Column, csp: Column, own_origins: tuple[str, ...] = ()) -> Column:
    """May the viewer be framed by a site of ``own_origins``?

    An X-Frame-Options header with deny or sameorigin forbids it; so does a frame-ancestors rule that
    names none or self, or one that lists hosts without a wildcard, localhost or one of our origins.
    """
    frame = F.lower(F.coalesce(x_frame_options, F.lit("")))
    rule = strip(F.regexp_extract(F.lower(F.coalesce(csp, F.lit(""))), r"frame-ancestors\s+([^;]+)", 1))
    open_to_us = any_of(rule, ["*", "http://localhost", *own_origins])
    return (
        F.when(any_of(frame, ["deny", "sameorigin"]), False)
        .when(any_of(rule, ["'none'", "'self'"]), False)
        .when((rule != "") & ~open_to_us, False)
        .otherwise(True)
    )


def resolve_content_source(embed: Column, has_pdf: Column, has_screenshots: Column, has_deals: Column) -> Column:
    """Embed kind, else pdf, else screenshot, else html, else unknown."""
    rest = F.when(has_pdf, "pdf").when(has_screenshots, "screenshot").when(has_deals, "html").otherwise("unknown")
    return F.coalesce(embed, rest)


def probe_fingerprint(
    start_url: Column, blocked: Column, embed_url: Column, pdf_url: Column
) -> Column:
    """What identifies the current leaflet: its embed, else its pdf; fixed words when there is neither."""
    return (
        F.when(~F.coalesce(present(start_url), F.lit(False)), "no-folder-url")
        .when(blocked, "blocked")
        .otherwise(
            F.coalesce(F.nullif(embed_url, F.lit("")), F.nullif(pdf_url, F.lit("")), F.lit("none"))
        )
    )


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def in_domain(host: Column, domain: str) -> Column:
    return (host == domain) | F.endswith(host, F.lit("." + domain))
