"""Events from raw hits: consent, attribution, engagement and outbound clicks.

All operators work on batch and streaming frames alike: they filter, project and join small
dimensions, nothing else. A hit has ts, kind, url, cookie, body, target (the retailer asked for),
user_agent and referrer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once, unnest
from ..functions.text import js_percent_decode, present, query_values, strip
from .events import ATTRIBUTION, ENGAGEMENT_EVENTS, OUTBOUND

# Cookie names, parameters and limits.
CONSENT_COOKIE = "sp_cookie_consent"
ATTRIBUTION_COOKIE = "sp_attrib"
UTM_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_content"]
UTM_URL_KEYS = [*UTM_KEYS, "utm_term"]
MAX_ATTRIBUTION_CHARS = 1500
VIEW_PATH = "/folders/"
JS_SAFE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.!~*'()"

EVENT_COLUMNS = [
    "created_at", "event_name", "path", "retailer", "destination_url", *UTM_KEYS, "user_agent", "referrer",
]


def cookie_value(cookie: Column, name: str) -> Column:
    """Text between the first and the second '=' of the first cookie called ``name``."""
    parts = F.transform(F.split(cookie, ";"), strip)
    hit = F.get(F.filter(parts, lambda p: F.startswith(p, F.lit(name + "="))), F.lit(0))
    return F.get(F.split(hit, "="), F.lit(1))


def has_consent(cookie: Column) -> Column:
    return F.coalesce(cookie_value(cookie, CONSENT_COOKIE) == "accepted", F.lit(False))


def consent_gate(hits: DataFrame) -> DataFrame:
    return hits.filter(has_consent(F.col("cookie")))


def parse_attribution_cookie(raw: Column) -> Column:
    """The four utm texts of an attribution cookie; null when it does not decode, parse or name any. It is decoded and parsed once."""
    def text(doc: Column, key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))
        value = F.try_variant_get(doc, f"$.{key}", "string")
        return F.when((kind == "STRING") & (value != ""), value)

    texts = once(F.try_parse_json(js_percent_decode(raw)), lambda doc: F.struct(*[text(doc, key).alias(key) for key in UTM_KEYS]))
    return once(texts, lambda t: F.when(F.coalesce(*[t[key] for key in UTM_KEYS]).isNotNull(), t))


def utm_from_url(url: Column) -> Column:
    """The five utm parameters of a URL, blank ones null."""
    return query_values(url, UTM_URL_KEYS)


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def _js_encoded_length(text: Column) -> Column:
    """Length of ``text`` after JavaScript's component encoding: each byte outside its safe set takes three."""
    other = F.translate(text, JS_SAFE, "")
    return F.length(text) - F.length(other) + F.octet_length(other) * 3


def _no(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def attribution_events(hits: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Consented landings with at least one utm parameter.

    With ``max_chars`` only those whose encoded payload is no longer: ``MAX_ATTRIBUTION_CHARS`` is what fits a cookie.
    """
    landings = consent_gate(hits.filter(F.col("kind") == "attribution"))
    kept = unnest(landings, ["ts", "url", "user_agent", "referrer"], F.array(utm_from_url(F.col("url"))), "_utm")
    fields = [F.col(f"_utm.{key}") for key in UTM_URL_KEYS]
    # The payload also carries the time of the landing in ISO form with milliseconds.
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    payload = F.to_json(F.struct("_utm.*", stamp.alias("first_seen_ts")))
    kept = kept.filter(F.coalesce(*fields).isNotNull())
    if max_chars is not None:
        kept = kept.filter(_js_encoded_length(payload) <= max_chars)
    return kept.select(
        F.col("ts").alias("created_at"), F.lit(ATTRIBUTION).alias("event_name"), url_path(F.col("url")).alias("path"),
        _no().alias("retailer"), _no().alias("destination_url"), *[f"_utm.{key}" for key in UTM_KEYS],
        "user_agent", "referrer",
    )


def _with_cookie_utm(hits: DataFrame) -> DataFrame:
    # a generator of one row holds the parsed cookie, so that it is not parsed again for each field
    made = F.array(F.struct(parse_attribution_cookie(cookie_value(F.col("cookie"), ATTRIBUTION_COOKIE)).alias("utm")))
    return unnest(hits, hits.columns, made, "_cookie").select(*hits.columns, F.col("_cookie.utm").alias("_utm"))


def engagement_events(hits: DataFrame, retailers: DataFrame) -> DataFrame:
    """Consented engagement hits with a known event and a catalogued retailer."""
    body = F.col("_body")

    def text(key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(body, f"$.{key}", "variant"))
        return F.when(kind == "STRING", F.try_variant_get(body, f"$.{key}", "string"))

    sent = consent_gate(hits.filter(F.col("kind") == "engagement"))
    parsed = unnest(sent, ["ts", "cookie", "user_agent", "referrer"], F.array(F.try_parse_json("body")), "_body")
    kept = parsed.select(
        "ts", "cookie", text("event").alias("event_name"), text("retailer").alias("retailer"), text("path").alias("_path"),
        "user_agent", "referrer",
    )
    kept = kept.filter(F.col("event_name").isin(ENGAGEMENT_EVENTS) & present(F.col("retailer")))
    known = retailers.select(F.col("slug").alias("retailer"))
    found = _with_cookie_utm(kept.join(known, "retailer", "left_semi"))
    path = F.when(F.startswith("_path", F.lit(VIEW_PATH)), F.col("_path"))
    return found.select(
        F.col("ts").alias("created_at"), "event_name", path.alias("path"), "retailer", _no().alias("destination_url"),
        *[f"_utm.{key}" for key in UTM_KEYS], "user_agent", "referrer",
    )


def affiliate_url(slugs: DataFrame, affiliates: DataFrame) -> DataFrame:
    """The link to send a visitor of each slug to: override, else base URL, else ``#``."""
    links = affiliates.select("slug", F.coalesce(F.nullif("override_url", F.lit("")), F.col("base_url")).alias("_link"))
    return slugs.join(links, "slug", "left").withColumn("affiliate_url", F.coalesce("_link", F.lit("#"))).drop("_link")


def wrap_affiliate_link(links: DataFrame, affiliates: DataFrame) -> DataFrame:
    """Links (slug, url) with the tracking id of the slug's network, where it has both."""
    tracking = affiliates.filter((F.col("network") != "none") & present(F.col("tracking_id"))).select("slug", "tracking_id")
    joint = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    tracked = F.concat("url", joint, F.lit("ref="), "tracking_id")
    return links.join(tracking, "slug", "left").withColumn("wrapped_url", F.coalesce(tracked, F.col("url"))).drop("tracking_id")


def _normal_url(url: Column) -> Column:
    """An absolute web URL with at least the root path, null for anything else."""
    web = F.when(url.rlike(r"(?i)^https?://[^/?#\s]+"), url)
    bare = web.rlike(r"^[^:]+://[^/?#]*\z")
    return F.when(bare, F.concat(web, F.lit("/"))).otherwise(web)


def outbound_events(hits: DataFrame, retailers: DataFrame, affiliates: DataFrame) -> DataFrame:
    """Consented outbound clicks to the affiliate link, or the website, of a catalogued retailer."""
    kept = consent_gate(hits.filter(F.col("kind") == "outbound"))
    goals = affiliate_url(retailers.select("slug", "website"), affiliates).select(
        F.col("slug").alias("target"),
        _normal_url(F.when(F.col("affiliate_url") == "#", F.col("website")).otherwise(F.col("affiliate_url"))).alias("destination_url"),
    )
    found = _with_cookie_utm(kept.join(goals.filter(F.col("destination_url").isNotNull()), "target"))
    return found.select(
        F.col("ts").alias("created_at"), F.lit(OUTBOUND).alias("event_name"), url_path(F.col("url")).alias("path"),
        F.col("target").alias("retailer"), "destination_url", *[f"_utm.{key}" for key in UTM_KEYS], "user_agent", "referrer",
    )


def all_events(hits: DataFrame, retailers: DataFrame, affiliates: DataFrame) -> DataFrame:
    """All three kinds of events of a table or stream of hits."""
    return (
        attribution_events(hits)
        .unionByName(engagement_events(hits, retailers))
        .unionByName(outbound_events(hits, retailers, affiliates))
    )


def view_key(event: Column, page: Column, deal_id: Column, destination: Column) -> Column:
    """What a viewer sends only once: page turns per page, deal clicks per deal and link, the rest per view."""
    return (
        F.when(event == "folder_page_turn", F.concat(F.lit("folder_page_turn:"), page.cast("string")))
        .when(
            event == "deal_click",
            F.concat(F.lit("deal_click:"), deal_id, F.lit(":"), F.coalesce(destination, F.lit(""))),
        )
        .otherwise(event)
    )


def dedupe_view_hits(hits: DataFrame, tie: str = "hit_id") -> DataFrame:
    """The first hit per view and key. ``hits``: view_id, event_key, ts, the ``tie`` column and more.

    An aggregate, so repeated hits of one view are reduced before the shuffle.
    """
    rest = [c for c in hits.columns if c not in ("view_id", "event_key")]
    first = hits.groupBy("view_id", "event_key").agg(F.min_by(F.struct(*rest), F.struct("ts", tie)).alias("h"))
    return first.select("view_id", "event_key", "h.*")


def scroll_milestones(samples: DataFrame) -> DataFrame:
    """Milestones of each view from its scroll samples: half and nine tenths of the page, and 15 seconds on it.

    ``samples``: view_id, ts, y, height, viewport. A milestone has the time it was first reached; samples
    of pages that cannot scroll count for the time only.
    """
    room = F.col("height") - F.col("viewport")
    pct = F.when(room > 0, F.col("y") / room * 100)
    ts = F.col("ts")
    per_view = samples.groupBy("view_id").agg(
        F.min(ts).alias("begin"), F.max(ts).alias("end"), F.min(F.when(pct >= 50, ts)).alias("half"),
        F.min(F.when(pct >= 90, ts)).alias("most"),
    )
    engaged = F.col("begin") + F.expr("INTERVAL 15 SECONDS")

    def milestone(name: str, at: Column) -> Column:
        return F.when(at.isNotNull(), F.struct(F.lit(name).alias("event_name"), at.alias("created_at")))

    reached = F.array(
        milestone("folder_view", F.col("begin")),
        milestone("folder_engaged_15s", F.when(F.col("end") >= engaged, engaged)),
        milestone("folder_scroll_50", F.col("half")),
        milestone("folder_scroll_90", F.col("most")),
    )
    return unnest(per_view, ["view_id"], reached, "m").select("view_id", "m.*")
