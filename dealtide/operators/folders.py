"""Leaflet lifecycle: what is current, expired, offline, and how it can be shown.

A document is one row with its leaflets in an array, so each rule is a pass over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at_first
from ..functions.dates import end_of_day, hours_between, iso_instant
from ..functions.text import present
from ..functions.urls import OFFLINE_RISK_HOSTS, in_domain, url_host
from ..params import clock
from .catalog import slugs_for_vertical

# Hosts that refuse to be framed, and the retailers with rules of their own.
BLOCKED_DOMAINS = ["ah.be", "folder.aldi.be", "publitas.com"]
BLOCKED_RETAILER = "delhaize"
PAGES_ONLY_RETAILER = "colruyt"
VIEWER_STALE_HOURS = 72


def _filled(value: Column) -> Column:
    return F.coalesce(present(value), F.lit(False))


def is_current(folder: Column, now: Column) -> Column:
    """Valid at ``now``; the last day counts only up to its first instant."""
    return (iso_instant(folder["valid_from"]) <= now) & (iso_instant(folder["valid_until"]) >= now)


def pick_current(folders: Column, now: Column) -> Column:
    """The first leaflet valid at ``now``, else the first of all."""
    return F.coalesce(at_first(lambda f: is_current(f, now), folders), F.get(folders, F.lit(0)))


def all_current_folders(docs: DataFrame, as_of) -> DataFrame:
    """The current leaflet of every document that has any."""
    picked = docs.select("slug", pick_current(F.col("folders"), clock(as_of)).alias("folder"))
    return picked.filter(F.col("folder").isNotNull()).select("slug", "folder.*")


def current_folder(docs: DataFrame, slug: str, as_of) -> DataFrame:
    return all_current_folders(docs.filter(F.col("slug") == slug), as_of)


def current_folders_for_vertical(docs: DataFrame, retailers: DataFrame, vertical: str, as_of) -> DataFrame:
    """Documents outside the vertical are dropped before their leaflets are looked at."""
    wanted = docs.join(slugs_for_vertical(retailers, vertical), "slug", "left_semi")
    return all_current_folders(wanted, as_of)


def scraped_at(docs: DataFrame) -> DataFrame:
    return docs.select("slug", iso_instant(F.col("scraped_at")).alias("scraped_at"))


def age_hours(docs: DataFrame, as_of) -> Column:
    return F.when(F.col("is_valid"), hours_between(clock(as_of), iso_instant(F.nullif("scraped_at", F.lit("")))))


def check_local_data(docs: DataFrame, as_of) -> DataFrame:
    """Usable documents (JSON with an array of folders) and their age in hours."""
    return docs.select("slug", F.col("is_valid").alias("valid"), age_hours(docs, as_of).alias("age_hours"))


def first_expiry(now: Column) -> Column:
    """(expired, latest_valid_until) by the first leaflet of a document."""
    until = F.nullif(F.get(F.col("folders"), F.lit(0))["valid_until"], F.lit(""))
    return F.struct(
        F.coalesce(end_of_day(until) < now, F.lit(False)).alias("expired"), until.alias("latest_valid_until")
    )


def folder_expiry(docs: DataFrame, as_of) -> DataFrame:
    return docs.select("slug", first_expiry(clock(as_of)).alias("e")).select("slug", "e.*")


def strip_offline_embeds(docs: DataFrame, as_of) -> DataFrame:
    """Blank the embed and pdf links of leaflets past their end on hosts that take them down.

    A leaflet whose end date cannot be read counts as past; one without an end date does not.
    """
    now = clock(as_of)

    def risky(url: Column) -> Column:
        return F.coalesce(url.rlike(OFFLINE_RISK_HOSTS), F.lit(False))

    def past(folder: Column) -> Column:
        return _filled(folder["valid_until"]) & ~F.coalesce(end_of_day(folder["valid_until"]) >= now, F.lit(False))

    def blank(folder: Column) -> Column:
        def field(name: str) -> Column:
            return F.when(past(folder) & risky(folder[name]), F.lit("")).otherwise(folder[name])

        return folder.withField("embed_url", field("embed_url")).withField("pdf_url", field("pdf_url"))

    changed = F.exists("folders", lambda f: past(f) & (risky(f["embed_url"]) | risky(f["pdf_url"])))
    return docs.withColumns(
        {"folders": F.transform("folders", blank), "changed": F.coalesce(changed, F.lit(False))}
    )


def probe_targets(docs: DataFrame) -> DataFrame:
    """The web links of every leaflet in order: slug, place, url."""
    links = F.flatten(
        F.transform(
            "folders",
            lambda f, i: F.array(
                F.struct((i * 2).alias("place"), f["embed_url"].alias("url")),
                F.struct((i * 2 + 1).alias("place"), f["pdf_url"].alias("url")),
            ),
        )
    )
    rows = docs.select("slug", F.explode(links).alias("link")).select("slug", "link.*")
    return rows.filter(F.startswith("url", F.lit("http")))


def classify_probe(status: Column) -> Column:
    """Live unless the answer was clearly an error; no answer says nothing."""
    return status.isNull() | (status < 400)


def latest_probes(log: DataFrame) -> DataFrame:
    """The last answer per (slug, url) of a probe log with ``seq``."""
    last = log.groupBy("slug", "url").agg(F.max_by(F.struct("status"), F.col("seq")).alias("p"))
    return last.select("slug", "url", "p.status").withColumn("live", classify_probe(F.col("status")))


def probe_results(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """The answers for the links of each document, in the order of the links."""
    return probe_targets(docs).join(probes, ["slug", "url"])


def strip_dead_urls(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """Blank links that answered with an error. ``probes``: slug, url, status, one row per link.

    Only dead links that the documents really hold are collected, so a list per document is no longer
    than the document.
    """
    dead = probes.filter(~classify_probe(F.col("status"))).select("slug", "url")
    held = probe_targets(docs).join(dead, ["slug", "url"], "left_semi")
    gone = held.groupBy("slug").agg(F.collect_set("url").alias("_gone"))

    def keep(url: Column) -> Column:
        return F.when(F.coalesce(F.array_contains(F.col("_gone"), url), F.lit(False)), F.lit("")).otherwise(url)

    return (
        docs.join(gone, "slug", "left")
        .withColumn(
            "folders",
            F.transform(
                "folders",
                lambda f: f.withField("embed_url", keep(f["embed_url"])).withField("pdf_url", keep(f["pdf_url"])),
            ),
        )
        .withColumn("changed", F.col("_gone").isNotNull())
        .drop("_gone")
    )


def viewer_mode(folders: DataFrame, as_of) -> DataFrame:
    """How each leaflet is shown: pages, else embed, else pdf, after the rules for expired and blocked hosts.

    ``folders``: slug and the leaflet columns; ``age_hours`` of the document when known.
    """
    now = clock(as_of)
    embed, pdf = F.col("embed_url"), F.col("pdf_url")
    has_pages = F.coalesce(F.size("pages") > 0, F.lit(False))
    expired = F.coalesce(end_of_day(F.col("valid_until")) < now, F.lit(False))
    host = url_host(F.nullif(embed, F.lit("")))
    blocked = F.col("slug") == BLOCKED_RETAILER
    for domain in BLOCKED_DOMAINS:
        # The bare viewer domain itself may be framed, its subdomains may not.
        blocked = blocked | (F.endswith(host, F.lit("." + domain)) if domain == "publitas.com" else in_domain(host, domain))
    blocked = F.coalesce(host.isNotNull() & blocked, F.lit(False))
    pages_only = (F.col("slug") == PAGES_ONLY_RETAILER) & has_pages

    def at_risk(url: Column) -> Column:
        return expired & F.coalesce(url.rlike(OFFLINE_RISK_HOSTS), F.lit(False))

    embed_ok = _filled(embed) & ~pages_only & ~blocked & ~at_risk(embed)
    pdf_ok = _filled(pdf) & ~pages_only & ~at_risk(pdf)
    mode = F.when(has_pages, "pages").when(embed_ok, "embed").otherwise("pdf")
    stale = F.coalesce(F.col("age_hours") > VIEWER_STALE_HOURS, F.lit(False)) if "age_hours" in folders.columns else F.lit(False)
    return folders.select(
        "slug", F.col("id").alias("folder_id"), expired.alias("expired"), stale.alias("stale"), blocked.alias("embed_blocked"),
        embed_ok.alias("embed_shown"), pdf_ok.alias("pdf_shown"), mode.alias("mode"),
    )
