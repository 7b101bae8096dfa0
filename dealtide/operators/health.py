"""Document validation, run results and the health manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import unnest
from ..functions.dates import ISO_DAY, end_of_day, format_age, hours_between, iso_instant
from ..functions.text import present
from ..params import clock
from .folders import age_hours, first_expiry

# Fixed values of the run rules.
STALE_HOURS = 168
ATTEMPTS = 3
ATTEMPTS_IF_EXPIRED = 4
RECENT_DAYS = 3
CONTENT_SOURCES = ["publitas", "ipaper", "yumpu", "issuu", "pdf", "html", "screenshot", "api", "unknown"]

ISSUES = "array<struct<field:string,message:string,severity:string>>"


def _filled(value: Column) -> Column:
    return F.coalesce(present(value), F.lit(False))


def _issue(test: Column, field: Column | str, message: Column | str, severity: str) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(
        F.coalesce(test, F.lit(False)),
        F.struct(field.alias("field"), message.alias("message"), F.lit(severity).alias("severity")),
    )


def _shown(value: Column) -> Column:
    return F.coalesce(value, F.lit("undefined"))


def _has_content(f: Column) -> Column:
    return _filled(f["embed_url"]) | _filled(f["pdf_url"]) | F.coalesce(F.size(f["pages"]) > 0, F.lit(False))


def _folder_issues(f: Column, i: Column) -> Column:
    prefix = F.concat(F.lit("folders["), i.cast("string"), F.lit("]"))

    def date(name: str, field: str) -> Column:
        bad = ~_filled(f[name]) | ~F.coalesce(f[name].rlike(ISO_DAY), F.lit(False))
        return _issue(bad, F.concat(prefix, F.lit("." + field)), F.concat(F.lit("Invalid date: "), _shown(f[name])), "error")

    def link(name: str, field: str) -> Column:
        bad = _filled(f[name]) & ~F.startswith(f[name], F.lit("http"))
        return _issue(bad, F.concat(prefix, F.lit("." + field)), F.concat(F.lit("Not a valid URL: "), f[name]), "warning")

    counts = F.concat(
        F.lit("Mismatch: pageCount="), F.format_string("%.0f", f["page_count"]), F.lit(" but pages.length="),
        F.size(f["pages"]).cast("string"),
    )
    return F.array(
        _issue(~_filled(f["title"]), F.concat(prefix, F.lit(".title")), "Missing or invalid title", "error"),
        date("valid_from", "validFrom"),
        date("valid_until", "validUntil"),
        _issue(f["page_count"] != F.size(f["pages"]), F.concat(prefix, F.lit(".pageCount")), counts, "warning"),
        link("embed_url", "embedUrl"),
        link("pdf_url", "pdfUrl"),
        _issue(
            ~_has_content(f), prefix, "Folder has no embed, PDF, or pages — will show empty on frontend", "warning"
        ),
    )


def document_issues() -> Column:
    """All issues of a parsed document as an array, in reading order. A missing text is a missing file."""
    def one(field: str, message: str, severity: str) -> Column:
        return F.array(_issue(F.lit(True), field, message, severity))

    empty = F.array(_issue(F.size("folders") == 0, "folders", "Empty folders array", "warning"))
    folders = F.flatten(F.transform("folders", _folder_issues))
    return F.array_compact(
        F.when(F.col("raw").isNull(), one("file", "Data file does not exist", "error"))
        .when(~F.col("is_json"), one("file", "Invalid JSON", "error"))
        .when(~F.col("is_valid"), one("folders", "Missing or not an array", "error"))
        .otherwise(F.concat(empty, folders))
    ).cast(ISSUES)


def validate_docs(docs: DataFrame) -> DataFrame:
    """One row per issue: slug, field, message, severity."""
    return unnest(docs, ["slug"], document_issues(), "issue").select("slug", "issue.*")


def run_status(attempts: DataFrame, docs: DataFrame, as_of, allowed: int | None = None, allowed_if_expired: int | None = None) -> DataFrame:
    """Outcome of each run and retailer from its attempts.

    ``attempts``: run_id, slug, attempt (from 1), ok, error. All attempts count, or the first ``allowed``, and
    ``allowed_if_expired`` for a retailer whose first leaflet has expired. After the last failure
    usable local data serve, stale past a week.
    """
    now = clock(as_of)
    local = docs.select(
        "slug", F.col("is_valid"), age_hours(docs, as_of).alias("age_hours"),
        first_expiry(now)["expired"].alias("expired"),
    )

    # The log is reduced to one row per run and retailer before it meets the documents.
    def within(limit: int | None, name: str) -> list[Column]:
        n = F.col("attempt").cast("int")
        counts = F.col("ok").isNotNull() & (n >= 1) & (F.lit(True) if limit is None else n <= limit)
        last = F.max(F.when(counts, F.struct(n.alias("n"), F.col("error"))))
        return [F.min(F.when(counts & F.col("ok"), n)).alias(f"win{name}"), last.alias(f"last{name}")]

    tried = attempts.groupBy("run_id", "slug").agg(*within(allowed, ""), *within(allowed_if_expired, "_expired"))
    joined = tried.join(local, "slug", "left")
    either = lambda name: F.when(F.coalesce(F.col("expired"), F.lit(False)), F.col(f"{name}_expired")).otherwise(F.col(name))
    win, last = either("win"), either("last")
    used = F.coalesce(win, last["n"])
    usable = F.coalesce(F.col("is_valid"), F.lit(False))
    status = (
        F.when((win == 1), "fresh")
        .when(win > 1, "retry_success")
        .when(usable & F.coalesce(F.col("age_hours") > STALE_HOURS, F.lit(False)), "stale")
        .when(usable, "fallback_local")
        .otherwise("missing")
    )
    error = F.when(win.isNull(), last["error"])
    return joined.select(
        "run_id", "slug", status.alias("status"), used.alias("attempts"), error.alias("error"),
        F.when(win.isNull() & usable, format_age(F.col("age_hours"))).alias("data_age"),
    ).filter(F.col("attempts").isNotNull())


def health_entries(results: DataFrame, docs: DataFrame, probes: DataFrame) -> DataFrame:
    """One entry per result: counts and content flags of the document, its issues and its probed links.

    ``probes`` are the rows of ``probe_results``: at most two per leaflet, so a list stays as short as
    its document.
    """
    def some(test) -> Column:
        return F.coalesce(F.exists("folders", test), F.lit(False))

    facts = docs.select(
        "slug",
        F.nullif("scraped_at", F.lit("")).alias("scraped_at"),
        F.coalesce(F.size("folders"), F.lit(0)).alias("folder_count"),
        F.coalesce(F.size("deals"), F.lit(0)).alias("deal_count"),
        some(lambda f: present(f["embed_url"])).alias("has_embed"),
        some(lambda f: present(f["pdf_url"])).alias("has_pdf"),
        some(lambda f: F.size(f["pages"]) > 0).alias("has_pages"),
        document_issues().alias("validation_issues"),
    )
    probed = probes.groupBy("slug").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "url", "status", "live"))),
            lambda p: F.struct(p["url"].alias("url"), p["status"].alias("status"), p["live"].alias("live")),
        ).alias("probe_results")
    )
    missing_file = F.array(
        F.struct(
            F.lit("file").alias("field"), F.lit("Data file does not exist").alias("message"),
            F.lit("error").alias("severity"),
        )
    ).cast(ISSUES)
    joined = results.join(facts, "slug", "left").join(probed, "slug", "left")
    # Links are probed only for retailers that have data.
    answers = F.when(F.col("status") != "missing", F.col("probe_results"))
    empty = F.array().cast("array<struct<url:string,status:int,live:boolean>>")
    return joined.withColumns(
        {
            "folder_count": F.coalesce("folder_count", F.lit(0)),
            "deal_count": F.coalesce("deal_count", F.lit(0)),
            **{c: F.coalesce(c, F.lit(False)) for c in ("has_embed", "has_pdf", "has_pages")},
            "validation_issues": F.coalesce("validation_issues", missing_file),
            "probe_results": F.coalesce(answers, empty),
        }
    )


def has_errors() -> Column:
    return F.exists("validation_issues", lambda i: i["severity"] == "error")


def has_dead_urls() -> Column:
    return F.exists("probe_results", lambda p: ~p["live"])


def health_summary(entries: DataFrame) -> DataFrame:
    status = F.col("status")
    return entries.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status.isin("fresh", "retry_success")).alias("fresh"),
        F.count_if(status == "fallback_local").alias("fallback"),
        F.count_if(status == "stale").alias("stale"),
        F.count_if(status == "missing").alias("missing"),
        F.count_if(has_errors()).alias("with_errors"),
        F.count_if(has_dead_urls()).alias("with_dead_urls"),
    )


def run_alerts(entries: DataFrame) -> DataFrame:
    """What a run has to report: retailer, kind, whether it fails the run."""
    def alert(test: Column, kind: str, fatal: bool) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(fatal).alias("fatal")))

    kinds = F.array(
        alert(F.col("status") == "missing", "missing", True),
        alert(F.col("status") == "stale", "stale", False),
        alert(has_errors(), "validation_errors", False),
        alert(has_dead_urls(), "dead_urls", False),
    )
    return unnest(entries, ["run_id", "slug"], kinds, "alert").select("run_id", "slug", "alert.*")


def _violations(docs: DataFrame, rules: list[tuple[str, Column]], folder_rules) -> DataFrame:
    """One row per broken rule; ``folder`` is the place of the leaflet, null for the document itself."""
    own = F.array(
        *[
            F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(None).cast("int").alias("folder"), F.lit(n).alias("rule")))
            for n, t in rules
        ]
    )

    def of_folder(f: Column, i: Column) -> Column:
        return F.array(
            *[
                F.when(F.coalesce(t, F.lit(False)), F.struct(i.alias("folder"), F.lit(n).alias("rule")))
                for n, t in folder_rules(f)
            ]
        )

    nested = F.coalesce(
        F.flatten(F.transform("folders", of_folder)), F.array().cast("array<struct<folder:int,rule:string>>")
    )
    return unnest(docs, ["slug"], F.concat(own, nested), "v").select("slug", "v.*")


def contract_violations(docs: DataFrame) -> DataFrame:
    """Breaches of the output contract: ownership, counts, page order, and single-page screenshots of viewers."""
    rules = [
        ("retailer_text", F.col("retailer").isNull()),
        ("folders_array", F.col("folders").isNull()),
        ("deals_array", F.col("deals").isNull()),
        ("scraped_at_text", F.col("scraped_at").isNull()),
    ]

    def of_folder(f: Column) -> list[tuple[str, Column]]:
        pages, count = f["pages"], F.size(f["pages"])
        in_order = F.coalesce(
            F.forall(
                F.transform(pages, lambda p, i: p["page_number"].eqNullSafe(i + 1) & _filled(p["image_url"])), lambda ok: ok
            ),
            F.lit(True),
        )
        viewer = f["content_source"].isin("issuu", "publitas") & F.array_contains("methods", "screenshot")
        return [
            ("folder_retailer", ~f["retailer_slug"].eqNullSafe(F.col("retailer"))),
            ("title_text", f["title"].isNull()),
            ("pages_array", pages.isNull()),
            ("page_count", ~f["page_count"].eqNullSafe(count.cast("double"))),
            ("thumbnail", (count > 0) & ~_filled(f["thumbnail_url"])),
            ("pages_in_order", ~in_order),
            ("single_page_screenshot", viewer & ~(count > 1)),
        ]

    return _violations(docs, rules, of_folder)


def doc_structure_check(docs: DataFrame) -> DataFrame:
    """Required fields of document, leaflet, page and deal, and the shape of links."""
    deals = F.col("deals")
    bad_deal = F.exists(
        deals,
        lambda d: ~_filled(d["id"]) | ~_filled(d["product"]) | d["valid_from"].isNull() | d["valid_until"].isNull()
        | ~d["retailer_slug"].eqNullSafe(F.col("slug")),
    )
    rules = [
        ("json", ~F.col("is_json")),
        ("retailer", ~F.col("retailer").eqNullSafe(F.col("slug"))),
        ("scraped_at", iso_instant(F.col("scraped_at")).isNull()),
        ("folders", F.coalesce(F.size("folders") < 1, F.lit(True))),
        ("deals", deals.isNull()),
        ("source_urls", F.coalesce(F.size("source_urls") < 1, F.lit(True))),
        ("methods", F.col("methods").isNull()),
        ("deal_fields", bad_deal),
    ]

    def of_folder(f: Column) -> list[tuple[str, Column]]:
        web = r"^https?://"
        bad_page = F.exists(
            f["pages"], lambda p: p["page_number"].isNull() | ~_filled(p["image_url"]) | p["deals"].isNull()
        )
        return [
            ("folder_id", ~_filled(f["id"])),
            ("folder_retailer", ~f["retailer_slug"].eqNullSafe(F.col("slug"))),
            ("folder_title", ~_filled(f["title"])),
            ("valid_from", ~F.coalesce(f["valid_from"].rlike(ISO_DAY), F.lit(False))),
            ("valid_until", ~F.coalesce(f["valid_until"].rlike(ISO_DAY), F.lit(False))),
            ("page_count", f["page_count"].isNull()),
            ("pages", f["pages"].isNull()),
            ("content_source", ~F.coalesce(f["content_source"].isin(CONTENT_SOURCES), F.lit(False))),
            ("folder_scraped_at", f["scraped_at"].isNull()),
            ("content", ~_has_content(f)),
            (
                "embed_url",
                _filled(f["embed_url"])
                & (~f["embed_url"].rlike(web) | F.contains(f["embed_url"], F.lit("about:")) | F.contains(f["embed_url"], F.lit("javascript:"))),
            ),
            ("pdf_url", _filled(f["pdf_url"]) & ~f["pdf_url"].rlike(web)),
            ("page_fields", bad_page),
        ]

    return _violations(docs, rules, of_folder)


def freshness_check(docs: DataFrame, as_of) -> DataFrame:
    """Scraped within a week, and at least one leaflet that runs or ended less than three days ago."""
    now = clock(as_of)
    age = hours_between(now, iso_instant(F.col("scraped_at")))
    recent = F.exists("folders", lambda f: hours_between(now, end_of_day(f["valid_until"])) < RECENT_DAYS * 24)
    return docs.select(
        "slug",
        F.coalesce(age < STALE_HOURS, F.lit(False)).alias("fresh"),
        F.coalesce(recent, F.lit(False)).alias("has_recent_folder"),
    )
