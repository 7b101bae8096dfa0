"""Coverage of the catalog by crawl configurations and documents, and configuration quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import unnest
from ..functions.text import present
from ..params import clock
from .folders import pick_current


def coverage_checks(
    retailers: DataFrame, configs: DataFrame, docs: DataFrame, as_of, require_deals: bool = False
) -> DataFrame:
    """Why a catalogued retailer has nothing to show, as an ordered list of reasons.

    ``retailers``: project, slug; ``configs``: slug, folder_urls; ``docs``: parsed documents.
    """
    crawled = configs.select(
        "slug",
        F.lit(True).alias("has_config"),
        F.exists("folder_urls", lambda u: F.startswith(u, F.lit("http"))).alias("has_folder_urls"),
    )
    current = pick_current(F.col("folders"), clock(as_of))
    stored = docs.filter("is_json").select(
        "slug",
        F.lit(True).alias("has_data_file"),
        F.coalesce(F.size("folders"), F.lit(0)).alias("folder_count"),
        F.coalesce(F.size("deals"), F.lit(0)).alias("deal_count"),
        current.alias("_current"),
        "methods",
        "scraped_at",
    )
    joined = retailers.join(crawled, "slug", "left").join(stored, "slug", "left")

    def filled(name: str) -> Column:
        return F.coalesce(present(F.col("_current")[name]), F.lit(False))

    flags = {
        **{c: F.coalesce(c, F.lit(False)) for c in ("has_config", "has_folder_urls", "has_data_file")},
        **{c: F.coalesce(c, F.lit(0)) for c in ("folder_count", "deal_count")},
        "has_current_folder": F.col("_current").isNotNull(),
        "renderable": filled("embed_url") | filled("pdf_url") | F.coalesce(F.size("_current.pages") > 0, F.lit(False)),
        "content_source": F.col("_current.content_source"),
    }
    reasons = [
        ("missing_scraper", ~F.col("has_config")),
        ("missing_folder_urls", ~F.col("has_folder_urls")),
        ("missing_data_file", ~F.col("has_data_file")),
        ("no_folders", F.col("folder_count") == 0),
        ("no_current_folder", ~F.col("has_current_folder")),
        ("folder_not_renderable", F.col("has_current_folder") & ~F.col("renderable")),
    ]
    if require_deals:
        reasons.append(("no_products", (F.col("deal_count") == 0) & ~F.col("renderable")))
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in reasons]))
    return (
        joined.withColumns(flags)
        .withColumn("failure_reasons", found)
        .withColumn("failing", F.size("failure_reasons") > 0)
        .select(
            *retailers.columns, "has_config", "has_folder_urls", "has_data_file", "folder_count", "has_current_folder",
            "renderable", "content_source", "deal_count", "failing", "failure_reasons", "methods", "scraped_at",
        )
    )


def coverage_failing(checks: DataFrame) -> DataFrame:
    return checks.filter("failing").select(
        "project", "slug", "failure_reasons", "folder_count", "deal_count", "content_source"
    )


def coverage_counts(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("failing")).alias("failing_count")
    )


def inspector_search(
    retailers: DataFrame, configs: DataFrame, checks: DataFrame | None = None, query: str = "", project: str | None = None,
    with_config: bool = False, only_failing: bool = False,
) -> DataFrame:
    """Catalogued retailers narrowed by project, configuration, failure and text, by project and slug.

    ``retailers``: project, slug, name, category, website.
    """
    found = retailers
    if project:
        found = found.filter(F.col("project") == project)
    wanted = query.strip().lower()
    if wanted:
        fields = [F.coalesce(c, F.lit("")) for c in ("project", "slug", "name", "category", "website")]
        found = found.filter(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(wanted)))
    if only_failing:
        failing = checks.filter("failing").select("project", "slug")
        found = found.join(failing, ["project", "slug"], "left_semi")
    configured = configs.select("slug", F.lit(True).alias("has_config"))
    found = found.join(configured, "slug", "inner" if with_config else "left")
    return found.withColumn("has_config", F.coalesce("has_config", F.lit(False))).orderBy("project", "slug")


def config_quality(configs: DataFrame) -> DataFrame:
    """Broken rules of crawl configurations: slug, rule.

    ``configs``: slug, name, folder_urls, deal_urls, cookie_selectors, card_selector, name_selector.
    """
    def web(urls: str) -> Column:
        return F.forall(urls, lambda u: F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://")))

    def repeated(urls: str) -> Column:
        return F.size(F.array_distinct(urls)) < F.size(urls)

    selectors = present(F.col("card_selector")) & present(F.col("name_selector"))
    any_selector = F.col("card_selector").isNotNull() | F.col("name_selector").isNotNull()
    rules = [
        ("name_missing", ~F.coalesce(present(F.col("name")), F.lit(False))),
        ("few_folder_urls", F.coalesce(F.size("folder_urls"), F.lit(0)) < 2),
        ("no_cookie_selectors", F.coalesce(F.size("cookie_selectors"), F.lit(0)) < 1),
        ("folder_url_not_web", ~web("folder_urls")),
        ("deal_url_not_web", ~web("deal_urls")),
        ("selectors_incomplete", any_selector & ~F.coalesce(selectors, F.lit(False))),
        ("folder_urls_repeated", repeated("folder_urls")),
        ("deal_urls_repeated", repeated("deal_urls")),
    ]
    broken = F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in rules])
    per_config = unnest(configs, ["slug"], broken, "rule").drop("_n")
    twice = configs.groupBy("slug").count().filter("count > 1").select("slug", F.lit("slug_repeated").alias("rule"))
    return per_config.unionAll(twice)
