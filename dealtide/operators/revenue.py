"""Revenue model: advertising and affiliate income of measured traffic under a few scenarios.

Scenarios are a handful of named constants. They enter as an array literal that each traffic row is
expanded by, so nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scenario name, RPM, outbound CTR, EPC.
SCENARIOS = [("conservative", 2.0, 0.03, 0.05), ("base", 3.0, 0.07, 0.12), ("optimistic", 5.0, 0.12, 0.25)]
# Which input is moved, and by how much.
SENSITIVITY = [("rpm", 1.0), ("pages_per_visit", 1.0), ("ctr", 0.03), ("epc", 0.05)]


def _literals(names: list[str], rows) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def with_scenarios(traffic: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Every traffic row once per scenario."""
    names = ["scenario", "rpm", "ctr", "epc"]
    return traffic.withColumn("s", F.explode(_literals(names, scenarios))).select(
        *traffic.columns, *[F.col(f"s.{n}").alias(n) for n in names]
    )


def ad_revenue(pageviews: Column, rpm: Column) -> Column:
    return pageviews / F.lit(1000.0) * rpm


def affiliate_revenue_epc(visits: Column, ctr: Column, epc: Column) -> Column:
    return visits * ctr * epc


def affiliate_revenue_conversion(visits: Column, ctr: Column, conversion: Column, commission: Column) -> Column:
    return visits * ctr * conversion * commission


def combined_revenue(traffic: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Advertising plus affiliate income of each traffic row (visits, pageviews) in each scenario."""
    rows = with_scenarios(traffic, scenarios)
    ads = ad_revenue(F.col("pageviews"), F.col("rpm"))
    affiliate = affiliate_revenue_epc(F.col("visits"), F.col("ctr"), F.col("epc"))
    return rows.select(
        *traffic.columns,
        "scenario",
        ads.alias("ads"),
        affiliate.alias("affiliate"),
        (ads + affiliate).alias("total"),
    )


def revenue_sensitivity(traffic: DataFrame, scenarios=SCENARIOS, grid=SENSITIVITY) -> DataFrame:
    """Change of the total when one input moves by one step of ``grid``."""
    rows = with_scenarios(traffic, scenarios).withColumn("g", F.explode(_literals(["input", "step"], grid)))
    step, moved = F.col("g.step"), F.col("g.input")
    visits = F.col("visits")
    change = (
        F.when(moved == "rpm", ad_revenue(F.col("pageviews"), step))
        .when(moved == "pages_per_visit", ad_revenue(visits * step, F.col("rpm")))
        .when(moved == "ctr", affiliate_revenue_epc(visits, step, F.col("epc")))
        .when(moved == "epc", affiliate_revenue_epc(visits, F.col("ctr"), step))
    )
    return rows.select(*traffic.columns, "scenario", moved.alias("input"), step.alias("step"), change.alias("change"))
