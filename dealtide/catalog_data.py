"""The retailer catalog, its stores, affiliate links, labels and preset cities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERTICALS = ["general", "pet", "electro", "fashion", "home-garden", "beauty", "diy"]

# slug, name, website, category, verticals
RETAILERS = [
    ("albert-heijn", "Albert Heijn", "https://www.ah.be", "supermarkt", VERTICALS),
    ("lidl", "Lidl", "https://www.lidl.be", "supermarkt", VERTICALS),
    ("delhaize", "Delhaize", "https://www.delhaize.be", "supermarkt", VERTICALS),
    ("colruyt", "Colruyt", "https://www.colruyt.be", "supermarkt", VERTICALS),
    ("aldi", "ALDI", "https://www.aldi.be", "supermarkt", VERTICALS),
    ("action", "Action", "https://www.action.com/nl-be", "discounter", VERTICALS),
    ("maxi-zoo", "Maxi Zoo", "https://www.maxizoo.be", "dierenwinkel", ["pet"]),
    ("tom-co", "Tom&Co", "https://www.tomandco.com", "dierenwinkel", ["pet"]),
    ("zooplus", "Zooplus", "https://www.zooplus.be", "dierenwinkel", ["pet"]),
    ("aveve", "AVEVE", "https://www.aveve.be", "dierenwinkel", ["pet"]),
    ("medpets", "Medpets", "https://www.medpets.be", "dierenwinkel", ["pet"]),
    ("mediamarkt", "MediaMarkt", "https://www.mediamarkt.be", "electronica", ["electro"]),
    ("coolblue", "Coolblue", "https://www.coolblue.be", "electronica", ["electro"]),
    ("vanden-borre", "Vanden Borre", "https://www.vandenborre.be", "electronica", ["electro"]),
    ("krefel", "Krëfel", "https://www.krefel.be", "electronica", ["electro"]),
    ("bol", "bol", "https://www.bol.com", "electronica", ["electro"]),
    ("hm", "H&M", "https://www2.hm.com/nl_be", "mode", ["fashion"]),
    ("zalando", "Zalando", "https://www.zalando.be", "mode", ["fashion"]),
    ("ikea", "IKEA", "https://www.ikea.com/be/nl", "meubels", ["home-garden"]),
    ("gamma", "Gamma", "https://www.gamma.be", "bouwmarkt", ["home-garden"]),
    ("kruidvat", "Kruidvat", "https://www.kruidvat.be", "drogist", ["beauty"]),
    ("ici-paris-xl", "ICI PARIS XL", "https://www.iciparisxl.be", "parfum", ["beauty"]),
    ("douglas", "Douglas", "https://www.douglas.be", "beauty", ["beauty"]),
    ("di", "Di", "https://www.di.be", "drogist", ["beauty"]),
    ("etos", "Etos", "https://www.etos.nl", "drogist", ["beauty"]),
    ("boots", "Boots", "https://www.boots.com", "beauty", ["beauty"]),
    ("muller", "Müller", "https://www.muller.be", "beauty", ["beauty"]),
    ("rossmann", "Rossmann", "https://www.rossmann.nl", "drogist", ["beauty"]),
    ("treac", "Trekpleister", "https://www.trekpleister.nl", "drogist", ["beauty"]),
    ("rituals", "Rituals", "https://www.rituals.com", "beauty", ["beauty"]),
    ("yves-rocher", "Yves Rocher", "https://www.yves-rocher.be", "beauty", ["beauty"]),
    ("the-body-shop", "The Body Shop", "https://www.thebodyshop.com", "beauty", ["beauty"]),
]

# id, retailer, name, city, postal code, lat, lng
STORES = [
    ("ah-antwerpen", "albert-heijn", "Albert Heijn Antwerpen", "Antwerpen", "2000", 51.2194, 4.4025),
    ("lidl-brussel", "lidl", "Lidl Brussel", "Brussel", "1000", 50.8503, 4.3517),
    ("delhaize-gent", "delhaize", "Delhaize Gent", "Gent", "9000", 51.0543, 3.7174),
    ("colruyt-luik", "colruyt", "Colruyt Luik", "Luik", "4000", 50.6326, 5.5797),
    ("aldi-leuven", "aldi", "ALDI Leuven", "Leuven", "3000", 50.8798, 4.7005),
    ("action-hasselt", "action", "Action Hasselt", "Hasselt", "3500", 50.9307, 5.3325),
]

# slug, network, base URL, tracking id, name of the override setting
AFFILIATES = [
    ("albert-heijn", "none", "https://www.ah.be/bonus", None, "AFFILIATE_AH"),
    ("lidl", "none", "https://www.lidl.be/nl/aanbiedingen", None, "AFFILIATE_LIDL"),
    ("delhaize", "none", "https://www.delhaize.be/nl/promoties", None, "AFFILIATE_DELHAIZE"),
    ("colruyt", "none", "https://www.colruyt.be/nl/promoties", None, "AFFILIATE_COLRUYT"),
    ("aldi", "none", "https://www.aldi.be/nl/onze-folders.html", None, "AFFILIATE_ALDI"),
    ("action", "none", "https://www.action.com/nl-be/folder/", None, "AFFILIATE_ACTION"),
]

CATEGORY_LABELS = {
    "dierenwinkel": "Dierenwinkels",
    "tuin": "Tuin & dier",
    "supermarkt": "Supermarkten",
    "discounter": "Discounters",
    "warenhuis": "Warenhuizen",
    "electronica": "Elektronicazaken",
    "doe-het-zelf": "Doe-het-zelf",
    "drogist": "Drogisterijen",
    "mode": "Mode",
    "vrije-tijd": "Vrije tijd",
}

# value, label, lat, lng
CITIES = [
    ("antwerpen", "Antwerpen", 51.2194, 4.4025),
    ("brussel", "Brussel", 50.8503, 4.3517),
    ("gent", "Gent", 51.0543, 3.7174),
    ("leuven", "Leuven", 50.8798, 4.7005),
    ("hasselt", "Hasselt", 50.9307, 5.3325),
    ("luik", "Luik", 50.6326, 5.5797),
]


def retailers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RETAILERS, "slug string, name string, website string, category string, verticals array<string>"
    )


def stores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        STORES, "id string, retailer_slug string, name string, city string, postal_code string, lat double, lng double"
    )


def affiliates(spark: SparkSession, settings: dict[str, str] | None = None) -> DataFrame:
    """Affiliate links; ``settings`` gives override URLs by setting name."""
    rows = [(*row[:4], (settings or {}).get(row[4])) for row in AFFILIATES]
    return spark.createDataFrame(
        rows, "slug string, network string, base_url string, tracking_id string, override_url string"
    )
