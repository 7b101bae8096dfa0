"""Registered queries. Importing this package registers all of them."""

from . import capture_queries, catalog_queries, event_queries, extract_queries, folder_queries, harvest_queries, ingest_queries, product_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
from .views import AS_OF, BASE_TABLES, load  # noqa: F401
