"""Importing this module registers every query of the package."""

from . import bpe, curriculum, fingerprints, fuzzy_lines, langid, licenses, ngram_join, quality, secrets, sharding, spelling, stripes, substrings  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
