"""Text columns that follow browser-side string rules where they differ from the JVM's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and "any character but a line end" in the sense of ECMAScript regular expressions.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ANY = r"[^\n\r\x{2028}\x{2029}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
# ASCII word edges, also next to accented letters (where the JVM's \b does not match).
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"
CASELESS = r"(?i)"  # letters beyond a-z are listed in both cases in the patterns

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_SPACE_CODES = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_SPACES = "".join(map(chr, _SPACE_CODES))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(_SPACES))


def erase(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern``, null when there is none."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def longer_than(text: Column, n: int) -> Column:
    """UTF-16 length > n; the exact count is only taken for short texts."""
    return (F.length(text) > n) | (utf16_length(text) > n)


def utf16_head(text: Column, n: int) -> Column:
    """The first n UTF-16 units."""
    cut = F.decode(F.substring(F.encode(text, "UTF-16BE"), 1, 2 * n), "UTF-16BE")
    return F.when(F.octet_length(text) <= n, text).otherwise(cut)


def ascii_fold(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, _UPPER, _UPPER.lower())


def js_percent_decode(text: Column) -> Column:
    """Percent-decode, '+' stays a plus; null when an escape is broken."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def query_values(url: Column, keys: list[str]) -> Column:
    """The named query parameters as a struct, form-decoded; absent and blank ones null.

    The query is cut out once and each value decoded once: one-element arrays hold them in between.
    """
    def decode(raw: Column) -> Column:
        return F.nullif(F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" "))), F.lit(""))

    query = F.array(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    raws = F.transform(query, lambda q: F.array(*[F.regexp_extract(q, rf"(?:^|&){key}=([^&]*)", 1) for key in keys]))
    values = F.transform(raws, lambda r: F.transform(r, decode))
    named = F.transform(values, lambda v: F.struct(*[F.get(v, F.lit(n)).alias(key) for n, key in enumerate(keys)]))
    return F.get(named, F.lit(0))


def any_of(text: Column, words: list[str]) -> Column:
    """True if ``text`` holds at least one of the literal ``words``."""
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def present(text: Column) -> Column:
    """Neither null nor empty."""
    return text.isNotNull() & (text != "")
