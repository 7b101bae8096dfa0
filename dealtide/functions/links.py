"""Links of HTML pages in column expressions: what counts as markup, character references, and references resolved as browsers do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import once

#: The inside of a tag: a ``>`` within quotes does not end it.
INSIDE = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
#: What holds no elements: comments, and elements whose content is text.
_HIDDEN = rf"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|noscript|template|xmp)(?=[\s/>]){INSIDE}>.*?(?:</\1\s*>|\z)"
_FRAME = rf"(?is)(<iframe(?=[\s/>]){INSIDE}>).*?(?:</iframe\s*>|\z)"
_QUOTED = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"

# Names of character references that pages use, and what they stand for.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "euro": "€", "copy": "©", "reg": "®", "trade": "™", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "deg": "°", "middot": "·",
    "agrave": "à", "aacute": "á", "acirc": "â", "auml": "ä", "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê", "euml": "ë", "iuml": "ï",
    "ocirc": "ô", "ouml": "ö", "ugrave": "ù", "ucirc": "û", "uuml": "ü", "szlig": "ß",
}


def visible(html: Column) -> Column:
    """``html`` with comments, scripts and other text-only content blanked, so that tags in it are not found."""
    return F.regexp_replace(html, _HIDDEN, " ")


def _character(number: Column) -> Column:
    """The character of a code point; those that are none give the replacement character."""
    good = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")


def unescaped(text: Column) -> Column:
    """``text`` with its character references decoded; what is none stays as it is."""
    names = F.create_map(*[F.lit(v) for pair in NAMED.items() for v in pair])

    def piece(part: Column) -> Column:
        name = F.regexp_extract(part, r"^([a-zA-Z]+);", 1)
        digits, hexes = F.regexp_extract(part, r"^#(\d{1,9});?", 1), F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,7});?", 1)
        after = lambda pattern: F.regexp_replace(part, pattern, "")
        known = F.try_element_at(names, name)
        return (
            F.when(known.isNotNull(), F.concat(known, after("^[a-zA-Z]+;")))
            .when(digits != "", F.concat(once(digits.cast("long"), _character), after(r"^#\d{1,9};?")))
            .when(hexes != "", F.concat(once(F.conv(hexes, 16, 10).cast("long"), _character), after("^#[xX][0-9a-fA-F]{1,7};?")))
            .otherwise(F.concat(F.lit("&"), part))
        )

    def decoded(value: Column) -> Column:
        parts = lambda found: F.concat(F.get(found, F.lit(0)), F.array_join(F.transform(F.slice(found, 2, 1 << 30), piece), ""))
        return F.when(F.contains(value, F.lit("&")), once(F.split(value, "&"), parts)).otherwise(value)

    return once(text, decoded)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the inside of a tag, decoded; null when absent or empty."""
    # attributes before it are passed one by one, so that the name inside a value is not taken for an attribute
    before = r"^(?:[\s/]*+(?!" + name + r"[\s=>/])[^\s=/>\"']++(?:\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+)*+[\s/]*+"
    pattern = rf"(?is){before}{name}{_QUOTED}"
    return unescaped(F.nullif(F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)]), F.lit("")))


def _without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments, also where their dots are percent-encoded."""
    none = F.array().cast("array<string>")

    def walked(parts: Column) -> Column:
        kept = F.aggregate(
            parts, none,
            lambda seen, p: F.when(p == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).when(p == ".", seen).otherwise(F.concat(seen, F.array(p))),
        )
        folder = F.element_at(parts, -1).isin(".", "..")  # these name a folder
        return once(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(folder & (F.size(k) > 0), F.lit("/")).otherwise("")))

    parts = F.transform(F.slice(F.split(path, "/"), 2, 1 << 30), lambda p: F.when(p.rlike(r"(?i)^(?:\.|%2e){1,2}\z"), F.regexp_replace(p, "(?i)%2e", ".")).otherwise(p))
    return F.when(path.rlike(r"(?i)/(?:\.|%2e)"), once(parts, walked)).otherwise(path)


def _encoded(url: Column) -> Column:
    """``url`` with blanks, quotes, angle brackets and characters beyond ASCII percent-encoded."""
    one = lambda c: F.when(c.rlike(r"[\x21\x23-\x3b\x3d\x3f-\x7e]"), c).when(c == " ", F.lit("%20")).otherwise(F.url_encode(c))
    return F.when(url.rlike(r"^[\x21\x23-\x3b\x3d\x3f-\x7e]*\z"), url).otherwise(F.array_join(F.transform(F.split(url, ""), one), ""))


def _absolute(base: Column, link: Column) -> Column:
    """``link``, slashes only, put after what it keeps of ``base``."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page, query = F.regexp_extract(base, r"^([^?#]*)", 1), F.regexp_extract(base, r"^([^#]*)", 1)
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(page, r"^(.*/)", 1))
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(link == "", query)
        .when(F.startswith(link, F.lit("#")), F.concat(query, link))
        .when(F.startswith(link, F.lit("?")), F.concat(page, link))
        .otherwise(F.concat(folder, link))
    )


def _tidy(url: Column) -> Column:
    """An absolute address as browsers write it."""
    head = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80\z", "$1"), r"^(https://.*):443\z", "$1")
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*(.*)\z", 1)
    walked = once(F.when(path == "", F.lit("/")).otherwise(path), _without_dots)
    return once(F.concat(head, walked, rest), _encoded)


def resolved(base: Column, link: Column) -> Column:
    """``link`` as seen from the page at ``base``, in the form browsers give it.

    Blanks around it and line ends in it go; scheme and host are in lower case, default ports go, backslashes count as slashes, dot
    segments are followed. Other schemes than http and https are returned as they are written.
    """
    def seen(bare: Column) -> Column:
        slashed = F.concat(F.replace(F.regexp_extract(bare, r"^([^?#]*)", 1), F.lit("\\"), F.lit("/")), F.regexp_extract(bare, r"^[^?#]*(.*)\z", 1))
        other = bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~bare.rlike(r"(?i)^https?:[/\\]")
        return F.when(other, bare).otherwise(once(once(slashed, lambda s: _absolute(base, s)), _tidy))

    return once(F.regexp_replace(F.regexp_replace(link, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", ""), seen)


def base_of(html: Column, url: Column) -> Column:
    """What links of a page are resolved against: its address, or the first address a base element names."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<base(\s{INSIDE})>"), F.lit(1))
    named = F.filter(F.transform(tags, lambda tag: attribute(tag, "href")), lambda h: h.isNotNull())
    return once(F.get(named, F.lit(0)), lambda href: F.when(href.isNotNull(), resolved(url, href)).otherwise(url))


def anchors(html: Column, url: Column) -> Column:
    """The links of a page in order, as (href, text): texts without tags, references decoded, addresses resolved."""
    pattern = F.lit(rf"(?is)<a(\s{INSIDE})>(.*?)(?:</a\s*>|(?=<a\s)|\z)")

    def link(a: Column, base: Column) -> Column:
        text = unescaped(F.regexp_replace(a["text"], rf"<[a-zA-Z/!]{INSIDE}>", ""))
        return once(attribute(a["tag"], "href"), lambda href: F.when(href.isNotNull(), F.struct(resolved(base, href).alias("href"), text.alias("text"))))

    def found(shown: Column) -> Column:
        tags, texts = F.regexp_extract_all(shown, pattern, F.lit(1)), F.regexp_extract_all(shown, pattern, F.lit(2))
        zipped = F.arrays_zip(tags.alias("tag"), texts.alias("text"))
        return once(base_of(shown, url), lambda base: F.array_compact(F.transform(zipped, lambda a: link(a, base))))

    return once(F.regexp_replace(visible(html), _FRAME, "$1"), found)


def frames(html: Column, url: Column) -> Column:
    """The addresses of the frames of a page, in order."""
    def found(shown: Column) -> Column:
        tags = F.regexp_extract_all(shown, F.lit(rf"(?is)<iframe(\s{INSIDE})>"), F.lit(1))
        sources = F.filter(F.transform(tags, lambda tag: attribute(tag, "src")), lambda s: s.isNotNull())
        return once(base_of(shown, url), lambda base: F.transform(sources, lambda s: resolved(base, s)))

    return once(visible(html), found)
