"""HTML to title, description, text, links and flags, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, and the named entities that are decoded.
MAX_TEXT, MAX_LINKS, THIN = 200_000, 500, 80
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–",
    "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "copy": "©", "reg": "®", "trade": "™",
}
_DROPPED = ("script", "style", "noscript", "template", "svg")
_BLOCKS = "p|div|br|li|h[1-6]|tr|td|th|section|article|blockquote"


def decode_entities(text: Column) -> Column:
    """Numeric and the known named entities; unknown ones stay. An entity is decoded once, '&amp;lt;' becomes '&lt;'."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&#[xX][0-9a-fA-F]{1,6};|&#\d{1,7};|&[a-zA-Z]+;|[^&]+|&"), 0)
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def char(code: Column) -> Column:
        # UTF-8 bytes of a code point; '' where there is none.
        def byte(n: Column) -> Column:
            return F.lpad(F.hex(n.cast("int")), 2, "0")

        c = code
        low = F.lit(0x3F)
        two = F.concat(byte(F.shiftright(c, 6) + 0xC0), byte(c.bitwiseAND(low) + 0x80))
        three = F.concat(byte(F.shiftright(c, 12) + 0xE0), byte(F.shiftright(c, 6).bitwiseAND(low) + 0x80), byte(c.bitwiseAND(low) + 0x80))
        four = F.concat(byte(F.shiftright(c, 18) + 0xF0), byte(F.shiftright(c, 12).bitwiseAND(low) + 0x80), byte(F.shiftright(c, 6).bitwiseAND(low) + 0x80), byte(c.bitwiseAND(low) + 0x80))
        hexed = F.when(c < 0x80, byte(c)).when(c < 0x800, two).when(c < 0x10000, three).otherwise(four)
        valid = (c > 0) & (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(hexed), "UTF-8")).otherwise("")

    def one(p: Column) -> Column:
        number = F.when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)).otherwise(F.regexp_extract(p, r"^&#(\d+);$", 1))
        return F.when(p.rlike("^&#"), char(number.cast("int"))).when(p.rlike("^&[a-zA-Z]+;$"), F.coalesce(names[F.lower(F.regexp_extract(p, "^&([a-zA-Z]+);$", 1))], p)).otherwise(p)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def attr(tag: Column, name: str) -> Column:
    """The first ``name=value`` of a tag, decoded; null if there is none."""
    pattern = rf"(?i){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    return F.when(tag.rlike(pattern), decode_entities(value))


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " "))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<(?:{name})\b[^>]*>"), 0)


def lang(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1)
    return F.when(found != "", found)


def title(html: Column) -> Column:
    return _collapse(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def _meta_name(tag: Column) -> Column:
    own, prop = attr(tag, "name"), attr(tag, "property")
    return F.lower(F.coalesce(F.when(own != "", own), prop, F.lit("")))


def description(html: Column) -> Column:
    """Content of the first description (meta or Open Graph) that is not empty; ''."""
    found = F.filter(
        F.transform(F.filter(_tags(html, "meta"), lambda t: _meta_name(t).isin("description", "og:description")), lambda t: _collapse(F.coalesce(attr(t, "content"), F.lit("")))),
        lambda d: d != "",
    )
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def noindex(html: Column) -> Column:
    return F.exists(_tags(html, "meta"), lambda t: (_meta_name(t) == "robots") & F.coalesce(attr(t, "content"), F.lit("")).rlike("(?i)noindex"))


def canonical(html: Column) -> Column:
    links = F.filter(_tags(html, "link"), lambda t: F.lower(F.coalesce(attr(t, "rel"), F.lit(""))) == "canonical")
    return F.try_element_at(F.filter(F.transform(links, lambda t: attr(t, "href")), lambda h: h.isNotNull() & (h != "")), F.lit(1))


def links(html: Column) -> Column:
    """Targets of the anchors that are not nofollow, as written, up to the limit."""
    followed = F.filter(_tags(html, "a"), lambda t: ~F.lower(F.coalesce(attr(t, "rel"), F.lit(""))).contains("nofollow"))
    targets = F.filter(F.transform(followed, lambda t: attr(t, "href")), lambda h: h.isNotNull() & (h != "") & ~h.rlike("^(javascript|mailto):"))
    return F.slice(targets, 1, MAX_LINKS)


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and page chrome; one space between words."""
    out = html
    for name in _DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{name}\b.*?</{name}>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<(nav|footer|aside)\b.*?</\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, rf"(?i)<(?:{_BLOCKS})\b[^>]*>", "\n"), r"<[^>]+>", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(decode_entities(out), r"[ \t]+", " "), r"\s*\n\s*", "\n"))
    return F.trim(F.translate(F.substr(F.regexp_replace(out, r"^\n+|\n+$", ""), F.lit(1), F.lit(MAX_TEXT)), "\n", " "))


def extract(html: Column) -> Column:
    """A struct of all of the above."""
    return F.struct(
        title(html).alias("title"), description(html).alias("description"), visible_text(html).alias("text"), links(html).alias("links"),
        lang(html).alias("lang"), noindex(html).alias("noindex"), canonical(html).alias("canonical"),
    )


def indexable(page_title: Column, text: Column, is_noindex: Column) -> Column:
    """Not marked noindex, and not thin: a title, or text of some length."""
    return ~is_noindex & ((page_title != "") | (F.length(text) >= THIN))
