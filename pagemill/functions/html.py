"""Extraction from HTML as Column functions (PRJ-1 to PRJ-15, SRC-19, SNK-5).  Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions.hashing import hex_bytes
from pagemill.functions.urls import SPACE, normalize_url, resolve_url, strip


def title(html: Column) -> Column:
    """Text of the first literal ``<title>`` in lower case, trimmed; null where it or its end is missing."""
    low = F.lower(html)
    return F.when(low.rlike("(?s)<title>.*?</title>"), strip(F.regexp_extract(low, "(?s)<title>(.*?)</title>", 1)))


def title_or(html: Column, domain: Column) -> Column:
    """The title, the domain where there is none; an empty title stays empty."""
    return F.coalesce(title(html), domain)


def meta(html: Column, name: str) -> Column:
    """Content of the first ``meta`` of this name that has one, in lower case, trimmed; double quotes only."""
    tags = F.regexp_extract_all(F.lower(html), F.lit("(?s)<meta([^>]*)"), F.lit(1))
    named = F.filter(tags, lambda t: (F.regexp_extract(t, 'name="([^"]*)', 1) == name) & t.contains('content="'))
    return strip(F.regexp_extract(F.get(named, F.lit(0)), '(?s)content="([^"]*)', 1))


def keywords(html: Column) -> Column:
    """The keywords of a page, split at commas of both kinds and white space; an empty list without any."""
    return F.coalesce(F.filter(F.split(meta(html, "keywords"), f"[,，{SPACE}]+"), lambda k: k != ""), F.array().cast("array<string>"))


def page_text(html: Column) -> Column:
    """Title, description and keywords: what fingerprints and vocabularies are made from."""
    d = meta(html, "description")
    return F.concat(F.coalesce(title(html), F.lit("")), F.coalesce(F.concat(F.lit(" "), d), F.lit("")), F.concat_ws("", F.transform(keywords(html), lambda k: F.concat(F.lit(" "), k))))


def links(html: Column, base: Column) -> Column:
    """Addresses a page leads to, as a bag: those of its ``<a>`` tags, resolved, and every bare http(s) address, in lower case."""
    tags = F.regexp_extract_all(html, F.lit("(?is)<a [^>]*"), F.lit(0))
    hrefs = F.flatten(F.transform(tags, lambda t: F.array(*[F.when(t.rlike(f"(?is)href={q}[^{q}]*{q}"), F.regexp_extract(t, f"(?is)href={q}([^{q}]*){q}", 1)) for q in "\"'"])))
    bare = F.regexp_extract_all(F.lower(html), F.lit(f"https?://[^{SPACE}\"')><\\]`]*"), F.lit(0))
    return F.array_compact(F.concat(F.transform(hrefs, lambda h: resolve_url(base, h)), F.transform(bare, normalize_url)))


def strip_tags(c: Column) -> Column:
    """Without tags, white space collapsed; a stray ``>`` goes too."""
    text = F.replace(F.regexp_replace(c, "(?s)<[^>]*(?:>|$)", ""), F.lit(">"), F.lit(""))
    return strip(F.regexp_replace(text, f"[{SPACE}]+", " "))


def decode_entities(c: Column) -> Column:
    """Character references decoded in one pass: six by name, and decimal and hexadecimal ones; unknown ones stay.

    Text and references alternate in the list that is folded, so nothing decoded is read again.
    """
    parts = F.regexp_extract_all(c, F.lit("(?s)&(?:quot|amp|lt|gt|nbsp|apos|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});|&|[^&]+"), F.lit(0))

    def one(p: Column) -> Column:
        code = F.when(p.rlike("^&#[0-9]+;$"), F.regexp_extract(p, "^&#([0-9]+);$", 1).cast("int")).when(
            p.rlike("^&#[xX][0-9a-fA-F]+;$"), F.conv(F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10).cast("int"))
        valid = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.when(p == "&quot;", '"').when(p == "&amp;", "&").when(p == "&lt;", "<").when(p == "&gt;", ">").when(p == "&nbsp;", " ").when(p == "&apos;", "'")
        return F.coalesce(named, F.when(valid, wide), p)

    return F.when(c.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def sitemap_locs(xml: Column) -> Column:
    """Every non-empty ``<loc>`` of a sitemap, in lower case, trimmed."""
    found = F.regexp_extract_all(F.lower(xml), F.lit("(?s)<loc>(.*?)</loc>"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda u: u != "")


def sitemap_urls(html: Column, domain: Column) -> Column:
    """Home page, root-relative and absolute references of a page, sorted, each once."""
    tags = F.regexp_extract_all(F.lower(html), F.lit("(?s)<a [^>]*"), F.lit(0))
    hrefs = F.transform(F.filter(tags, lambda t: t.contains('href="')), lambda t: F.regexp_extract(t, '(?s)href="([^"]*)', 1))
    home = F.concat(F.lit("https://"), domain)
    kept = F.transform(F.filter(hrefs, lambda h: h.rlike("^(?:/|https?://)")), lambda h: F.when(h.startswith("/"), F.concat(home, h)).otherwise(h))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.concat(home, F.lit("/"))), kept)))


def sitemap_xml(urls: Column) -> Column:
    """A sitemap of addresses as XML text."""
    entries = F.concat_ws("", F.transform(urls, lambda u: F.concat(F.lit("  <url><loc>"), u, F.lit("</loc></url>\n"))))
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'), entries, F.lit("</urlset>\n"))


def page_url(domain: Column, rel: Column, crawled: bool) -> Column:
    """The address of a page of a site's tree."""
    return F.concat(F.lit("http://" if crawled else "https://"), domain, F.lit("/"), rel)


def render_page(template: str, **fields: Column) -> Column:
    """A text template with ``{name}`` for the fields; others stay."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def icon_hue(domain: Column) -> Column:
    """Hue of a domain's letter icon: its bytes as a polynomial in 31, modulo 2**64, then modulo 360."""
    d = strip(domain)
    codes = F.transform(hex_bytes(d), lambda x: F.conv(x, 16, 10).cast("decimal(38,0)"))
    h = F.aggregate(codes, F.lit(0).cast("decimal(38,0)"), lambda a, b: F.pmod(a * F.lit(31) + b, F.lit("18446744073709551616").cast("decimal(38,0)")).cast("decimal(38,0)"))
    return F.pmod(h, F.lit(360).cast("decimal(38,0)")).cast("int")


def icon_link(html: Column, home: Column) -> Column:
    """Address of the first icon a page names; null without one."""
    tag = F.get(F.filter(F.regexp_extract_all(html, F.lit("(?is)<link[^>]*"), F.lit(0)), lambda t: t.rlike('(?i)rel="(?:shortcut )?icon"') & t.rlike('(?i)href="')), F.lit(0))
    return resolve_url(home, F.regexp_extract(tag, '(?is)href="([^"]*)', 1))
