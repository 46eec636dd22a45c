"""URL algebra as Column functions (URL-1 to URL-8).  Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space of Unicode as a Java character class, and a pattern for it at both ends.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
ENDS = rf"^[{SPACE}]+|[{SPACE}]+$"
#: Starts of references that lead to no page.
NO_PAGE = "#|javascript:|mailto:|tel:|data:|about:"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, ENDS, "")


def _null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def domain_of(url: Column) -> Column:
    """Host and port in lower case; null without a lower-case http(s) scheme or with an empty host."""
    return _null_if_empty(F.lower(F.regexp_extract(url, "^https?://([^/]*)", 1)))


def normalize_url(url: Column) -> Column:
    """Trimmed, without fragment, scheme and host in lower case, an empty path as ``/``; null unless http(s) with a host."""
    u = F.regexp_replace(strip(url), "(?s)#.*$", "")
    host = F.lower(F.regexp_extract(u, "(?i)^https?://([^/]*)", 1))
    path = F.regexp_extract(u, "(?is)^https?://[^/]*(/.*)$", 1)
    return F.when(host != "", F.concat(F.lower(F.regexp_extract(u, "(?i)^(https?)://", 1)), F.lit("://"), host, F.when(path == "", "/").otherwise(path)))


def url_path(url: Column) -> Column:
    """From the first slash after the host, query and fragment included; ``/`` if there is none; the whole input without a scheme."""
    path = F.regexp_extract(url, "(?s)^.*?://[^/]*(/.*)$", 1)
    return F.when(~url.contains("://"), url).otherwise(F.when(path == "", "/").otherwise(path))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)^(.*?://[^/]*)", 1)


def resolve_url(base: Column, href: Column) -> Column:
    """A reference in a page as an absolute address; null where it leads to no page.

    Absolute and protocol-relative ones are normalised; others are joined to the origin or directory of ``base`` as they are.
    """
    h = strip(href)
    home = _null_if_empty(origin(base))
    return (
        F.when((h == "") | h.rlike(f"^(?:{NO_PAGE})"), F.lit(None).cast("string"))
        .when(h.rlike("^https?://"), normalize_url(h))
        .when(h.startswith("//"), normalize_url(F.concat(F.lit("http:"), h)))
        .when(h.startswith("/"), F.concat(home, h))
        .otherwise(F.concat(home, F.regexp_extract(url_path(base), "(?s)^(.*/)", 1), h))
    )


def resolve_redirect(base: Column, target: Column) -> Column:
    """The target of a redirect: kept if absolute, else joined to scheme and host, or to ``base`` up to its last slash."""
    t = strip(target)
    scheme = F.when(base.startswith("https://"), "https://").otherwise("http://")
    up = F.when(base.contains("/"), F.regexp_extract(base, "(?s)^(.*)/", 1)).otherwise(base)
    return (
        F.when(t.rlike("^https?://"), t)
        .when(t.startswith("//"), F.concat(F.lit("http:"), t))
        .when(t.startswith("/"), F.concat(scheme, F.coalesce(F.get(F.split(base, "/"), F.lit(2)), F.lit("")), t))
        .otherwise(F.concat(up, F.lit("/"), t))
    )


def parse_query(c: Column) -> Column:
    """The parts of a query string as a map, decoded; of equal names the last counts, a part without ``=`` has an empty value."""
    parts = F.filter(F.split(c, "&"), lambda p: p != "")
    pair = lambda p: F.struct(url_decode(F.substring_index(p, "=", 1)).alias("key"), url_decode(F.when(p.contains("="), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise("")).alias("value"))
    pairs = F.transform(parts, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda o: o["key"] == p["key"]))
    return F.map_from_entries(last)


def url_encode(c: Column) -> Column:
    """Percent encoding that keeps ``A-Za-z0-9-_.~`` and writes a space as ``%20``."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def url_decode(c: Column) -> Column:
    """``%HH`` and ``+`` decoded; a broken escape stays as it is."""
    whole = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(whole)


def dns_server(c: Column) -> Column:
    """A server's address with its port: 53 unless given."""
    return F.when(c.startswith("["), c).when(F.length(c) - F.length(F.replace(c, F.lit(":"))) >= 2, F.concat(F.lit("["), c, F.lit("]:53"))).when(~c.contains(":"), F.concat(c, F.lit(":53"))).otherwise(c)


def seed_domain(c: Column) -> Column:
    """A seed without scheme and final slashes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "^(?:http://)+", ""), "/+$", ""))


def file_name(url: Column) -> Column:
    """The name under which a page is kept: letters, digits, ``. - _`` as they are, others as ``_``; ``index.html`` for the root."""
    safe = F.regexp_replace(url_path(url), r"[^\p{L}\p{N}._-]", "_")
    return F.when(url_path(url).isin("/", ""), "index.html").when(safe.endswith(".html"), safe).otherwise(F.concat(safe, F.lit(".html")))
