"""Column functions on URLs: policy, tracking parameters, redirects, hosts. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.constants import ENGINE_PATHS, PRIVATE_HOSTS, TRACKING_KEYS

_SCHEME_HOST = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\[\]@ ]+)(?::[0-9]{1,5})?(?:[/?#].*)?$"


def scheme(url: Column) -> Column:
    """Scheme in lower case, '' where the URL has none or is malformed."""
    return F.lower(F.regexp_extract(F.trim(url), _SCHEME_HOST, 1))


def host(url: Column) -> Column:
    """Host in lower case, brackets of IPv6 literals removed, '' where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _SCHEME_HOST, 2)), r"[\[\]]", "")


def path(url: Column) -> Column:
    """Path, '/' where the URL has a host but no path."""
    raw = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(raw == "", F.lit("/")).otherwise(raw)


def is_http(url: Column) -> Column:
    """Whether the URL parses and its scheme is http or https; false for null."""
    return F.coalesce((host(url) != "") & scheme(url).isin("http", "https"), F.lit(False))


def is_private_host(name: Column) -> Column:
    """Whether a host is one that may not be fetched.

    IPv6 literals are judged without their brackets, and the prefix fd counts only for
    IPv6 addresses, so that public names such as fd-example.test pass.
    """
    address = F.when(name.contains(":"), name).otherwise(F.lit(""))
    patterns = "|".join(p for p in PRIVATE_HOSTS if p != "^fd")
    return name.rlike(patterns) | address.rlike("^fd")


def url_error(url: Column) -> Column:
    """INVALID_URL for a URL that is malformed, no http(s) or private; null for one that may be fetched."""
    return F.when(~is_http(url) | is_private_host(host(url)), F.lit("INVALID_URL"))


def may_load(url: Column, resource_type: Column, block_images: bool = True, block_media: bool = True, block_fonts: bool = True) -> Column:
    """Whether a page may load a sub-resource: http(s), no private host, and no blocked type."""
    blocked = [t for t, on in (("image", block_images), ("media", block_media), ("font", block_fonts)) if on]
    allowed = url_error(url).isNull()
    return allowed & ~resource_type.isin(*blocked) if blocked else allowed


def strip_tracking(url: Column) -> Column:
    """URL without the tracking keys of its query; a malformed URL is returned as it is.

    The query is cut at '&' and the other parameters keep their order and spelling.
    """
    keys = "|".join(TRACKING_KEYS)
    before = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda part: ~part.rlike(rf"^(?:{keys})(?:=|$)") & (part != "")), "&")
    rebuilt = F.concat(before, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)), fragment)
    return F.when((host(url) == "") | ~url.contains("?"), url).otherwise(rebuilt)


def canonical(url: Column) -> Column:
    """A key for pages fetched twice: https, host without www./m./amp., path without a closing slash, no tracking keys, no fragment."""
    clean = F.regexp_replace(strip_tracking(url), r"#.*$", "")
    query = F.regexp_extract(clean, r"\?(.*)$", 1)
    bare = F.regexp_replace(path(clean), r"/+$", "")
    built = F.concat(F.lit("https://"), F.regexp_replace(host(url), r"^(?:www|m|amp)\.", ""), bare, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(host(url) == "", url).otherwise(built)


def query_value(url: Column, key: str) -> Column:
    """Decoded value of a query key, null where it is missing or cannot be decoded."""
    raw = F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1)
    return F.nullif(F.try_url_decode(raw), F.lit(""))


def unwrap_redirect(url: Column) -> Column:
    """Target of a search engine's /url redirect: its q, else its url; other URLs stay."""
    target = F.coalesce(query_value(url, "q"), query_value(url, "url"), url)
    return F.when((host(url) != "") & (path(url) == "/url"), target).otherwise(url)


def is_engine_page(url: Column) -> Column:
    """Whether a URL leads to the search engine's own pages; true where it cannot be parsed."""
    own = F.regexp_extract(path(url), "^(" + "|".join(ENGINE_PATHS) + ")", 1) != ""
    return F.when(F.coalesce(host(url), F.lit("")) == "", F.lit(True)).otherwise(host(url).contains("google.") & own)


def absolute(href: Column, base: str = "https://www.google.com") -> Column:
    """A link of a results page as an absolute URL; null for empty, in-page and script links."""
    link = F.trim(href)
    whole = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(F.lit(base), link))
        .otherwise(F.concat(F.lit(base + "/"), link))
    )
    return F.when((link == "") | link.startswith("#") | F.lower(link).startswith("javascript:"), F.lit(None)).otherwise(whole)


def domain(url: Column) -> Column:
    """Host without www., or 'unknown'."""
    return F.coalesce(F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit("")), F.lit("unknown"))


def short_hash(value: Column) -> Column:
    """First 8 hex digits of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 8)


def search_url(query: Column, count: Column, locale: Column, region: Column) -> Column:
    """Address of a results page for a query; hl and gl are left out where null."""
    parts = F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(query), F.lit("&num="), count.cast("string"))
    parts = F.concat(parts, F.coalesce(F.concat(F.lit("&hl="), F.url_encode(locale)), F.lit("")), F.coalesce(F.concat(F.lit("&gl="), F.url_encode(region)), F.lit("")))
    return F.concat(parts, F.lit("&udm=web"))
