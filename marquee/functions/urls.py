"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The host in lower case without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def first_path_segment(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def without_query(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", "")


def path_depth(url: Column) -> Column:
    path = F.regexp_extract(without_query(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/(.*)$", 1)
    return F.size(F.array_remove(F.split(path, "/"), "")).cast("long")


def parent_path(url: Column) -> Column:
    """The path's steps but for the last, joined by slashes."""
    steps = F.array_remove(F.split(F.regexp_extract(without_query(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/(.*)$", 1), "/"), "")
    return F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), "/")


def absolute_url(href: Column, base: Column) -> Column:
    """href as seen from the page at base: a URL, //host, /path, ?query, #place, or a name beside the page."""
    b = F.coalesce(base, F.lit(""))
    scheme, origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)//", 1), F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    plain = without_query(b)
    folder = F.when(F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*)$", 1) == "", F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(plain, "[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("?")), F.concat(plain, href)).when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(b, "#.*$", ""), href)).otherwise(F.concat(folder, href))
    )


def unwrap_redirect(url: Column, wrapper: str) -> Column:
    """The decoded u= parameter where the URL is of the wrapping host, else the URL; one that can't be decoded too."""
    inner = F.regexp_extract(url, r"[?&]u=([^&#]*)", 1)
    return F.when(F.contains(url, F.lit(wrapper)) & (inner != ""), F.coalesce(F.try_url_decode(inner), url)).otherwise(url)


def affiliate_rank(url: Column) -> Column:
    """0 and 1 for links of the two affiliate programmes, in their order; null for others."""
    has = lambda *marks: F.coalesce(sum((F.contains(url, F.lit(m)).cast("int") for m in marks), F.lit(0)) > 0, F.lit(False))
    # What marks a link of each programme.
    return F.when(has("aaid="), F.lit(0)).when(has("seeticketsusa.us", "eventim.us", "nts_trk="), F.lit(1))


def add_param(url: Column, name: str, value: str) -> Column:
    return F.concat(url, F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit(f"{name}={value}"))


def image_mime(url: Column) -> Column:
    """The media type of an image URL's extension."""
    ext = image_extension(url)
    return F.concat(F.lit("image/"), F.when(ext == "jpg", "jpeg").otherwise(ext))


def image_extension(url: Column) -> Column:
    """The extension of an image URL where it is a known one, else jpg."""
    found = F.lower(F.regexp_extract(without_query(url), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(found.isin("jpg", "jpeg", "png", "gif", "webp"), found).otherwise(F.lit("jpg"))
