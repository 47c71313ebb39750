"""Functions over pages and feed fields: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ticket sellers append to a title; parts of a page that hold no content; entities.
TICKET_SUFFIX = r"\s*[|\-–—]\s*(?:Tickets?|Buy Tickets?|Eventbrite|Ticketmaster|Live Nation|See Tickets|AXS|Etix)\s*$"
SKIPPED_TAGS = ("script", "style", "nav", "footer", "header")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_ticket_boilerplate(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), "(?iU)" + TICKET_SUFFIX, ""))


def strip_html(html: Column) -> Column:
    """The text of a page, in one line, without the parts that hold no content."""
    t = F.coalesce(html, F.lit(""))
    for tag in SKIPPED_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, sign in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f\x0B]+", " "))


def meta_content(html: Column, name: str) -> Column:
    """The content of a page's meta tag of that name or property, in either order of attributes; empty for none."""
    named, content = rf"(?:property|name)\s*=\s*[\"']{name}[\"']", r"content\s*=\s*[\"']([^\"']*)[\"']"
    found = lambda pattern: F.regexp_extract(F.coalesce(html, F.lit("")), "(?is)" + pattern, 1)
    first = found(rf"<meta\b[^>]*?{named}[^>]*?{content}")
    return F.when(first != "", first).otherwise(found(rf"<meta\b[^>]*?{content}[^>]*?{named}"))


def image_from_tag(tag: Column) -> Column:
    """The image of a tag: src, data-src, the first of srcset, or a background; without its query."""
    t = F.coalesce(tag, F.lit(""))
    tries = [F.regexp_extract(t, "(?is)" + p, 1) for p in (r"\ssrc\s*=\s*[\"']([^\"']+)", r"\sdata-src\s*=\s*[\"']([^\"']+)", r"\ssrcset\s*=\s*[\"']\s*([^\s,\"']+)", r"url\(\s*[\"']?([^\"')]+)")]
    found = F.coalesce(*[F.when(x != "", x) for x in tries], F.lit(""))
    return F.regexp_replace(found, r"\?.*$", "")


def best_image(images: Column) -> Column:
    """The link of the widest 16:9 image, else of the widest; the first of equals. images: (ratio, width, url) structs."""
    all_of = F.coalesce(images, F.array().cast("array<struct<ratio: string, width: int, url: string>>"))
    wide = F.filter(all_of, lambda i: i["ratio"] == "16_9")
    pool = F.when(F.size(wide) > 0, wide).otherwise(all_of)
    widest = F.array_max(F.transform(pool, lambda i, k: F.struct(F.coalesce(i["width"], F.lit(0)).alias("w"), (-k).alias("k"), i["url"].alias("url"))))
    return F.coalesce(widest["url"], F.lit(""))


def format_price(low: Column, high: Column) -> Column:
    """$low, or $low–$high where they differ, in whole dollars, halves to the even one; empty without a low."""
    dollars = lambda c: F.concat(F.lit("$"), F.bround(c, 0).cast("long").cast("string"))
    both = F.coalesce((high != 0) & (high != low), F.lit(False))
    return F.when(low.isNull(), F.lit("")).otherwise(F.concat(dollars(low), F.when(both, F.concat(F.lit("–"), dollars(high))).otherwise(F.lit(""))))


def classification_names(classifications: Column) -> Column:
    """The distinct names of segment, genre and subGenre, in order, without undefined ones."""
    names = F.flatten(F.transform(classifications, lambda c: F.array(c["segment"]["name"], c["genre"]["name"], c["subGenre"]["name"])))
    return F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & ~F.lower(n).isin("undefined", "")))
